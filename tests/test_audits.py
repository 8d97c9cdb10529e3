"""Checks, digests, token folders and sequential walks against plain Python."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import digests
from strataloom.functions import text as tx
from strataloom.operators import audit, verify
from strataloom.operators import tokens as tk
from strataloom.plans import catalogue
from strataloom.sources import io

DATA = "/root/testdata/sf0.001"


def test_digests_are_the_plain_ones(spark):
    rng = random.Random(2)
    ids = rng.sample(range(1 << 62), 3000) + [0, 1, -5]
    df = spark.createDataFrame([(k, i, f"h{k % 7}") for i, k in enumerate(ids)], "k long, place long, h string").repartition(5)
    plain = lambda x: hashlib.sha256(np.array(x, "<i8").tobytes()).hexdigest()
    assert tuple(digests.id_digest(df, "k").first()) == (len(ids), plain(sorted(ids)))
    assert digests.id_digest(df, "k", "place").first().digest == plain(ids)
    lines = "".join(f"{k}:h{k % 7}\n" for k in sorted(ids))
    assert digests.rolling_digest(df, "k", F.col("h")).first().digest == hashlib.sha256(lines.encode()).hexdigest()
    assert tuple(digests.id_digest(df.where("false"), "k").first()) == (0, hashlib.sha256(b"").hexdigest())


def test_gate_raises(spark):
    facts = lambda v: spark.createDataFrame([("docs", v)], "name string, value string")
    assert audit.gate(audit.compared(facts("3"), facts("3"))).count() == 1
    with pytest.raises(verify.CheckFailed):
        audit.gate(audit.compared(facts("3"), facts("4")))
    with pytest.raises(verify.CheckFailed):
        audit.gate(audit.compared(facts("3"), spark.createDataFrame([], "name string, value string")))


@pytest.mark.parametrize(("skip", "most"), [(0, None), (7, None), (100, 300), (0, 64), (10_000, None), (33, 1)])
def test_folder_windows(spark, skip, most):
    rng, size = random.Random(4), 9
    files = [(f"f{i:02}", rng.choice([0, 3, 9, 50, 131])) for i in range(12)]
    windows = [(n, w) for n, t in files for w in range(t // size)][-(-skip // size) :][: most // size if most is not None else None]
    got = io.folder_files(spark.createDataFrame(files, "f string, t long"), "f", "t", size - 1, skip, most)
    assert [(r.f, r.skipped + w) for r in got.orderBy("f").collect() for w in range(r.windows)] == windows
    if windows:
        items = io.folder_items(spark.range(3 * len(windows) + 2).withColumnRenamed("id", "i"), "i", got, "f")
        assert [(r.f, r.window, r.epoch) for r in items.orderBy("i").collect()] == [(*windows[i % len(windows)], i // len(windows)) for i in range(3 * len(windows) + 2)]


def plain_blocks(sizes, title, most, long=512, least=2):
    out, first, total = [], 0, 0
    if len(sizes) < least or max(sizes, default=0) > long:
        return out
    for k, n in enumerate(sizes):
        total += n
        left = len(sizes) - k - 1
        if left == 0 or (total >= most - title and left >= least and k + 1 - first >= least):
            out.append((first, k + 1))
            first, total = k + 1, 0
    return out


def test_blocks_and_spans(spark):
    rng = random.Random(6)
    docs = [(i, [rng.choice([1, 5, 30, 80, 600 if i % 9 == 0 else 3]) for _ in range(rng.randint(0, 40))], i % 20) for i in range(200)] + [(200, None, 0)]
    df = spark.createDataFrame(docs, "k long, s array<int>, t int").repartition(6)
    got = [(r.k, r.first, r.end, r.block) for r in tk.block_spans(df, "k", "s", "t", 100).orderBy("block").collect()]
    want = [(k, *b) for k, s, t in docs for b in plain_blocks(s or [], t, 100)]
    assert got == [(*w, i) for i, w in enumerate(want)]
    spans = {}
    for r in tk.sentence_spans(df, "k", "s", 120).collect():
        spans.setdefault(r.k, []).append((r.first, r.end, r.target))
    for k, s, _ in docs:
        rows = sorted(spans.get(k, []))
        if not s or len(s) < 2 or max(s) > 512:
            assert not rows
            continue
        assert [a for a, _, _ in rows] == [0, *(b for _, b, _ in rows[:-1])] and rows[-1][1] == len(s)  # they tile the document
        for a, b, target in rows:
            h = int(hashlib.md5(f"span:{k}:{a}".encode()).hexdigest()[:8], 16)
            assert target == (2 + h % 119 if (h >> 8) % 1000 < 100 else 120)
            ends = [e for e in range(a + 1, len(s) + 1) if e == len(s) or (sum(s[a:e]) >= target and len(s) - e > 1 and e - a >= 2)]
            assert b == ends[0]


def test_packing_is_first_fit_in_order(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.randint(0, 70)) for g in range(5) for i in range(60)]
    got = {(r.g, r.i): (r.bin, r.bin_offset) for r in tk.pack_examples(spark.createDataFrame(rows, "g long, i long, n long").repartition(7), "i", "n", 64, "g").collect()}
    for g in range(5):
        at, used = 0, 0
        for _, i, n in (r for r in rows if r[0] == g):
            if used and used + n > 64:
                at, used = at + 1, 0
            assert got[g, i] == (at, used)
            used += n


def test_ridge_is_numpys(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("embedding", "label").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.linalg.solve(np.eye(x.shape[1]) + x.T @ x, x.T @ np.array([float(r.label) for r in rows]))
    got = [r.coef for r in catalogue.queries()["ridge"](spark, DATA).orderBy("dim").collect()]
    assert np.allclose(got, want, atol=2e-6)


def test_similarity_is_difflibs(spark):
    from difflib import SequenceMatcher

    rows = [("a" * 300 + "b", "a" * 290 + "cb"), ("the quick brown fox " * 20, "the quack brown fix " * 20), ("", ""), ("", "x"), (None, "x"), ("abc" * 900, "bca" * 900)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = [r.s for r in df.select(tx.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    want = [SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in rows]
    assert all(g is None and rows[i][0] is None or abs(g - w) < 1e-9 for i, (g, w) in enumerate(zip(got, want, strict=True)))


def test_small_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d" / "v1").mkdir(parents=True)
    (tmp_path / "d" / "v1" / "train-0.jsonl").write_text('{"text": "a"}\n{"text": "b"}\n')
    spark.range(3).write.parquet(str(tmp_path / "d" / "test.parquet"))
    assert io.read_split(spark, str(tmp_path / "d"), "train", "v1").count() == 2 and io.read_split(spark, str(tmp_path / "d"), "test").count() == 3
    with pytest.raises(FileNotFoundError):
        io.read_split(spark, str(tmp_path / "d"), "valid")
    made = []
    make = lambda: made.append(1) or spark.range(5)
    for _ in range(3):
        assert io.cached(spark, str(tmp_path / "c"), {"seq": 4, "name": "x"}, make).count() == 5
    assert len(made) == 1 and io.cached(spark, str(tmp_path / "c"), {"seq": 5, "name": "x"}, make).count() == 5 and len(made) == 2
    assert io.list_cached(spark, str(tmp_path / "c"), str(tmp_path / "d"), r"\.jsonl$").count() == 1
    io.copy_bytes(spark, str(tmp_path / "d/v1/train-0.jsonl"), str(tmp_path / "copy"))
    io.copy_bytes(spark, str(tmp_path / "d/v1/train-0.jsonl"), str(tmp_path / "copy"))
    assert (tmp_path / "copy").read_text() == (tmp_path / "d/v1/train-0.jsonl").read_text() and not [p for p in tmp_path.iterdir() if ".tmp" in p.name]
    for n in (1, 2):
        assert io.update_manifest(spark, str(tmp_path / "m"), lambda m: {**m, "runs": m.get("runs", 0) + 1})["runs"] == n
    assert json.loads(json.dumps(io.read_manifest(spark, str(tmp_path / "m")))) == {"runs": 2}
    assert io.placeholder(spark, 7).count() == 7 and io.placeholder(spark, 7).columns == []


def test_parquet_glob_reads_folders_and_files(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = catalogue.queries()["parquet_glob"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(20))
    one = next((tmp_path / "documents.parquet").glob("part-*"))
    one.rename(tmp_path / "documents-2.parquet")  # a file beside the folder
    assert sorted(r.doc_id for r in catalogue.queries()["parquet_glob"](spark, str(tmp_path)).collect()) == list(range(20))
