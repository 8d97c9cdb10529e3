"""Golden cases, edge rows and invariants of the corpus operators."""

import math
import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions import scores as sc
from strataloom.functions import text as tx
from strataloom.operators import blend, distribution, domains, match, paired, prefix, rank, samplers, sets, verify
from strataloom.operators import tokens as tk
from strataloom.plans import catalogue
from strataloom.sources import io


def pool(spark, n=500, ties=7):
    df = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % ties).cast("float").alias("q"), (F.xxhash64("id").bitwiseAND((1 << 60) - 1)).alias("tie"), (F.col("id") % 13 + 1).alias("len"))
    return df.withColumn("topic", F.concat(F.lit("t"), F.col("id") if "id" in df.columns else F.col("doc_id") % 3))


@pytest.mark.parametrize("ties", [1, 3, 500])
def test_running_sum_is_the_global_window(spark, ties):
    df = pool(spark, ties=ties)
    by = Window.orderBy(F.col("q").cast("double").desc(), "tie")
    want = {r.doc_id: (r.c, r.n) for r in df.select("doc_id", F.sum("len").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.row_number().over(by).alias("n")).collect()}
    for parts in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.doc_id: (r.cum, r.nth) for r in prefix.running_sum(df, "q", "tie", "len", "cum", rank="nth").collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("start", [0, 1 << 60, -(1 << 62)])
def test_running_sum_keeps_long_keys_apart(spark, start):
    df = spark.range(start, start + 3000).select(F.col("id").alias("k"), (F.col("id") % 5 + 7).alias("n"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    for by in ([], ["g"]):
        window = Window.partitionBy(*by).orderBy("k")
        want = df.withColumns({"c": F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(window).cast("long")})
        got = prefix.running_sum(df, None, "k", "n", "c", by, rank="nth")
        assert sets.same(got, want.select(*got.columns))
    starts = [r.start for r in tk.offsets(df, "k", F.col("n")).orderBy("k").collect()]
    assert starts == sorted(starts) and len(set(starts)) == 3000


@pytest.mark.parametrize("kind", ["float", "double", "long", "int", "decimal(10,2)"])
def test_running_sum_of_odd_scores(spark, kind):
    values = [None, None, 0.0, -0.0, 1.0, -5.0, 7.0, 7.0] + ([float("nan"), float("inf"), float("-inf")] if kind in ("float", "double") else [])
    df = spark.createDataFrame([(i, v, i % 3 + 1) for i, v in enumerate(values * 9)], "k long, v double, n long").withColumn("v", F.col("v").cast(kind))
    window = Window.orderBy(F.col("v").desc(), "k")
    want = df.withColumns({"c": F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, 0))})
    assert {(r.k, r.c) for r in prefix.running_sum(df, "v", "k", "n", "c").collect()} == {(r.k, r.c) for r in want.collect()}


def test_a_constant_score_fills_all_ranges(spark):
    df = spark.range(50_000).select(F.lit(1.0).alias("s"), F.xxhash64("id").alias("tie"))
    sizes = [r["count"] for r in prefix.with_range(df, "s", "tie", 64).groupBy("__range").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 4 * 50_000 / 64


def test_plans_start_no_job(spark):
    df, tracker = pool(spark), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "")
    prefix.chained_fill(df, "q", "tie", "len", [10, 20])
    prefix.quota_fill(df, "topic", "q", "tie", "len", 700)
    prefix.top_share(rank.average_rank_pcts(df, {"q": "r"}), "r", "tie", "len", 0.1)
    assert not tracker.getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_percentiles_and_neighbours(spark):
    import numpy as np

    values = [float(x) for x in np.random.default_rng(5).integers(0, 40, 500)]
    df = spark.createDataFrame([(i, v, None if i % 4 == 0 else f"g{i % 4}") for i, v in enumerate(values)], "k long, v double, g string")
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert np.allclose(rank.percentiles_by(df, "v", at).first().p, np.quantile(values, at))
    for r in rank.percentiles_by(df, "v", at, ["g"]).collect():
        own = [v for i, v in enumerate(values) if (None if i % 4 == 0 else f"g{i % 4}") == r.g]
        assert r.n == len(own) and np.allclose(r.p, np.quantile(own, at))
    before = {r.k: r.b for r in prefix.previous(df, "k", "v", "b").collect()}
    assert before == {i: (values[i - 1] if i else None) for i in range(500)}
    assert rank.percentiles_by(df.where("false"), "v", at).first().p == [None] * len(at)  # as an aggregate of no rows


def test_budget_fill_edges(spark):
    df = pool(spark, 50)
    total = df.agg(F.sum("len")).first()[0]
    first = df.orderBy(F.col("q").desc(), "tie").first().len
    assert prefix.budget_fill(df, "q", "tie", "len", first).count() == 1  # hit exactly
    assert prefix.budget_fill(df, "q", "tie", "len", total * 2).count() == 50
    assert prefix.shortfall(df, "len", total + 5) == 5
    assert prefix.budget_fill(df.where("false"), "q", "tie", "len", 5).count() == 0


def test_chained_fill_shifts_by_the_overshoot(spark):
    df = pool(spark, 300)
    stages = prefix.chained_fill(df, "q", "tie", "len", [100, 100]).groupBy("stage").agg(F.sum("len").alias("t")).collect()
    assert {r.stage for r in stages} == {1, 2} and all(100 <= r.t < 113 for r in stages)


def test_quota_fill_tops_up(spark):
    df = pool(spark, 300)
    out = prefix.quota_fill(df, "topic", "q", "tie", "len", 700)
    assert 700 <= out.agg(F.sum("len")).first()[0] and out.count() == out.select("doc_id").distinct().count()


def test_rank_of_ties(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (3.0,), (3.0,), (3.0,)], "x double")
    got = sorted((r.x, round(r.p, 5)) for r in rank.average_rank_pct(df, "x", "p").collect())
    assert got == [(1.0, 0.25), (1.0, 0.25), (2.0, 0.5), (3.0, 0.83333), (3.0, 0.83333), (3.0, 0.83333)]


def test_greedy_blend_golden(spark):
    rows = blend.greedy(spark, [0.1, 0.5, 0.3, 0.1], [8, 2, 5, 5], 20).orderBy("pos").collect()
    assert [r.ds for r in rows] == [1, 2, 0, 1, 3, 1, 2, 1, 2, 1, 0, 1, 2, 1, 3, 1, 2, 1, 2, 1]
    assert [r.ds_sample for r in rows] == [0, 0, 0, 1, 0, 0, 1, 1, 2, 0, 1, 1, 3, 0, 1, 1, 4, 0, 0, 1]


@pytest.mark.parametrize("kind", ["greedy", "bin_blend", "largest_remainder"])
def test_blend_ratio_and_range(spark, kind):
    lengths = [40, 30]
    rows = getattr(blend, kind)(spark, [8, 2], lengths, 500).collect()
    assert len(rows) == 500 and abs(sum(r.ds == 0 for r in rows) / 500 - 0.8) < 0.05
    assert all(r.ds_sample < lengths[r.ds] for r in rows) and sorted(r.pos for r in rows) == list(range(500))


def test_domain_weights_golden(spark):
    out = domains.count_weights(spark.createDataFrame([("a", 10), ("b", 20), ("c", 70)], "d string, n long"), "n")
    assert [round(r.weight, 6) for r in out.orderBy("d").collect()] == [0.1, 0.2, 0.7]


@pytest.mark.parametrize("size", [128, 512])
def test_apportion_keeps_every_domain(size):
    counts = samplers.apportion([0.9, 0.05, 0.03, 0.01, 0.005, 0.003, 0.001, 0.001], size)
    assert sum(counts) == size and min(counts) >= 1


def test_domain_batches_dont_repeat(spark):
    rows = samplers.domain_batches(spark, [0.3, 0.665, 0.035], [100, 300, 40], 20, 4).collect()
    assert len({(r.domain, r.sample) for r in rows}) == len(rows)
    assert all(sum(r.step == s and r.rank == k for r in rows) == 5 for s in range(3) for k in range(4))


def test_samplers_split_ranks(spark):
    for df in (samplers.sequential(spark, 1003, 40, 4, 3), samplers.cyclic(spark, 1003, 120, 4, 3), samplers.random_buckets(spark, 1003, 120, 4, 3), samplers.strided(spark, 1003, 4)):
        assert verify.ranks_disjoint(df, "sample", "rank")


def test_resume_is_the_same_stream(spark):
    whole = samplers.sequential(spark, 1000, 0, 4, 5).where("micro_batch >= 7").select("sample", "rank")
    assert sets.same(whole, samplers.sequential(spark, 1000, 140, 4, 5).select("sample", "rank"))


def test_windows_conserve_tokens(spark):
    docs = spark.createDataFrame([(0, list(range(15))), (1, list(range(100, 2700))), (2, []), (3, [7])], "doc_id long, ids array<int>").withColumn("file", F.lit(0))
    rows = tk.pack_windows(docs, "doc_id", "ids", 2048, "file").collect()
    assert len(rows) == 1 and rows[0].input_ids == [*range(15), *range(100, 100 + 2034)]
    two = tk.group_texts(docs, "doc_id", "ids", 1000, "file").orderBy("win").collect()
    assert len(two) == 2 and two[0].input_ids[-1] == two[1].input_ids[0]
    assert len(tk.group_texts(docs, "doc_id", "ids", 1000, "file", compat=True).collect()) == 1


def test_document_mask_golden(spark):
    p = spark.createDataFrame([([*range(19), 0],)], "p array<int>").select(tk.document_mask(F.col("p")).alias("m")).first().m
    assert p == [True] * 18 + [False]


def test_supervised_masks(spark):
    df = spark.createDataFrame([([1, 2], [3, 4]), ([1] * 20, [3]), ([], [])], "p array<int>, c array<int>")
    rows = tk.supervised(df, "p", "c", 7).collect()
    assert rows[0].input_ids == [1, 2, 3, 4, 2, 0, 0, 0] and rows[0].label_mask == [False, False, True, True, True, False, False, False]
    assert not any(rows[1].label_mask) and rows[2].label_mask[0]
    assert rows[0].position_ids == [0, 1, 2, 3, 4, -1, -1, -1]


def test_split_bounds():
    assert tk.split_bounds("969,30,1", 1000) == [0, 969, 999, 1000]
    with pytest.raises(ValueError):
        tk.split_bounds("1,2", 10)


LEAK = tx.LEAK_ANCHOR
PREAMBLES = [
    ("Here is a summary:\n\nBody", "Body"), ("Plain text\n\nBody", "Plain text\n\nBody"), ("## Rewritten\n\nBody", "Body"), ("Paraphrased text:\n\nBody", "Body"),
    ("Sure, condensed:\nBody", "Body"), ("Sure, condensed\nBody", "Sure, condensed\nBody"), ("x" * 112 + " summary" + "\n\nB", "x" * 112 + " summary\n\nB"),
    ("Here is a summary " + "x" * 102 + "\n\nB", "B"), ("Here is a summary " + "x" * 103 + "\n\nB", "Here is a summary " + "x" * 103 + "\n\nB"), ("", ""), (None, None),
]


def test_strips(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PREAMBLES)], "i int, t string")
    assert [r.x for r in df.orderBy("i").select(tx.strip_preamble(F.col("t")).alias("x")).collect()] == [b for _, b in PREAMBLES]
    cases = [(f"{LEAK} x\n\nBody", "Body"), (LEAK, ""), (f"a {LEAK}\n\nb", f"a {LEAK}\n\nb"), (None, None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t string")
    assert [r.x for r in df.orderBy("i").select(tx.strip_leak(F.col("t")).alias("x")).collect()] == [b for _, b in cases]


def test_text_functions(spark):
    df = spark.createDataFrame([("abcdef", "abcxef"), ("ab", "abc"), ("", "x"), ("same", "same")], "a string, b string")
    got = df.select(tx.first_difference(F.col("a"), F.col("b")).alias("at"), tx.similarity(F.col("a"), F.col("b")).alias("r"), "a", "b").collect()
    assert [r["at"] for r in got] == [3, 2, 0, 4] and all(abs(r.r - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-9 for r in got)
    loops = spark.createDataFrame([("ab" * 100,), ("".join(chr(33 + i % 90) + str(i) for i in range(90)),), ("short",), (None,)], "t string")
    assert [r.x for r in loops.select(tx.repeats(F.col("t")).alias("x")).collect()] == [True, False, False, False]


def test_similarity_of_long_texts(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 8))) for _ in range(60)]
    prose = [" ".join(rng.choices(words, k=n)) for n in (50, 200, 700)]
    pairs = [(f"Here is a condensed version:\n\n{t}", t) for t in prose]
    pairs += [(t, " ".join(w for w in t.split() if rng.random() > share)) for t in prose for share in (0.05, 0.4)]
    pairs += [(prose[1], prose[2]), ("ab" * 400, "ba" * 300 + "c"), ("é😀" * 150, "x" + "😀é" * 150), ("a" * 900, "b" * 900), (prose[1], ""), (None, prose[1]), (None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.r for r in df.select("i", tx.similarity(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()]
    want = [SequenceMatcher(None, (a or "")[:3000], (b or "")[:3000], autojunk=False).ratio() for a, b in pairs]
    assert got == want
    for _ in range(300):  # ties: few letters, many equal longest matches
        a, b = ("".join(rng.choices("abc", k=rng.randint(130, 400))) for _ in range(2))
        assert tx.matching_chars(a, b) == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_format(spark):
    row = spark.range(1).select(*[sc.human(F.lit(float(x))).alias(f"h{x}") for x in (999, 1234, 1500000)], sc.signed(F.lit(-0.001)).alias("z")).first()
    assert list(row) == ["999", "1.23K", "1.5M", "+0.00"]


def test_must_match_raises(spark):
    a, b = spark.range(5).withColumnRenamed("id", "k"), spark.range(4).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    with pytest.raises(match.Unmatched):
        match.lookup(a, b, "k", must_match=True)
    assert match.lookup(a.where("k < 4"), b, "k", must_match=True).count() == 4


def test_empty_right_side(spark):
    a = spark.createDataFrame([(1, 2, 10)], "k long, s int, w long")
    out = match.cross_pass(a, a.where("false"), "k", "s", "w").collect()
    assert len(out) == 1 and out[0].status_b is None and out[0].tokens == 10


def test_paired_identity_and_missing(spark):
    rows = [(s, seed, 1, "m", float(seed)) for s in "ab" for seed in range(3)]
    scores = spark.createDataFrame(rows, "setting string, seed int, epoch int, metric string, value double")
    out = paired.paired(scores, paired.all_pairs(scores)).first()
    assert out.mean_diff == 0 and out.sd_diff == 0 and out.n_pos == 0
    assert paired.macro_average(scores, ["m", "other"], "x").where("value is not null").isEmpty()


def test_masked_mean_of_nothing(spark):
    assert math.isnan(spark.range(3).agg(distribution.masked_mean(F.col("id"), F.lit(False)).alias("m")).first().m)


def test_exclusive_concat(spark):
    a = spark.range(3)
    with pytest.raises(ValueError):
        sets.concat_exclusive({"a": a, "b": a}, "id")
    assert sets.concat_exclusive({"a": a, "b": spark.range(3, 5)}, "id").count() == 5


def test_jsonl_roundtrip_is_registered(spark, tmp_path):
    odd = [(1, 'a "b"\r\n\u2028\\ é😀\t', 0.1), (1, None, None), (None, "", float("nan"))]
    docs = spark.createDataFrame(odd * 2, "doc_id long, text string, x double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        want, got = spark.read.parquet(f"{folder}/documents.parquet"), catalogue.queries()["jsonl_roundtrip"](spark, folder)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_round_trips(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x\ny", "{}"), ("b", None, None)], io.DOCUMENT)
    docs.write.json(str(tmp_path / "j"))
    assert sets.same(io.read_jsonl(spark, str(tmp_path / "j")), docs)
    ids = spark.createDataFrame([(i, [i, 65535, 2]) for i in range(20)], "doc_id long, ids array<int>")
    io.write_token_files(ids, "doc_id", "ids", str(tmp_path / "t"), "tok", 2, max_tokens=25)
    back = io.read_token_files(spark, str(tmp_path / "t"))
    assert sets.same(back.select("doc_id", "ids"), ids) and back.select("file_no").distinct().count() == 3
    io.write_manifest(spark, {"docs": 3, "rules": ["x"]}, str(tmp_path / "m"))
    assert io.read_manifest(spark, str(tmp_path / "m")) == {"docs": 3, "rules": ["x"]}
    assert sets.same(io.write_checked(ids, str(tmp_path / "c")), ids)
    files = sorted(os.listdir(tmp_path / "c"))
    assert sets.same(io.write_checked(ids, str(tmp_path / "c")), ids) and sorted(os.listdir(tmp_path / "c")) == files  # kept as it was
    changed = ids.withColumn("ids", F.when(F.col("doc_id") == 3, F.array(F.lit(9))).otherwise(F.col("ids")))
    assert sets.same(io.write_checked(changed, str(tmp_path / "c")), changed)
    assert io.write_checked(ids.where("doc_id < 3"), str(tmp_path / "c")).count() == 3
    assert io.write_checked(ids.select("doc_id"), str(tmp_path / "c")).columns == ["doc_id"]
    ordered = io.seeded_order(ids, "doc_id")
    io.export_ordered(ordered, "pos", str(tmp_path / "e"), 4)
    assert spark.read.parquet(str(tmp_path / "e")).groupBy("file_no").count().collect().__len__() == 4


def test_result_tree(spark, tmp_path):
    import json

    for setting, seed, said in (("a", 1, "a"), ("b", 1, "c")):
        path = tmp_path / f"{setting}/seed{seed}/epoch1"
        path.mkdir(parents=True)
        cell = {"setting": said, "seed": seed, "epoch": 1, "step": 5}
        (path / "results.json").write_text(json.dumps({"schema": "v1", "cell": cell, "complete": True, "missing_tasks": [], "tasks": {"t": {"acc": 0.5}}}, indent=1))
    rows = io.read_results(spark, str(tmp_path), "v1")
    assert {(r.setting, r.matches_path) for r in rows.collect()} == {("a", True), ("c", False)}
    expected = spark.createDataFrame([("a", 1, 1), ("z", 1, 1)], "setting string, seed long, epoch long")
    problems = {(r.setting, r.problem) for r in io.results_problems(rows, expected).collect()}
    assert problems == {("z", "missing"), ("c", "misplaced")}


def test_stream_counts_resume(spark, tmp_path):
    from strataloom.streaming import counter

    rows = spark.createDataFrame([("s1", "a b c"), ("s1", "d"), ("s2", None)], "source string, text string")
    src = str(tmp_path / "in")
    rows.coalesce(1).write.mode("append").parquet(src)
    for turn in (1, 2):
        counts = counter.consumption_stream(spark, src, rows.schema)
        q = counter.start_counter(counts, f"totals{turn}", str(tmp_path / f"ck{turn}"))
        q.awaitTermination()
        got = {r.source: (r.docs, r.tokens) for r in spark.table(f"totals{turn}").collect()}
        assert got == {"s1": (2 * turn, 4 * turn), "s2": (turn, 0)}
        rows.coalesce(1).write.mode("append").parquet(src)


def test_same_result_at_any_partitioning(spark):
    from strataloom.plans import catalogue

    results = []
    for parts in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(catalogue.queries()["quota_fill"](spark, "/root/testdata/sf0.001").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
