"""Training-data operators against brute force, on planted edge rows: nulls, empty and long texts, ties, repeated rows, empty tables, and
extra columns with clashing names."""

import hashlib
import math
import random
import re
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import check, connect  # noqa: E402

from strataloom.session import shared_folder  # noqa: E402
from strataloom.llm import bpe, chat, common, decontam, dedup, jaccard, langid, lm, pii, queries, sharding, urls  # noqa: E402

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, ids string, rule string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def edge_rows(seed=1):
    """Texts with copies, near copies, hot passages and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = make(60), [None, "", " \t\n", "a", "A  b", "a\tB", "one two three four", "ONE two\nthree four", "x" * 70_000, "…¡ 123", " ".join(make(9000))]
    for _ in range(25):
        base = make(rng.choice([6, 20, 40, 90, 300]))
        for _ in range(rng.randint(1, 6)):
            near = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                near[rng.randrange(len(near))] = "edit" + str(rng.randrange(99))
            texts.append(rng.choice([" ", "  ", "\n"]).join(near))
    hot = make(120)
    for i in range(60):  # one large family, at and around the threshold
        near = list(hot)
        for k in rng.sample(range(120), rng.randint(0, 4)):
            near[k] = f"h{i}x{k}"
        texts.append(" ".join(near))
    texts += [" ".join(make(15) + passage + make(rng.choice([10, 60]))) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", "de", None]), None, None, 1.0, 7, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[3], rows[20], rows[20], (None, "a", "en", None, None, None, None, None, None), (None, "null id here", None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, con, name):
    check(con, queries.queries()[name](spark, DATA), queries.oracle_sql()[name])


# --- 1 -------------------------------------------------------------------------------------------------------------------------------
def reference(vocabulary):
    import public_tokenizers
    import tiktoken

    ranks = bpe.Encoder(vocabulary).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library(spark, docs, vocabulary):
    known = reference(vocabulary)
    rows = bpe.digests(docs, vocabulary).collect()
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    want = sorted((str(r.doc_id), len(ids), digest(ids), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect() for ids in [known.encode_ordinary(r.text or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_bpe_digests_hold_byte_ends(spark, docs, vocabulary):
    known, want = reference(vocabulary), []
    for r in docs.collect():
        ends, at = [], 0
        for token in known.decode_tokens_bytes(known.encode_ordinary(r.text or "")):
            at += len(token)
            ends.append(at)
        want.append((str(r.doc_id), hashlib.sha256(b"".join(e.to_bytes(8, "little") for e in ends)).hexdigest()))
    assert sorted((str(r.doc_id), r.ends_sha256) for r in bpe.digests(docs, vocabulary).collect()) == sorted(want)


def test_bpe_odd_texts(vocabulary):
    own, known, rng = bpe.Encoder(vocabulary, cache_pieces=50), reference(vocabulary), random.Random(5)
    alphabet = "aabZ'''stmdrevl09  \n\t.!é½\u00a0\u2003中𝒳٣\x1c\x85İ"
    for _ in range(300):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(10)]
        assert own.encode(texts) == [known.encode_ordinary(t) for t in texts]
    long = "".join(rng.choice("ab") for _ in range(3000))
    assert own.encode([long, "", long]) == [known.encode_ordinary(long), [], known.encode_ordinary(long)]


def test_bpe_offsets_and_decoding(spark, docs, vocabulary):
    rows = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    for r in rows:
        data = (r.text or "").encode()
        assert bytes(r.decoded) == data and (not r.ids or r.byte_ends[-1] == len(data)) and len(r.ids) == len(r.byte_ends)
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


# --- 2 -------------------------------------------------------------------------------------------------------------------------------
def test_dedup(spark, docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    for every in (True, False):
        rows = dedup.decisions(docs, every_digest=every).collect()
        by = defaultdict(list)
        for r in rows:
            by[(r.keep_id, r.group_size)].append(r)
        assert len(rows) == docs.count()
        for text, ids in groups.items():
            least = min((i for i in ids if i is not None), default=None)
            own = [r for r in by[(least, len(ids))] if r.doc_id in ids]
            assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in own) or len(ids) == 1
            if len(ids) > 1:
                assert sum(r.kept for r in own) == 1
            if every:
                assert {r.text_sha256 for r in own} >= {hashlib.sha256(text.encode()).hexdigest()}
    kept = {r.doc_id for r in dedup.dedup(docs).collect()}
    assert kept == {min(i for i in ids if i is not None) for ids in groups.values() if any(i is not None for i in ids)} | {None}
    assert dedup.decisions(docs.limit(0)).count() == 0 and dedup.dedup(docs).columns == docs.columns


REPEATS = [(1, "one row twice here and now"), (1, "one row  twice here and now"), (1, "one row twice here and now"), (2, "one row twice here and now"), (2, "a text whose id a copy has"), (None, "no id at all in these"),
           (None, "no id at all in these"), (None, "one row twice here and now"), (3, ""), (3, ""), (None, None)]


def test_dedup_drops_what_is_not_kept(spark, docs):
    rows = spark.createDataFrame(REPEATS, "doc_id long, text string")
    want = [(1, "one row twice here and now"), (2, "a text whose id a copy has"), (3, ""), (None, "no id at all in these")]
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(((r.doc_id, plain(r.text)) for r in dedup.dedup(rows).collect()), key=str) == sorted(want, key=str)
    for some in (rows, docs):
        kept = sorted(str(r.doc_id) for r in dedup.decisions(some).where("kept").collect())
        assert sorted(str(r.doc_id) for r in dedup.dedup(some).collect()) == kept


# --- 3 -------------------------------------------------------------------------------------------------------------------------------
def brute_components(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("few", [24, 2])
def test_jaccard_components(spark, docs, few):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, few=few).collect()), key=str)
    assert got == want


def test_jaccard_family_over_a_block(spark):
    """More near copies than a block holds, all linked by chains, among families that are only near each other."""
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    rows, base = [], make(90)
    for i in range(jaccard.BLOCK + 300):
        near = list(base)
        for k in rng.sample(range(90), rng.choice([1, 1, 2, 3])):
            near[k] = f"e{i}x{k}"
        rows.append((i, " ".join(near)))
    for i in range(400):  # a second one, with two thirds of the words
        near = base[:60] + [f"z{k}" for k in range(30)]
        near[rng.randrange(60)] = f"f{i}"
        rows.append((5000 + i, " ".join(near)))
    rng.shuffle(rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    assert got == sorted(brute_components(rows)) and len({c for *_, c in got}) > 1


def test_checkpoints_leave_no_shuffle_files(spark):
    def shuffled() -> int:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle") for i in range(files.size()))

    df = spark.range(10_000).withColumn("k", F.md5(F.col("id").cast("string"))).repartition(4, "k").groupBy("k").count()
    before = shuffled()
    out = common.checkpointed(df)
    deadline = time.time() + 10
    while shuffled() > before and time.time() < deadline:  # files go in the background
        time.sleep(0.1)
    assert shuffled() <= before and out.count() == 10_000


def test_jaccard_deletes_its_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    top = Path(shared_folder(spark).removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in top.rglob("part-*"))
    before = held()
    assert jaccard.join(docs).count() == docs.count()
    assert held() - before < 200 * docs.count()  # what is left are rows and edges, without sets and signatures


def test_jaccard_turns(spark, docs, monkeypatch):
    entries = lambda df: sorted(x for r in df.where("kind = 2").collect() for x in np.frombuffer(r.payload, jaccard._ENTRY).tolist())
    rows = docs.select("doc_id", "text").coalesce(1)
    parts = [entries(jaccard._scan(rows, 3, t, 4)) for t in range(4)]
    assert all(parts) and sorted(x for p in parts for x in p) == entries(jaccard._scan(rows, 3))
    want = sorted(jaccard.join(docs).collect(), key=str)
    monkeypatch.setattr(jaccard, "_turns", lambda *_: 3)
    assert sorted(jaccard.join(docs).collect(), key=str) == want


def test_jaccard_slices_by_size(spark, docs, monkeypatch):
    """A small table's signatures travel in one slice; in more, each task sends every bucket as many messages more."""
    slices, scan = [], jaccard._scan
    monkeypatch.setattr(jaccard, "_scan", lambda docs, n, turn, turns: slices.append((turn, turns)) or scan(docs, n, turn, turns))
    want = sorted(jaccard.join(docs).collect(), key=str)
    assert slices == [(0, 1)]
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 1 + docs.agg(F.sum(F.octet_length("text"))).first()[0] // 3)
    assert sorted(jaccard.join(docs).collect(), key=str) == want and slices[1:] == [(0, 3), (1, 3), (2, 3)]
    monkeypatch.setattr(jaccard, "SLICE_BYTES", 1)
    assert jaccard._slices(docs) == jaccard.TURNS and jaccard._slices(docs.limit(0)) == 1


@pytest.mark.parametrize("hot", [3, jaccard.HOT_ROWS])
def test_components_of_stars(spark, hot):
    rng = random.Random(11)
    links = [(1000, x) for x in range(1001, 1060)] + [(x, 3000) for x in range(2900, 2960)] + [(5000 + x, 5001 + x) for x in range(40)]
    links += [(rng.randrange(10_000, 10_300), rng.randrange(10_000, 10_300)) for _ in range(260)] + [(7, 7), (1030, 2930), (1000, 1001)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in links if a != b for x in (a, b)}
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "u long, v long")
    labels = jaccard.components(frame, hot)
    assert sorted(map(tuple, labels.collect())) == sorted((x, find(x)) for x in linked)
    classes = spark.createDataFrame([(x, x * 2) for x in sorted(linked | {7, 8})], "node long, first long")
    table = classes.select((F.col("first") * 1).alias("doc_id"), "node", F.lit(1).cast("long").alias("n_shingles"))
    got = jaccard._named(table, classes, labels, hot).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((2 * x, 2 * find(x)) for x in linked | {7, 8})


@pytest.mark.parametrize("hot", [1500, jaccard.HOT_ROWS])
def test_family_labels_say_their_size(spark, hot):
    sizes = {1 << 10: 9 * jaccard.FAMILY, 2 << 10: jaccard.FAMILY + 1, 3 << 10: jaccard.FAMILY, 4 << 10: 1}
    rows = [(100 * label + i, label) for label, n in sizes.items() for i in range(n)]
    got = jaccard._stepped(spark.createDataFrame(rows, "node long, label long"), hot).collect()
    steps = {1 << 10: 2, 2 << 10: 1, 3 << 10: 0, 4 << 10: 0}
    assert sorted(map(tuple, got)) == sorted((node, label + steps[label]) for node, label in rows)


def test_components_without_links(spark):
    for rows in ([], [(4, 4)]):
        assert jaccard.components(spark.createDataFrame(rows, "u long, v long"), 3).collect() == []


def test_jaccard_dedup_keeps_a_row_of_each_component(spark, docs):
    far = [(2, "a text whose id a dropped copy has"), (None, "no id at all in these"), (None, "no id at all in these")]
    near = [(1, "n o p q r s t u v w x y z a b c d e f g"), (1, "n o p q r s t u v w x y z a b c d e f h"), (2, "n o p q r s t u v w x y z a b c d e f g"), (3, ""), (3, "")]
    got = jaccard.dedup(spark.createDataFrame(far + near, "doc_id long, text string")).collect()
    want = [far[0], far[1], (3, ""), (3, "")]
    assert sorted((tuple(r) for r in got if not r.text.startswith("n o p")), key=str) == sorted(want, key=str)
    assert [r.doc_id for r in got if r.text.startswith("n o p")] == [1]
    left = jaccard.dedup(docs).collect()
    again = jaccard.join(spark.createDataFrame(left, docs.schema).withColumn("doc_id", F.monotonically_increasing_id())).where("n_shingles > 0").collect()
    before = jaccard.join(docs.withColumn("doc_id", F.monotonically_increasing_id())).collect()
    assert len({r.component_id for r in again}) == len(again) == len({r.component_id for r in before if r.n_shingles})
    assert len(left) - len(again) == sum(not r.n_shingles for r in before)


def test_jaccard_signatures_miss_nothing():
    import numpy as np

    rng = random.Random(3)
    for size in [1, 5, 31, 32, 33, 63, 64, 70, 127, 128, 200, 700]:
        for _ in range(6):
            a = {rng.getrandbits(64) for _ in range(size)}
            b = set(a)
            while True:  # as different as the threshold allows
                c = set(b)
                if rng.random() < 0.5 and len(c) > 1:
                    c.pop()
                else:
                    c.add(rng.getrandbits(64))
                if 4 * len(a & c) < 3 * len(a | c):
                    break
                b = c
            pair = [np.array(sorted(x), np.uint64) for x in (a, b)]
            at = np.array([0, len(a), len(a) + len(b)])
            entries, _ = jaccard.enumerate_all(np.concatenate(pair), at, np.array([2, 4], np.uint64))
            sides = [set(entries["sig"][entries["node"] // 2 == k].tolist()) for k in (1, 2)]
            assert sides[0] & sides[1], size


def test_jaccard_empty(spark, docs):
    assert jaccard.join(docs.limit(0)).count() == 0
    alone = docs.where("doc_id = 1 or doc_id = 2")
    assert {(r.n_shingles, r.component_id) for r in jaccard.join(alone).collect()} == {(0, 1), (0, 2)}
    assert jaccard.dedup(docs).columns == docs.columns


# --- 4 -------------------------------------------------------------------------------------------------------------------------------
def test_language_held_out(spark):
    rows = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def brute_grams(text):
    points, m = [ord(c) for c in f"\x02{text.lower()}\x03"], 1 << 32
    for i in range(len(points)):
        value = 0
        for order in (1, 2, 3):
            point = points[i - order + 1] if i >= order - 1 else 0
            value = ((value * (0x01000193 if order > 1 else 1) % m ^ point * 0x9E3779B1 % m) * 0x85EBCA6B + order) % m
            yield (value ^ value >> 15) * 0x2C1B3C6D % m >> 32 - langid.BUCKET_BITS


def test_language_id_is_naive_bayes(spark):
    """The query against counts in dictionaries and sums of logarithms, one n-gram at a time."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    counts = defaultdict(Counter)
    for r in rows:
        if not held[r.doc_id] and r.lang and r.text:
            counts[r.lang].update(brute_grams(r.text))
    size = 1 << langid.BUCKET_BITS
    whole = {k: math.log(sum(c.values()) + langid.SMOOTHING * size) for k, c in counts.items()}
    got = {r.doc_id: r for r in queries.op4_language_id(spark, DATA).collect()}
    assert len(got) == len(rows) and {k: r.held_out for k, r in got.items()} == held
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        seen = Counter(brute_grams(r.text))
        logs = {k: sum(n * (math.log(counts[k][g] + langid.SMOOTHING) - whole[k]) for g, n in seen.items()) for k in counts}
        best = max(sorted(logs), key=logs.get)
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-6


def test_language_stage_decides_by_the_model(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(docs)
    odd = spark.createDataFrame([(-1, "der die das und nicht ist", None), (-2, "12 34", "en"), (-3, None, "en"), (-4, "", None)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(odd)
    scored = {r.doc_id: r for r in langid.predict(rows, model).collect()}
    for languages, least in ((None, 0.5), (["de"], 0.5), (["en", "fr"], 0.99), ([], 0.5), (None, 1.1)):
        kept = {r.doc_id: r for r in langid.identified(rows, model, languages, least).collect()}
        want = {k for k, r in scored.items() if r.lang_pred != "und" and r.score >= least and (languages is None or r.lang_pred in languages)}
        assert set(kept) == want and all(kept[k].lang == (scored[k].lang or scored[k].lang_pred) for k in kept)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, DATA).count() == docs.count()  # nothing learned, nothing rejected


def test_language_edges(spark, docs):
    model = langid.train(docs)
    rows = langid.predict(docs, model).collect()
    assert set(model[0]) == {"en", "de"} and len(rows) == docs.count()
    for r in rows:
        assert (r.lang_pred == "und" and r.score == 0) == (not any(c.isalpha() for c in r.text or ""))
    kept = langid.identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


# --- 5 -------------------------------------------------------------------------------------------------------------------------------
def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (p != c)))
    return min(row)


def test_myers_is_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(2))
        d, start, end = decontam.closest(a, b)
        assert d == edit_distance(a, b) and 0 <= start <= end <= len(b)


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(8)] + [(8, None), (9, ""), (10, "short")]
    texts = []
    for i in range(60):
        item = items[i % 8][1]
        edits = list(item)
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(edits))
            edits[at : at + 1] = rng.choice([[], ["z"], ["z", edits[at]]])
        texts.append(" ".join(word() for _ in range(15)) + " " + "".join(edits).upper() + "\n" + word())
    rows = [(i, t, 1) for i, t in enumerate([*texts, None, "", "short"])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, distance int")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted({(r.doc_id, r.item_id, r.distance) for r in decontam.hits(docs, table).collect()})
    want = []
    for i, t, _ in rows[: len(rows) // 2]:
        for k, item in items[:8]:
            n, d = decontam.normalised(item), edit_distance(decontam.normalised(item), decontam.normalised(t))
            if d <= int(len(n) * decontam.ERROR_RATE):
                want.append((i, k, d))
    assert got == sorted(want) and 0 < len({i for i, *_ in want}) < 60
    clean = decontam.decontaminate(docs, table)
    assert {r.doc_id for r in clean.collect()} == set(range(63)) - {i for i, *_ in want} and clean.columns == docs.columns
    assert decontam.hits(docs, table.limit(0)).count() == 0
    assert [len(b) for b in decontam.blocks(table, "item_id", "text", most=200)] != [11]


def test_decontamination_of_short_items(spark, tmp_path):
    import corpus_pipeline

    texts = ["The  Cat sat down", "concatenate", "a cat, asleep", "cat", "cats", None, "", "ab 北京大学 cd", "x is 2+2=4", "x is 12+2=4", "dog cat_dog", "concat but then a cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.createDataFrame([(1, " CAT "), (2, "京大"), (3, "2+2=4"), (4, ""), (5, None), (6, "nineteen characters")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.unionByName(spark.createDataFrame([(20, "so nineteen characters it is"), (21, "so nineteen charakters it is")], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    want = {(0, 1, 0, 4, 7), (2, 1, 0, 2, 5), (3, 1, 0, 0, 3), (7, 2, 0, 4, 6), (8, 3, 0, 5, 10), (11, 1, 0, 18, 21), (20, 6, 0, 3, 22)}
    assert {tuple(r) for r in queries.op5_decontamination(spark, str(tmp_path)).collect()} == want
    left = corpus_pipeline.leaks(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r.doc_id for r in left} == {*range(12), 20, 21} - {i for i, *_ in want}


# --- 6 -------------------------------------------------------------------------------------------------------------------------------
def test_language_model(spark, docs):
    held = langid.held_out(parts=10, part=0)
    rows = lm.run(docs.select("doc_id", held.alias("held_out"), "text", "lang"), rounds=3, hot=300).collect()
    texts = [(r.doc_id, words(r.text) + [None]) for r in docs.collect()]
    is_held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    counts = Counter(w for k, ws in texts if not is_held(k) for w in ws)
    n, z = sum(counts.values()), math.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    want = sorted(((str(k), len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10(counts[w] + 0.1) - z for w in ws), 5)) for k, ws in texts))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.score < 0 for r in rows)
    assert lm.run(docs.limit(0).select("doc_id", held.alias("held_out"), "text"), rounds=1).count() == 0


def test_language_model_scores_by_its_weights(spark, docs):
    """Each text's score against plain sums over tokens, with softmax sums over all classes and slots written out."""
    import numpy as np

    table = docs.where("length(text) < 3000 or text is null").select("doc_id", langid.held_out(parts=10, part=0).alias("held_out"), "text")
    n = lm.buckets(spark)
    counted = lm._count(table.where("not held_out"), lm._PAIRS, "word", lambda data, offsets: lm.words(data, offsets)[0], n)
    known = lm.vocabulary(counted, 40)
    rng = np.random.default_rng(3)
    model = lm.Model.start(known.slot_counts)
    model.classes += rng.normal(size=model.classes.shape) / 3
    model.slots += rng.normal(size=model.slots.shape) / 3
    counts = Counter(w for r in table.collect() if not r.held_out for w in [*words(r.text), None])
    slot_of = {}
    for w in {w for r in table.collect() for w in words(r.text)} | {None}:
        data = np.frombuffer((w or "").encode(), np.uint8)
        ids, _ = lm.words(data, np.array([0, len(data)]))
        slot_of[w] = int(known.slots(ids[:1])[0][0])
    shared_tokens, shared_distinct = Counter(), Counter()
    for w, c in counts.items():
        if slot_of[w] >= lm.SLOT_WORDS:
            shared_tokens[slot_of[w]] += c
            shared_distinct[slot_of[w]] += 1
    memo = {}

    def log_slot(two, one, slot):
        if (two, one, slot) not in memo:
            of_class, of_slot, _ = model.features(np.array([(two * lm.SLOTS + one) * lm.SLOTS + slot], np.uint32))
            by_class = [sum(model.classes[f][c] for f in of_class[0]) for c in range(lm.CLASSES)]
            which = slot // lm.WIDTH
            by_slot = [sum(model.slots[f][s] for f in of_slot[0]) for s in range(which * lm.WIDTH, (which + 1) * lm.WIDTH)]
            own = lambda x, i: x[i] - math.log(sum(map(math.exp, x)))
            memo[two, one, slot] = (own(by_class, which) + own(by_slot, slot % lm.WIDTH)) / math.log(10)
        return memo[two, one, slot]

    want = []
    for r in table.collect():
        two = one = 0
        total = 0.0
        for w in [*words(r.text), None]:
            slot = slot_of[w]
            total += log_slot(two, one, slot)
            if slot >= lm.SLOT_WORDS:  # a word's smoothed share of its slot
                total += math.log10(counts[w] + lm.ALPHA) - math.log10(shared_tokens[slot] + lm.ALPHA * (shared_distinct[slot] + 1))
            two, one = one, slot
        want.append((str(r.doc_id), total))
    got = sorted((str(r.doc_id), r.score) for r in lm.score(table, counted, known, model).collect())
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 * max(1, abs(b[1])) for a, b in zip(got, sorted(want), strict=True))


def test_language_model_beats_the_base(spark):
    rows = [r for r in queries.op6_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


def test_model_is_a_distribution():
    import numpy as np

    rng = np.random.default_rng(1)
    model = lm.Model(rng.normal(size=(1 + (1 << lm.FEATURE_BITS), lm.CLASSES)), rng.normal(size=(1 + 2 * lm.SLOTS, lm.SLOTS)))
    keys = ((5 * lm.SLOTS + 9) * lm.SLOTS + np.arange(lm.SLOTS)).astype(np.uint32)
    assert abs(np.exp(model.log_odds(keys)).sum() - 1) < 1e-9


# --- 7 -------------------------------------------------------------------------------------------------------------------------------
def test_sharding(spark, docs):
    limit = 4000
    rows = sharding.assign(docs, limit).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert len(rows) == docs.count() and all(len(k) == r.depth for k, v in by.items() for r in v)
    for v in by.values():
        assert sum(r.bytes for r in v) == v[0].shard_bytes and len(v) == v[0].shard_docs
        assert v[0].shard_bytes <= limit or len({(r.doc_id, r.bytes) for r in v}) == 1
    for shard in by:  # no prefix of another, and a parent never fits
        assert not any(o != shard and o.startswith(shard) for o in by)
        if shard:
            family = [r for k, v in by.items() if k.startswith(shard[:-1]) for r in v]
            assert sum(r.bytes for r in family) > limit
    assert sharding.assign(docs.limit(0), limit).count() == 0


def test_sharding_writes(spark, docs, tmp_path):
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("!")))).withColumn("shard", F.lit("x"))  # ids repeat, texts differ
    sharding.write(twice, str(tmp_path / "s"), 20_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    row = lambda r: (r.doc_id, r.text, r.lang, r.rule)
    assert sorted(map(str, map(row, back.collect()))) == sorted(map(str, map(row, twice.collect())))
    sizes = {r.shard: (r.b, r.n, r.same) for r in back.groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b"), F.count("*").alias("n"), F.countDistinct("doc_id", "text").alias("same")).collect()}
    assert len(sizes) > 5 and all(b <= 20_000 or n == 1 or same == 1 for b, n, same in sizes.values())
    want = {f"s{r.shard}": r.shard_docs for r in sharding.assign(twice, 20_000).collect()}
    assert want == {k: n for k, (_, n, _) in sizes.items()}


# --- 8 -------------------------------------------------------------------------------------------------------------------------------
def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                found.append((kind, *m.span()))
    return found


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def redacted(text, spans):
    out, at = "", 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += f"{text[at:start]}[{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_pii_base(spark, pii_model):
    rng = random.Random(7)
    parts = ["1", "2", "9", ".", "@", "a", "bc", "+", "-", " ", "(", ")", "255", "4111111111111111", "x@y.z", "1.2.3.4", "é", "😀", "+1 (017) 555-7713", "_", "b44e15e09fd311c3cf31"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [None, "", "9" * 20_000, "a" * 60_000 + "@b", "1.2.3.4 " * 700]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(8)
    rows = pii.redact(pii.detect(df, pii_model)).select("doc_id", "text", pii.joined("base").alias("b"), pii.joined("spans").alias("s"), "secrets", "redacted").collect()
    assert len(rows) == len(texts) and any(len(r.s) > len(r.b) for r in rows) and any(r.secrets for r in rows)
    for r in rows:
        want = base_spans(r.text or "")
        assert r.b == ",".join(f"{k}:{a}:{b}" for k, a, b in want), r.text
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.s.split(",") if x)]
        added = [x for x in spans if x not in want] + [("secret", *x) for x in r.secrets]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        for k, a, b in added:  # added spans overlap no other
            assert all(b <= c or d <= a for o, c, d in [*spans, *added] if (o, c, d) != (k, a, b)), r.text
        assert r.redacted == redacted(r.text or "", [(a, b, k) for k, a, b in spans] + [(a, b, "secret") for a, b in r.secrets])
    assert pii.detect(df.limit(0), pii_model).count() == 0


def test_pii_added_spans(spark, pii_model):
    """What the base rules lose for what stands beside it is found, look-alikes are left."""
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(ok):
        while luhn(c := "4" + number(15)) != ok:
            pass
        return c

    phone = lambda: f"+1 ({number(3)}) 555-{number(4)}"
    address = lambda most=255: ".".join(str(rng.randint(most - 200, most)) for _ in range(4))
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    yes, no = [], []
    for _ in range(40):
        yes += [("card", "and {} " + card(True) + " was", card(True)), ("phone", "de {} " + address() + " on", phone()), ("phone", "and {} " + card(True) + " so", phone()), ("secret", 'the token = "{}" was', token()), ("secret", "found {} in the log", token())]
        no += [f"on 20{number(2)}-05-17 we", f"version {number(1)}.2.1.400 is out", f"and {card(False)} {card(False)} was", f"page {number(2)}-{number(3)}", f"order {number(3)}-{number(3)}", address(899), "heithe" * 5 + " was", "look at the.And so", f"sum {number(30)}"]
    texts = [(i, t.format(v), k, v) for i, (k, t, v) in enumerate(yes)] + [(len(yes) + i, t, None, None) for i, t in enumerate(no)]
    rows = pii.detect(spark.createDataFrame(texts, "doc_id long, text string, kind string, value string"), pii_model).select("*", pii.joined("spans").alias("s"), pii.joined("base").alias("b")).collect()
    right = wrong = 0
    for r in rows:
        got = {x for x in r.s.split(",") if x} - {x for x in r.b.split(",") if x} | {f"secret:{a}:{b}" for a, b in r.secrets}
        values = {(x.split(":")[0], r.text[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in got}
        right += (r.kind, r.value) in values
        wrong += len(values) if r.kind is None else 0
    assert right >= 0.9 * len(yes) and wrong <= 0.05 * len(no), (right, len(yes), wrong, len(no))


def test_pii_sweep(spark):
    """Overlaps are settled as by a plain sweep, over more spans than a block holds."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        n = rng.choice([0, 3, 30, 700])
        base = [(0, a, a + rng.randint(1, 9)) for a in (rng.randrange(n * 9 + 1) for _ in range(n // 4))]
        more = [(rng.randrange(4), a, a + rng.randint(1, 9), rng.randrange(5) / 2.0) for a in (rng.randrange(n * 9 + 1) for _ in range(n))]
        rows.append((i, base, more))
    df = spark.createDataFrame(rows, "i long, base array<struct<kind:int,start:int,end:int>>, more array<struct<kind:int,start:int,end:int,odds:double>>")
    for r in df.select("base", "more", pii._apart(F.col("base"), F.col("more")).alias("x")).collect():
        free = sorted((m for m in map(tuple, r.more) if not any(b[1] < m[2] and m[1] < b[2] for b in r.base)), key=lambda m: (m[1], m[0], m[2], m[3]))
        got = [tuple(x) for x in r.x]
        assert set(got) <= set(free) and all(a[2] <= b[1] for a, b in zip(got, got[1:]))
        for m in free:  # one that is left out gave way to one before or after it
            assert m in got or any(g[1] < m[2] and m[1] < g[2] for g in free if g != m)
        if len(r.more) and free:
            assert got


def test_pii_learns_nothing_from_nothing(spark):
    df = spark.createDataFrame([(1, "no data here"), (2, "x@y.com"), (3, None)], "doc_id long, text string")
    assert pii.train(df) == {} and pii.train(df.limit(0)) == {}
    assert [len(r.spans) for r in pii.detect(df).orderBy("doc_id").collect()] == [0, 1, 0]


def test_pii_learns_from_all_rows(spark):
    """Every proposal of every row counts once, in texts of any length, and is labelled as by comparing it with all base matches."""
    rng = random.Random(13)
    parts = ["1", "2", ".", "@", "a", "bc", "+", "-", " ", "(", ")", "255", "4111111111111111", "x@y.z", "x at y dot com", "1.2.3.4", "é", "+1 (017) 555-7713", "017 555 7713", "b44e15e09fd311c3cf31", "token = "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["".join(rng.choice(parts) for _ in range(1200)), None, "", "word " * 30_000 + "a@b.com 1.2.3.4"]
    want: dict = {}
    for text in map(lambda t: t or "", texts):
        base = set(base_spans(text))
        for kind, needs, pattern, masked in pii.GENERATORS:
            raw = [] if kind == pii.SECRET else [m.span() for m in re.finditer(pii.BASE[kind][1].replace(r"(?:\G|", "(?:"), text)]
            b = 0
            for m in re.finditer(pattern, text) if re.search(needs, text) else ():
                last, (a, b) = b, m.span()
                if kind == pii.SECRET:
                    label = int(bool(re.search(pii.ASSIGNED, text[last:a][-pii.CONTEXT :])))
                elif (kind, a, b) in base and (a, b) in raw:
                    label = 1
                elif any((kind, c, d) not in base and c <= a and b <= d and (a, b) != (c, d) or masked and a < d and c < b for c, d in raw):
                    continue
                else:
                    label = 0
                want[kind, label] = want.get((kind, label), 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    got = {(r.kind, r.label): r["count"] for r in pii.examples(df).groupBy("kind", "label").count().collect()}
    assert got == want and len(want) == 10
    many = spark.range(30_000).select(F.concat(F.lit("mail a"), "id", F.lit("@b.com now")).alias("text"))
    assert pii.examples(many).groupBy("half").count().agg(F.sum("count")).first()[0] == 30_000


def test_trees_agree_with_their_column(spark, pii_model):
    assert set(pii_model) == {*pii.KINDS, pii.SECRET}
    for kind, trees in pii_model.items():
        x = [[(i * 7 + k) % 4 for k in range(trees.width)] for i in range(20)]
        df = spark.createDataFrame([(v,) for v in x], "x array<int>").coalesce(1)
        got = [r.o for r in df.select(trees.column([F.col("x")[i] for i in range(trees.width)]).alias("o")).collect()]
        assert all(abs(a - trees.odds(b)) < 1e-9 for a, b in zip(got, x, strict=True)), kind


# --- 9 -------------------------------------------------------------------------------------------------------------------------------
def test_urls(spark):
    cases = [
        ("http://a.org/x", "a.org", "/x", "org/", "allow"), ("https://EXAMPLE.org/es/1?q", "example.org", "/es/1", "example.org/es/", "block"), ("http://m.example.org/en/12#t", "m.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de", "x.com", "/de", None, "allow"), ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"), ("http://a.org", "a.org", "", None, "allow"),
        (None, "", "", None, "allow"), ("no scheme.org/", "", "", None, "allow"), ("http://my-spam.net/", "my-spam.net", "/", None, "block"), ("http://a.net/x.exe", "a.net", "/x.exe", None, "block"), ("http://a.net/x.exe.txt", "a.net", "/x.exe.txt", None, "allow"),
        ("http://evil.net/a.org/", "evil.net", "/a.org/", None, "allow"), ("http://evil.net/b.org\n/", "evil.net", "/b.org\n/", None, "allow"), ("", "", "", None, "allow"), ("http://é.org/é", "é.org", "/é", "org/", "allow"), ("x://" + "a" * 5000 + ".org/", "a" * 5000 + ".org", "/", "org/", "allow"),
    ]
    df = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(cases)], "page_id long, url string, rule string")
    got = urls.judge(df).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in got] == cases
    assert urls.judge(df.limit(0)).count() == 0


def test_automaton_is_glob():
    import fnmatch

    import numpy as np

    rng = random.Random(8)
    globs = [("".join(rng.choice("ab*.") for _ in range(rng.randint(1, 6))), "".join(rng.choice("ab*/") for _ in range(rng.randint(1, 6)))) for _ in range(40)]
    rows = [("".join(rng.choice("ab.") for _ in range(rng.randint(0, 8))), "".join(rng.choice("ab/") for _ in range(rng.randint(0, 8)))) for _ in range(200)]
    data = [f"{h}\n{p}".encode() for h, p in rows]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    got = urls.Automaton(globs).match(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert got.tolist() == [[fnmatch.fnmatchcase(h, a) and fnmatch.fnmatchcase(p, b) for a, b in globs] for h, p in rows]


# --- 10 ------------------------------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark, vocabulary):
    odd = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\|turn|>", "<|end|><|end|>", "[/INST", None, "", "é😀\n", "a" * 5000, "<<SYS>> x <</SYS>>", "\\"]
    rows = [(i // 4, i % 4, ["user", "assistant", None, "system"][i % 4], t, "x") for i, t in enumerate(odd * 3)] + [(0, 1, "assistant", "tie", "x"), (None, 0, "assistant", "null conversation", "x"), (0, None, "user", "null turn", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string").repartition(3)
    got = {r.conv_id: r for r in chat.digests(df, vocabulary).collect()}
    convs = defaultdict(list)
    for c, turn, role, text, _ in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(df.limit(0), vocabulary).count() == 0
    template = chat.Template(vocabulary)
    for r in chat.segments(df, vocabulary).collect():
        import numpy as np

        ids = np.array(r.ids, np.int32)
        assert len(template.turns(ids)) == 1 and template.text(ids).count("<|end|>") == 1 and len(r.loss_mask) == len(ids)


# --- Pipeline ----------------------------------------------------------------------------------------------------------------------------
def test_pipeline(spark, vocabulary):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = [decontam.normalised(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in docs if any(c.isalpha() for c in r.text)]
    first = {}
    for i, t in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    left = [(i, t) for i, t in left if first[re.sub(r"[\x20\x09-\x0D]+", " ", t)] == i]
    keep = {i for i, _, c in brute_components(left) if i == c}
    near = lambda x, t: min(decontam.distances(x, t), default=len(x)) <= int(len(x) * decontam.ERROR_RATE)
    assert all(len(x) >= decontam.MIN_CHARS for x in items)
    want = {i for i, t in left if i in keep and not any(near(x, decontam.normalised(t)) for x in items)}
    known = reference(vocabulary)
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)
    texts = dict(left)
    assert all(r.ids == known.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] and all(f(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, f in corpus_pipeline.STAGES[:-1])


def test_pipeline_edges(spark, docs):
    import corpus_pipeline

    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, now, DATA)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == start.columns, name
            now = spark.createDataFrame(after.collect(), after.schema)
        ids = [r.doc_id for r in now.collect() if r.doc_id is not None]
        assert len(ids) == len(set(ids)) or start is docs
        assert bool(ids) == (start is docs)
