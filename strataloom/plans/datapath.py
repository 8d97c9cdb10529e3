"""Queries: token windows, sample indexes, blends, samplers, supervised examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import blend, samplers, tokens as tk
from ..session import materialised
from ..sources import io
from . import fixtures as fx
from .registry import query

SEQ = 64


def _docs(spark, d):
    """doc_id, file, ids: stand-in tokens with an end token, by file of 100 documents. A tokenised corpus is a table."""
    docs = fx.table(spark, d, "documents")
    return materialised(docs.select("doc_id", F.floor(F.col("doc_id") / fx.SHARD_ROWS).alias("file"), tk.with_eos(tk.stand_in_ids(F.col("text"))).alias("ids")))


_WORDS = r"regexp_extract_all(text, '\S+')"
_IDS = f"list_transform({_WORDS}, lambda w: (('0x' || substr(md5(w), 1, 7))::BIGINT % 32000)::INTEGER)"
TOKENS = f"""docs AS (SELECT doc_id, doc_id // 100 AS file, CASE WHEN len({_WORDS}) > 0 THEN list_append({_IDS}, 2) ELSE []::INTEGER[] END AS ids FROM documents),
    flat AS (SELECT file, doc_id, unnest(ids) AS id, unnest(range(0, len(ids))) AS k FROM docs), stream AS (SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY doc_id, k) - 1 AS pos FROM flat)"""


@query(f"WITH {TOKENS} SELECT doc_id, len(ids)::BIGINT AS n, list_sum(ids)::BIGINT AS total, list_aggregate(ids, 'last')::BIGINT AS last FROM docs")
def tokenise_eos(spark, d):
    ids = F.col("ids")
    return _docs(spark, d).select("doc_id", F.size(ids).cast("long").alias("n"), F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.element_at(ids, -1).cast("long").alias("last"))


@query("WITH e AS (SELECT doc_id, lang, greatest(length(text), 0) AS n FROM documents) SELECT doc_id, (SELECT coalesce(sum(e2.n), 0)::BIGINT FROM e e2 WHERE e2.doc_id < e.doc_id) AS start, n AS len FROM e")
def doc_offsets(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return tk.offsets(docs, "doc_id", F.col("n")).select("doc_id", "start", "len")


@query(f"WITH {TOKENS} SELECT file, pos // {SEQ + 1} AS win, list(id ORDER BY pos) AS input_ids FROM stream GROUP BY ALL HAVING count(*) = {SEQ + 1}")
def pack_windows(spark, d):
    return tk.pack_windows(_docs(spark, d), "doc_id", "ids", SEQ, "file").select("file", "win", "input_ids")


@query(f"WITH {TOKENS}, w AS (SELECT s.file, n.win, id, pos FROM stream s, LATERAL (SELECT unnest([pos // {SEQ}, pos // {SEQ} - 1]) AS win) n WHERE n.win >= 0 AND pos - n.win * {SEQ} BETWEEN 0 AND {SEQ}) SELECT file, win, list(id ORDER BY pos) AS input_ids FROM w GROUP BY ALL HAVING count(*) = {SEQ + 1}")
def group_texts(spark, d):
    return tk.group_texts(_docs(spark, d), "doc_id", "ids", SEQ, "file").select("file", "win", "input_ids")


@query(f"""WITH {TOKENS}, p AS (SELECT doc_id, len(ids) AS n, (sum(len(ids)) OVER (ORDER BY doc_id))::BIGINT - len(ids) AS start FROM docs), t AS (SELECT (sum(n) - 1) // {SEQ} AS samples FROM p), s AS (SELECT range AS sample FROM range(0, 1000000), t WHERE range <= samples)
    SELECT sample::BIGINT AS sample, doc_id, (sample * {SEQ} - start)::BIGINT AS pos FROM s JOIN p ON sample * {SEQ} >= start AND sample * {SEQ} < start + n""")
def sample_index(spark, d):
    docs = _docs(spark, d).withColumn("n", F.size("ids").cast("long"))
    return tk.sample_index(docs, "doc_id", "n", SEQ).select("sample", "doc_id", F.col("offset").alias("pos"))


@query(f"""WITH {TOKENS}, g AS (SELECT id, row_number() OVER (ORDER BY file, pos) - 1 AS pos FROM stream), w AS (SELECT n.win, id, pos FROM g, LATERAL (SELECT unnest([pos // {SEQ}, pos // {SEQ} - 1]) AS win) n WHERE n.win >= 0 AND pos - n.win * {SEQ} BETWEEN 0 AND {SEQ})
    SELECT win, sum(id * (pos % 97))::BIGINT AS mark FROM w GROUP BY win HAVING count(*) = {SEQ + 1}""")
def fetch_samples(spark, d):
    rows = tk.fetch_samples(_docs(spark, d), "doc_id", "ids", SEQ)
    mark = F.aggregate(F.transform("input_ids", lambda x, i: x.cast("long") * ((F.col("win") * SEQ + i) % 97)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("win", mark.alias("mark"))


@query("SELECT * FROM (VALUES (1000, 64, 100, 7), (1000, 64, 10, 1), (999, 10, 500, 6)) t(tokens, seq, samples, epochs)")
def num_epochs(spark, d):
    cases = [(1000, 64, 100), (1000, 64, 10), (999, 10, 500)]
    return spark.createDataFrame([(*c, tk.num_epochs(*c)) for c in cases], "tokens int, seq int, samples int, epochs int")


@query("SELECT * FROM (VALUES ('969,30,1', 1000, 0, 969, 999, 1000), ('0.8/0.1/0.1', 7, 0, 5, 6, 7)) t(splits, size, b0, b1, b2, b3)")
def split_bounds(spark, d):
    cases = [("969,30,1", 1000), ("0.8/0.1/0.1", 7)]
    return spark.createDataFrame([(s, n, *tk.split_bounds(s, n)) for s, n in cases], "splits string, size int, b0 int, b1 int, b2 int, b3 int")


@query("SELECT i AS ds, w / 10.0::DOUBLE AS weight, ceil(200 * (w / 10.0::DOUBLE) * 1.005)::BIGINT AS samples FROM (VALUES (0, 1), (1, 5), (2, 3), (3, 1)) t(i, w)")
def weighted_counts(spark, d):
    weights = [1.0, 5.0, 3.0, 1.0]
    rows = zip(range(4), blend.normalised(weights), blend.sample_counts(weights, 200), strict=True)
    return spark.createDataFrame(list(rows), "ds int, weight double, samples long")


_GREEDY = """WITH RECURSIVE b(pos, ds, ds_sample, n) AS (SELECT -1, -1, -1, [0, 0, 0, 0] UNION ALL
    SELECT pos + 1, x.d, n[x.d + 1], list_transform(n, lambda v, i: CASE WHEN i = x.d + 1 THEN v + 1 ELSE v END) FROM b, LATERAL (SELECT arg_max(d, (e, -d)) AS d FROM (SELECT d, w * greatest(b.pos + 1, 1) - b.n[d + 1] AS e FROM (VALUES (0, 0.1::DOUBLE), (1, 0.5::DOUBLE), (2, 0.3::DOUBLE), (3, 0.1::DOUBLE)) t(d, w))) x WHERE pos < 19)
    SELECT pos::BIGINT AS pos, ds::INTEGER AS ds, (ds_sample % [8, 2, 5, 5][ds + 1])::BIGINT AS ds_sample FROM b WHERE pos >= 0"""
_GOLDEN_DS = [1, 2, 0, 1, 3, 1, 2, 1, 2, 1, 0, 1, 2, 1, 3, 1, 2, 1, 2, 1]
_GOLDEN_SAMPLE = [0, 0, 0, 1, 0, 0, 1, 1, 2, 0, 1, 1, 3, 0, 1, 1, 4, 0, 0, 1]


@query(f"SELECT unnest(range(0, 20))::BIGINT AS pos, unnest({_GOLDEN_DS}) AS ds, unnest({_GOLDEN_SAMPLE})::BIGINT AS ds_sample")
def greedy_blend(spark, d):
    return blend.greedy(spark, [0.1, 0.5, 0.3, 0.1], [8, 2, 5, 5], 20)


@query(f"""WITH b AS (SELECT * FROM (VALUES (0, 1, 0.2::DOUBLE, 37), (1, 5, 0.5::DOUBLE, 11), (2, 3, 0.3::DOUBLE, 23)) t(ds, x, w, n)), bins AS (SELECT ds, n, row_number() OVER (ORDER BY ds, k) - 1 AS bin, k AS bias, count(*) OVER (PARTITION BY ds) AS size FROM b, LATERAL (SELECT unnest(range(0, (w * 20)::INTEGER)) AS k))
    SELECT range AS pos, ds, ((bias + (range // 20) * size) % n)::BIGINT AS ds_sample FROM range(0, 500) JOIN bins ON range % 20 = bin""")
def bin_blend(spark, d):
    return blend.bin_blend(spark, [0.2, 0.5, 0.3], [37, 11, 23], 500, 20)


_LARGEST = f"""c AS (SELECT * FROM (VALUES (0, 33, 20), (1, 17, 50), (2, 51, 7)) t(ds, c, n)), r AS (SELECT ds, n, k, {fx.sql_h("blend", "ds || ':' || k")} AS h FROM c, LATERAL (SELECT unnest(range(0, c)) AS k)),
    lr AS (SELECT row_number() OVER (ORDER BY h) - 1 AS pos, ds, (row_number() OVER (PARTITION BY ds ORDER BY h) - 1) % n AS ds_sample FROM r)"""


@query(f"WITH {_LARGEST} SELECT pos, ds, ds_sample::BIGINT AS ds_sample FROM lr")
def largest_remainder(spark, d):
    return blend.largest_remainder(spark, [0.33, 0.165, 0.505], [20, 50, 7], 101)


@query(f"WITH {_LARGEST} SELECT pos, ds, (ds_sample + CASE ds WHEN 0 THEN 1000 // {SEQ} WHEN 2 THEN 700 // {SEQ} ELSE 0 END)::BIGINT AS ds_sample FROM lr")
def stage_offset(spark, d):
    consumed = spark.createDataFrame([(0, 400), (0, 600), (2, 700)], "ds int, tokens long")
    return blend.stage_offset(blend.largest_remainder(spark, [0.33, 0.165, 0.505], [20, 50, 7], 101), consumed, SEQ)


@query(f"WITH {_LARGEST} SELECT ds, count(*) * {SEQ} AS tokens FROM lr WHERE pos >= 10 AND pos < 60 GROUP BY ds")
def consumption(spark, d):
    return blend.consumption(blend.largest_remainder(spark, [0.33, 0.165, 0.505], [20, 50, 7], 101), 10, 60, SEQ)


@query("SELECT range AS step, CASE WHEN range < 30 THEN 'warm' WHEN range < 70 THEN 'main' ELSE 'cool' END AS stage, CASE WHEN range < 30 THEN 30 - range WHEN range < 70 THEN 70 - range END AS remaining FROM range(0, 100)")
def stage_switch(spark, d):
    return blend.stage_of(spark.range(100).select(F.col("id").alias("step")), "step", [("warm", 0), ("main", 30), ("cool", 70)])


@query("WITH a AS (SELECT source AS ds, count(*) AS available FROM documents GROUP BY source) SELECT s.ds, 50 AS needed, available, coalesce(available >= 50, false) AS enough FROM (SELECT DISTINCT source AS ds FROM documents) s LEFT JOIN (SELECT * FROM a WHERE ds <> 'src1') USING (ds)")
def capacity_check(spark, d):
    docs = fx.table(spark, d, "documents")
    available = docs.groupBy(F.col("source").alias("ds")).agg(F.count("*").alias("available"))
    return blend.capacity(docs.select(F.col("source").alias("ds")).distinct().withColumn("needed", F.lit(50)), available.where("ds <> 'src1'"))


@query(f"""WITH d AS (SELECT doc_id FROM documents), e AS (SELECT doc_id, epoch, {fx.sql_h("epoch", "epoch || ':' || doc_id")} AS h FROM d, range(0, 3) r(epoch)) SELECT row_number() OVER (ORDER BY epoch = 2, h) - 1 AS pos, epoch::INTEGER AS epoch, doc_id FROM e""")
def epoch_doc_order(spark, d):
    docs = fx.table(spark, d, "documents")
    return tk.epoch_order(docs, "doc_id", 3, True, fx.h("epoch", F.col("epoch"), F.col("doc_id")))


# --- J: arrays of a window -----------------------------------------------------------------------------------------------------------
@query(f"""WITH {TOKENS}, w AS (SELECT file, pos // {SEQ + 1} AS win, pos % {SEQ + 1} AS nth, id, count(*) OVER (PARTITION BY file, pos // {SEQ + 1}) AS n FROM stream), q AS (SELECT *, coalesce(max(CASE WHEN id = 2 THEN nth END) OVER (PARTITION BY file, win ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS sep FROM w WHERE n = {SEQ + 1})
    SELECT file, win, list((nth - sep - 1)::INTEGER ORDER BY nth) AS positions, list(nth - sep - 1 <> 0 ORDER BY nth) FILTER (nth > 0) AS label_mask FROM q GROUP BY ALL""")
def doc_mask(spark, d):
    rows = tk.pack_windows(_docs(spark, d), "doc_id", "ids", SEQ, "file").withColumn("positions", tk.positions(F.col("input_ids")))
    return rows.select("file", "win", "positions", tk.document_mask(F.col("positions")).alias("label_mask"))


@query("""WITH p AS (SELECT doc_id, list_transform(range(0, 24), lambda i: (i % (3 + doc_id % 5))::INTEGER) AS positions FROM documents)
    SELECT doc_id, list_append(list_transform(list_filter(range(0, 24), lambda i: positions[i + 1] = 0), lambda i: i::INTEGER), 24) AS starts, positions[13:24] AS slice_1, positions[1:23] AS inputs, positions[2:24] AS labels, list_concat(positions[1:20], [-1, -1, -1]) AS padded FROM p""")
def window_arrays(spark, d):
    docs = fx.table(spark, d, "documents")
    p = docs.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: (i % (3 + F.col("doc_id") % 5)).cast("int")).alias("positions"))
    c = F.col("positions")
    inputs, labels = tk.shifted(c)
    return p.select("doc_id", tk.segment_starts(c).alias("starts"), tk.rank_slice(c, 1, 2).alias("slice_1"), inputs.alias("inputs"), labels.alias("labels"), tk.padded(F.slice(c, 1, 20), 23).alias("padded"))


# --- Supervised examples ----------------------------------------------------------------------------------------------------------------
def _pairs(spark, d):
    c = fx.table(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    rows = user.join(reply, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", tk.stand_in_ids(F.col("prompt")).alias("p"), tk.stand_in_ids(F.col("completion")).alias("c"))


_SFT = f"""s AS (SELECT u.conv_id, u.turn, {_IDS.replace("text", "u.text")} AS p, {_IDS.replace("text", "a.text")} AS c FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
    t AS (SELECT conv_id, turn, list_concat(p, c, [2])[1:65] AS w, least(len(p), 65) AS pl FROM s)"""


@query(f"""WITH {_SFT} SELECT conv_id, turn, list_concat(w, list_transform(range(len(w), 65), lambda i: 0::INTEGER)) AS input_ids, list_transform(range(0, 65), lambda i: CASE WHEN i < len(w) THEN i ELSE -1 END::INTEGER) AS position_ids, list_transform(range(0, 65), lambda i: i >= pl AND i < len(w)) AS label_mask FROM t""")
def sft_build(spark, d):
    return tk.supervised(_pairs(spark, d), "p", "c", 64).select("conv_id", "turn", "input_ids", "position_ids", "label_mask")


@query(f"WITH {_SFT} SELECT conv_id, turn FROM t WHERE len(w) > 0 AND pl < len(w)")
def sft_valid_filter(spark, d):
    rows = tk.supervised(_pairs(spark, d), "p", "c", 64)
    return rows.where(tk.valid_example(F.col("position_ids"), F.col("label_mask"))).select("conv_id", "turn")


@query(f"""WITH RECURSIVE {_SFT}, r AS (SELECT conv_id, turn, len(p)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM s),
    b AS (SELECT conv_id, turn, k, 0::BIGINT AS bin, 0::BIGINT AS bin_offset, n AS used FROM r WHERE k = 1
        UNION ALL SELECT r.conv_id, r.turn, r.k, CASE WHEN used > 0 AND used + n > 128 THEN bin + 1 ELSE bin END, CASE WHEN used > 0 AND used + n > 128 THEN 0 ELSE used END, CASE WHEN used > 0 AND used + n > 128 THEN n ELSE used + n END
        FROM b JOIN r ON r.conv_id = b.conv_id AND r.k = b.k + 1)
    SELECT conv_id, turn, bin, bin_offset FROM b""")
def sft_packing(spark, d):
    rows = _pairs(spark, d).select("conv_id", "turn", F.size("p").alias("n"))
    return tk.pack_examples(rows, "turn", "n", 128, "conv_id")


def walked_sentences(want: str, stop: str) -> str:
    """CTEs that walk each document's sentences in order: step(doc_id, k, first, want, done), with sentence k the last of a span where
    done. want: a span's target by doc_id and first; stop: whether it ends at k, by total, want, rest (sentences left) and size (of the span)."""
    return f"""split AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\.\\s'), lambda s: len(regexp_extract_all(s, '\\S+'))) AS sizes FROM documents WHERE text IS NOT NULL),
    one AS (SELECT doc_id, unnest(sizes) AS n, unnest(range(0, len(sizes))) AS k, len(sizes) AS count FROM split WHERE len(sizes) >= 2 AND list_max(sizes) <= 512),
    step AS (SELECT DISTINCT doc_id, -1::BIGINT AS k, 0::BIGINT AS first, 0::BIGINT AS want, 0::BIGINT AS total, true AS done FROM one
        UNION ALL SELECT doc_id, k, first, want, total, rest = 0 OR ({stop}) FROM (SELECT *, k + 1 - first AS size, {want} AS want FROM (
            SELECT one.doc_id, one.k, CASE WHEN done THEN one.k ELSE first END AS first, one.n + CASE WHEN done THEN 0 ELSE total END AS total, count - one.k - 1 AS rest FROM step JOIN one ON one.doc_id = step.doc_id AND one.k = step.k + 1)))"""


_HASH = "('0x' || substr(md5('span:' || doc_id || ':' || first), 1, 8))::BIGINT"


@query(f"""WITH RECURSIVE {walked_sentences(f"CASE WHEN ({_HASH} >> 8) % 1000 < 100 THEN 2 + {_HASH} % 119 ELSE 120 END", "total >= want AND rest > 1 AND size >= 2")}
    SELECT doc_id, first::INTEGER AS first, (k + 1)::INTEGER AS end, want::INTEGER AS target FROM step WHERE done AND k >= 0""")
def span_mapping(spark, d):
    docs = fx.table(spark, d, "documents")
    sizes = docs.select("doc_id", F.transform(F.split("text", r"\.\s"), lambda s: word_count(s).cast("int")).alias("sizes"))
    return tk.sentence_spans(sizes, "doc_id", "sizes", 120)


_FIM = lambda salt: f"(('0x' || substr(md5('fim{salt}:' || doc_id), 1, 8))::BIGINT % 1000000) / 1000000.0::DOUBLE"


@query(f"""WITH f AS (SELECT doc_id, text, {_FIM(0)} AS h0, floor({_FIM(1)} * (length(text) + 1))::INTEGER AS a, floor({_FIM(2)} * (length(text) + 1))::INTEGER AS b, {_FIM(3)} AS h3 FROM documents), c AS (SELECT *, substr(text, 1, least(a, b)) AS head, substr(text, least(a, b) + 1, abs(a - b)) AS mid, substr(text, greatest(a, b) + 1) AS tail FROM f)
    SELECT doc_id, CASE WHEN h0 < 0.5 THEN CASE WHEN h3 < 0.5 THEN '<PRE><SUF>' || tail || '<MID>' || head || mid ELSE '<PRE>' || head || '<SUF>' || tail || '<MID>' || mid END ELSE text END AS text FROM c""")
def fim(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tk.fill_in_middle(F.col("text"), F.col("doc_id"), 0.5).alias("text"))


# --- M: samplers ---------------------------------------------------------------------------------------------------------------------------
@query("SELECT range AS sample, (range - 40) // 12 AS micro_batch, (range - 40) % 12 // 4 AS rank FROM range(40, 40 + (1003 - 40) // 12 * 12)")
def sequential_sampler(spark, d):
    return samplers.sequential(spark, 1003, 40, 4, 3)


@query("WITH a AS (SELECT 0::INTEGER AS epoch, range AS sample, range // 332 AS rank FROM range(0, 996)) SELECT epoch, sample, rank, (sample - rank * 332 - 40) // 4 AS micro_batch FROM a WHERE sample - rank * 332 >= 40")
def cyclic_sampler(spark, d):
    return samplers.cyclic(spark, 1003, 120, 4, 3)


@query(f"WITH a AS (SELECT 1 AS epoch, range AS sample, range // 332 AS rank, row_number() OVER (PARTITION BY range // 332 ORDER BY {fx.sql_h('sampler', chr(39) + '1:' + chr(39) + ' || range')}) AS n FROM range(0, 996)) SELECT epoch, sample, rank, (n - 1 - 8) // 4 AS micro_batch FROM a WHERE n > 8")
def random_sampler(spark, d):
    return samplers.random_buckets(spark, 1003, 996 + 24, 4, 3)


@query("SELECT range AS slot, range % 1003 AS sample, range % 4 AS rank FROM range(0, 1004)")
def strided_sampler(spark, d):
    return samplers.strided(spark, 1003, 4, wrap=True)


@query("SELECT range AS slot, range % 1003 AS sample, range % 4 AS rank FROM range(0, 1003) WHERE range >= 100 // 4")
def resume_skip(spark, d):
    return samplers.skip(samplers.strided(spark, 1003, 4), "slot", 100, 4)


@query("SELECT doc_id, n_chars // 12 AS full_batches, (n_chars + 11) // 12 AS all_batches FROM documents")
def batch_counts(spark, d):
    n = F.col("n_chars")
    return fx.table(spark, d, "documents").select("doc_id", samplers.batches(n, 4, 3).alias("full_batches"), samplers.batches(n, 4, 3, False).alias("all_batches"))


_DOMS = "(VALUES (0, 6, 0, 100), (1, 13, 6, 300), (2, 1, 19, 40)) t(domain, c, s, n)"


@query(f"SELECT step, (s + k) // 5 AS rank, domain, step * c + k AS sample FROM {_DOMS}, range(0, 16) a(step), LATERAL (SELECT unnest(range(0, c)) AS k)")
def domain_batches(spark, d):
    return samplers.domain_batches(spark, [0.3, 0.665, 0.035], [100, 300, 40], 20, 4)


@query("SELECT range AS sample, list_transform(range(0, 33), lambda i: ((('0x' || substr(md5('42:token:' || range || ':' || i), 1, 15))::BIGINT) % 32000)::INTEGER) AS input_ids FROM range(0, 100)")
def synthetic_tokens(spark, d):
    return io.synthetic(spark, 100, 32, 32000)


@query("WITH p AS (SELECT 0 AS part, doc_id, n_chars AS size FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 1, doc_id, n_chars FROM documents WHERE doc_id % 2 = 1) SELECT part, doc_id, size, (sum(size) OVER (ORDER BY part, doc_id))::BIGINT - size AS pointer FROM p")
def merge_indexed(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"))
    return io.merge_indexed([docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")], "doc_id", "size")


@query(f"WITH {TOKENS}, f AS (SELECT file, sum(len(ids))::BIGINT AS tokens FROM docs GROUP BY file) SELECT file, tokens, tokens // {SEQ + 1} AS windows, (coalesce(sum(tokens // {SEQ + 1}) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first FROM f")
def file_windows(spark, d):
    files = _docs(spark, d).groupBy("file").agg(F.sum(F.size("ids")).alias("tokens"))
    return tk.file_windows(files, "file", "tokens", SEQ)
