"""Queries: corpus and export checks, digests, token folders, replays, and round trips through sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import digests, hashing, scores as sc
from ..functions.text import word_count
from ..operators import audit, domains, match, prefix, samplers, sets as st
from ..operators import tokens as tk
from ..operators.rank import average_rank_pct
from ..session import materialised, shared_folder
from ..sources import io
from . import fixtures as fx
from .datapath import TOKENS, _docs, walked_sentences
from .registry import query
from .selection import BUDGET


def _le(key: str) -> str:
    """Hex of a non-negative long's bytes, least first."""
    h = f"lpad(to_hex({key}), 16, '0')"
    return " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(8))


# --- Digests ------------------------------------------------------------------------------------------------------------------------
@query(f"""WITH {fx.ALIVE}, c AS (SELECT doc_id, len, {fx.SUM} AS cum FROM alive), f AS (SELECT doc_id, cum FROM c WHERE cum - len < {BUDGET})
    SELECT 'set' AS kind, count(*) AS n, sha256(unhex(string_agg({_le("doc_id")}, '' ORDER BY doc_id))) AS digest FROM f UNION ALL SELECT 'order', count(*), sha256(unhex(string_agg({_le("doc_id")}, '' ORDER BY cum))) FROM f""")
def set_digest(spark, d):
    """Digests of a selection as a set and in its order, over little-endian longs."""
    filled = prefix.budget_fill(fx.alive(spark, d), "q", "tie", "len", BUDGET)
    parts = {"set": digests.id_digest(filled, "doc_id"), "order": digests.id_digest(filled, "doc_id", "cum")}
    return parts["set"].select(F.lit("set").alias("kind"), "*").unionByName(parts["order"].select(F.lit("order").alias("kind"), "*"))


@query("SELECT count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(text) || chr(10), '' ORDER BY doc_id)) AS digest FROM documents WHERE text IS NOT NULL")
def rolling_digest(spark, d):
    docs = fx.table(spark, d, "documents").where("text is not null")
    return digests.rolling_digest(docs, "doc_id", F.sha2("text", 256))


@query("""WITH t AS (SELECT source AS name, sha256(array_to_string(list_sort(list(n_chars::VARCHAR)), ',')) AS sha256 FROM documents GROUP BY source)
    SELECT name, sha256 FROM t UNION ALL SELECT '*', sha256(string_agg(name || ':' || sha256 || chr(10), '' ORDER BY name)) FROM t""")
def named_digests(spark, d):
    return digests.named_digest(fx.table(spark, d, "documents"), "source", F.col("n_chars"))


@query("SELECT url, (('0x' || substr(sha256(url), 1, 15))::BIGINT % 100000000) AS h FROM pages WHERE url IS NOT NULL")
def name_hashes(spark, d):
    return fx.table(spark, d, "pages").where("url is not null").select("url", hashing.name_hash(F.col("url")).alias("h"))


# --- Checks ----------------------------------------------------------------------------------------------------------------------------
@query(f"""WITH {fx.ALIVE}, c AS (SELECT doc_id, len, {fx.SUM} AS cum FROM alive), f AS (SELECT * FROM c WHERE cum - len < {BUDGET}),
    x AS (SELECT 'docs' AS name, count(*)::VARCHAR AS found FROM f UNION ALL SELECT 'tokens', sum(len)::BIGINT::VARCHAR FROM f UNION ALL SELECT 'docset_sha256', sha256(unhex(string_agg({_le("doc_id")}, '' ORDER BY doc_id))) FROM f)
    SELECT name, found, found AS expected, true AS ok FROM x""")
def selection_gate(spark, d):
    """A selection against an independent run of it, by another operator: sizes and the byte-exact id set must agree, or this raises."""
    df = fx.alive(spark, d)
    first = prefix.budget_fill(df, "q", "tie", "len", BUDGET)
    again = prefix.chained_fill(df, "q", "tie", "len", [BUDGET])
    return audit.gate(audit.compared(audit.selection_facts(first, "doc_id", "len"), audit.selection_facts(again, "doc_id", "len")))


@query(f"""WITH {fx.ALIVE}, c AS (SELECT doc_id, len, {fx.SUM} AS cum FROM alive), f AS (SELECT * FROM c WHERE cum - len < {BUDGET}), p AS (SELECT doc_id, len, row_number() OVER (ORDER BY {fx.sql_h("shuffle")}, doc_id) - 1 AS planned FROM f),
    e AS (SELECT doc_id, planned AS place, len FROM p WHERE planned % 50 <> 7 UNION ALL SELECT doc_id, planned, len FROM p WHERE planned % 50 = 9)
    SELECT (SELECT count(*) FROM e) AS n_rows, (SELECT count(*) FROM p WHERE planned % 50 = 9) AS repeated, (SELECT count(*) FROM p WHERE planned % 50 = 7) AS missing, 0 AS excess, (SELECT sum(len)::BIGINT FROM e) AS tokens,
      true AS order_as_planned, (SELECT arg_min(doc_id, place) <> (SELECT min(doc_id) FROM p) FROM e) AS order_differs_from_ids, (SELECT count(*) FROM p WHERE planned % 40 = 3 AND planned % 50 <> 7) AS wrong_texts""")
def export_check(spark, d):
    """An export with faults put in: rows left out, repeated, and of another text."""
    df = fx.alive(spark, d)
    texts = fx.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    planned = io.seeded_order(prefix.budget_fill(df, "q", "tie", "len", BUDGET).select("doc_id"), "doc_id").withColumnRenamed("pos", "planned")
    rows = planned.join(texts, "doc_id").withColumn("text", F.when(F.col("planned") % 40 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumnRenamed("planned", "at")
    export = rows.where("at % 50 <> 7").unionByName(rows.where("at % 50 = 9"))
    return audit.export_report(export, planned, df.select("doc_id", "len").join(texts, "doc_id"), "doc_id", "at", "planned", "len", "text")


@query(f"WITH {fx.POOL} SELECT count(*) AS n_rows, 0 AS off_by_ranks, 0 AS off_by_counts FROM pool")
def percentile_check(spark, d):
    ranked = materialised(average_rank_pct(fx.pool(spark, d).select("doc_id", "s3"), "s3", "recorded"))
    return audit.percentile_check(ranked, "s3", "recorded").drop("worst")


_CORPUS = f"""{fx.HELD}, {fx.sql_passes("a")}, corpus AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'anchor' ELSE 'strategy' END AS part, CASE WHEN doc_id % 30 IN (3, 4) THEN text || ' ' ELSE text END AS text FROM documents
      WHERE doc_id % 3 = 0 OR {fx.sql_h("strategy")} % 4 = 0), own AS (SELECT doc_id, text AS pool_text FROM documents)"""


@query(rf"""WITH {_CORPUS}, arms AS (SELECT part AS arm, text FROM corpus UNION ALL SELECT 'rewritten', rewritten FROM pass_a),
    r AS (SELECT arm, avg(regexp_matches(text, '^\s*#{{1,6}}\s')::INT) AS h, avg(regexp_matches(text, '(?m)^\s*(?:[-*+]|\d{{1,3}}[.)])\s+\S')::INT) AS l, avg(regexp_matches(text, '(?i){fx.WEB_WORDS}')::INT) AS w, median(len(regexp_extract_all(text, '\S+'))) AS m FROM arms GROUP BY arm),
    g AS (SELECT abs(s.h - a.h) + abs(s.l - a.l) + abs(s.w - a.w) AS sa, abs(x.h - a.h) + abs(x.l - a.l) + abs(x.w - a.w) AS xa, s.m <> x.m AS differ FROM r s, r a, r x WHERE s.arm = 'strategy' AND a.arm = 'anchor' AND x.arm = 'rewritten'),
    e AS (SELECT 'provenance' AS "check", count(*) AS errors FROM corpus WHERE part = 'strategy' AND doc_id IN (SELECT doc_id FROM held)
      UNION ALL SELECT 'anchor', count(*) FROM corpus JOIN own USING (doc_id) WHERE part = 'anchor' AND text <> pool_text
      UNION ALL SELECT 'hashes', count(*) FROM corpus JOIN own USING (doc_id) LEFT JOIN pass_a USING (doc_id) WHERE part = 'strategy' AND doc_id % 2 = 0 AND (text <> pool_text OR rewritten IS NULL OR rewritten = text)
      UNION ALL SELECT 'style', CASE WHEN sa <= xa THEN 0 ELSE 1 END FROM g UNION ALL SELECT 'lengths', CASE WHEN differ THEN 0 ELSE 1 END FROM g)
    SELECT "check", errors, errors = 0 AS passed FROM e""")
def leakage_checks(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    part = F.when(F.col("doc_id") % 3 == 0, "anchor").otherwise("strategy")
    text = F.when((F.col("doc_id") % 30).isin(3, 4), F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    corpus = docs.select("doc_id", part.alias("part"), text.alias("text")).where((F.col("part") == "anchor") | (fx.h("strategy", F.col("doc_id")) % 4 == 0))
    rewrites = fx.passes(spark, d, "a").select("doc_id", F.col("rewritten").alias("text"))
    return audit.leakage_checks(corpus, docs, rewrites, fx.holdout(docs), "doc_id", "text", "part", F.col("doc_id") % 2 == 0, word_count(F.col("text")))


@query("SELECT count(DISTINCT '/tok|' || lang || '|2') AS \"values\", bool_and(lang = 'en') AS as_expected FROM documents")
def one_tokenizer(spark, d):
    lines = fx.table(spark, d, "documents").select(F.concat(F.lit("/tok|"), "lang", F.lit("|2")).alias("line"))
    return audit.one_value(lines, "line", "/tok|en|2")


@query(f"""WITH {fx.SETS}, p AS (SELECT 'shared' AS part, doc_id FROM top1 UNION ALL SELECT 'quality', doc_id FROM top2) SELECT part, count(*) AS docs, sum(len)::BIGINT AS tokens, {BUDGET} AS target, sum(len) >= {BUDGET} AS reached,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM top1) AND doc_id IN (SELECT doc_id FROM top2)) AS shared FROM p JOIN alive USING (doc_id) GROUP BY part""")
def base_assembly(spark, d):
    df = fx.alive(spark, d)
    chosen = fx.sets(df)
    parts = {n: st.only(df, "doc_id", chosen[c]) for n, c in (("shared", "top1"), ("quality", "top2"))}
    return audit.assembly_report(parts, dict.fromkeys(parts, BUDGET), "doc_id", "len")


@query("""WITH f AS (SELECT source, n_chars * 2 AS bytes, n_chars + CASE WHEN source = 'src1' AND doc_id % 5 = 0 THEN 1 ELSE 0 END AS said FROM documents), t AS (SELECT source AS folder, count(*) AS shards, sum(bytes)::BIGINT // 2 AS by_size, sum(said)::BIGINT AS by_metadata FROM f GROUP BY source)
    SELECT *, by_size = by_metadata AS same FROM t""")
def file_totals(spark, d):
    said = F.col("n_chars") + F.when((F.col("source") == "src1") & (F.col("doc_id") % 5 == 0), 1).otherwise(0)
    files = fx.table(spark, d, "documents").select(F.col("source").alias("folder"), (F.col("n_chars") * 2).alias("bytes"), said.alias("said"))
    return audit.file_totals(files, "folder", "bytes", "said")


@query(f"WITH {fx.SETS} SELECT 'top1 in alive' AS test, true AS holds UNION ALL SELECT 'top1 in consensus', (SELECT count(*) FROM top1 WHERE doc_id NOT IN (SELECT doc_id FROM consensus)) = 0")
def subset_tests(spark, d):
    df = fx.alive(spark, d)
    s = fx.sets(df)
    return spark.createDataFrame([("top1 in alive", st.subset(s["top1"], df, "doc_id")), ("top1 in consensus", st.subset(s["top1"], s["consensus"], "doc_id"))], "test string, holds boolean")


@query(f"WITH {fx.SETS} SELECT doc_id, 'selected' AS source FROM consensus UNION ALL SELECT doc_id, 'anchor' FROM held")
def concat_tagged(spark, d):
    df = fx.alive(spark, d)
    return st.concat_exclusive({"selected": fx.sets(df)["consensus"], "anchor": fx.holdout(fx.table(spark, d, "documents"))}, "doc_id").select("doc_id", "source")


# --- Orders ------------------------------------------------------------------------------------------------------------------------------
@query(f"""WITH {fx.POOL}, c AS (SELECT doc_id, tok, (sum(tok + 1) OVER (ORDER BY s3::DOUBLE DESC, doc_id // 100, doc_id % 100 ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM pool) SELECT doc_id, cum FROM c WHERE cum - tok - 1 < {BUDGET}""")
def stable_fill(spark, d):
    """A fill by score whose ties keep the order of the input, which is a column: file, then row."""
    df = fx.pool(spark, d).withColumns({"file": F.floor(F.col("doc_id") / 100), "row": F.col("doc_id") % 100, "len": F.col("tok") + 1})
    return prefix.budget_fill(df, "s3", ["file", "row"], "len", BUDGET).select("doc_id", "cum")


@query("SELECT doc_id, greatest(16, ceil(2.0 * n_chars * 1000000 * 4.0 / (0.55 * 4294967296)))::BIGINT AS buckets FROM documents")
def bucket_sizing(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", io.choose_buckets(F.col("n_chars") * 1_000_000, F.lit(1 << 32)).alias("buckets"))


_BUCKETED = f"row_number() OVER (ORDER BY {fx.sql_h('bucket')} % {{b}}, {fx.sql_h('inside')}, doc_id)"


@query(" UNION ALL ".join(f"SELECT {b} AS buckets, count(*) FILTER (a <> b) AS misplaced FROM (SELECT {_BUCKETED.format(b=7)} AS a, {_BUCKETED.format(b=b)} AS b FROM documents)" for b in (4, 7, 16)))
def shuffle_replay(spark, d):
    """Which bucket count made a published order, from ids alone."""
    docs = fx.table(spark, d, "documents").select("doc_id")
    order = lambda b: io.bucketed_order(F.col("doc_id"), b)
    published = prefix.numbered(docs.withColumns(dict(zip(("b", "p"), order(7), strict=True))), ["b", "p", "doc_id"], "pos").select("doc_id", "pos")
    return audit.replayed(published, "doc_id", "pos", {b: order(b) for b in (4, 7, 16)})


@query(f"""WITH s AS (SELECT doc_id % 3 AS ds, doc_id // 3 AS ds_sample FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY {fx.sql_h("index", "ds || ':' || ds_sample")}, ds, ds_sample) - 1 AS place, count(*) OVER () AS n FROM s)
    SELECT k * n + place AS pos, ds, ds_sample FROM o, range(0, 3) r(k) WHERE k * n + place < (SELECT count(*) * 5 // 2 FROM documents)""")
def parallel_index(spark, d):
    docs = fx.table(spark, d, "documents")
    samples = docs.select((F.col("doc_id") % 3).alias("ds"), F.floor(F.col("doc_id") / 3).alias("ds_sample"))
    return io.parallel_index(samples, "ds", "ds_sample", docs.count() * 5 // 2)


@query("SELECT DISTINCT doc_id // 100 AS shard, doc_id // 100 % 4 AS worker FROM documents WHERE doc_id // 100 % 3 <> 0")
def worker_shards(spark, d):
    shards = fx.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("shard")).distinct()
    return io.worker_shards(shards, "shard", 4, shards.where("shard % 3 = 0"))


# --- Token folders ---------------------------------------------------------------------------------------------------------------------
_FILES = f"""{TOKENS}, f AS (SELECT file, sum(len(ids))::BIGINT AS tokens FROM docs GROUP BY file), w AS (SELECT *, tokens // 65 AS wins, (sum(tokens // 65) OVER (ORDER BY file))::BIGINT AS upto FROM f),
    k AS (SELECT file, tokens, least(greatest(8 - (upto - wins), 0), wins) AS skipped, upto - wins AS before, wins FROM w), folder AS (SELECT file, tokens, skipped, greatest(least(wins - skipped, 153 - greatest(before - 8, 0)), 0) AS windows FROM k)"""


def _folder(spark, d):
    files = _docs(spark, d).groupBy("file").agg(F.sum(F.size("ids")).alias("tokens"))
    return io.folder_files(files, "file", "tokens", 64, skip_tokens=500, max_tokens=10_000)


@query(f"WITH {_FILES} SELECT file, tokens, skipped, windows FROM folder WHERE windows > 0")
def folder_files(spark, d):
    return _folder(spark, d)


@query(f"""WITH {_FILES}, o AS (SELECT *, (sum(windows) OVER (ORDER BY {fx.sql_h("files", "file")}, file))::BIGINT AS ends, (SELECT sum(windows)::BIGINT FROM folder) AS n FROM folder WHERE windows > 0)
    SELECT item, item // n AS epoch, file, item % n - (ends - windows) + skipped AS "window" FROM range(0, 500) r(item), o WHERE item % n >= ends - windows AND item % n < ends""")
def folder_items(spark, d):
    """Items of an endless folder whose files are shuffled: wrapped at its end."""
    return io.folder_items(spark.range(500).withColumnRenamed("id", "item"), "item", materialised(_folder(spark, d)), "file", shuffle="files")


@query(f"""WITH RECURSIVE {walked_sentences("120 - doc_id % 9", "total >= want AND rest >= 2 AND size >= 2")}
    SELECT doc_id, first::INTEGER AS first, (k + 1)::INTEGER AS end, (row_number() OVER (ORDER BY doc_id, first) - 1)::BIGINT AS block FROM step WHERE done AND k >= 0""")
def block_mapping(spark, d):
    docs = fx.table(spark, d, "documents")
    sizes = docs.select("doc_id", F.transform(F.split("text", r"\.\s"), lambda s: word_count(s).cast("int")).alias("sizes"), (F.col("doc_id") % 9).cast("int").alias("title"))
    return tk.block_spans(sizes, "doc_id", "sizes", "title", 120)


# --- Round trips ---------------------------------------------------------------------------------------------------------------------------
def _new(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


@query("SELECT doc_id, text FROM documents")
def parquet_glob(spark, d):
    return io.read_parquet(spark, d, ["doc_id", "text"], glob="documents*.parquet")


@query(f"WITH {TOKENS} SELECT doc_id, ids FROM docs")
def token_file_roundtrip(spark, d):
    path = _new(spark, "tokens")
    io.write_token_files(_docs(spark, d), "doc_id", "ids", path, "stand-in", 2, max_tokens=20_000)
    return io.read_token_files(spark, path).select("doc_id", "ids")


@query(f"WITH {TOKENS} SELECT doc_id, ids[4:8] AS ids FROM docs")
def indexed_slices(spark, d):
    return io.get_slice(_docs(spark, d).select("doc_id", "ids"), "ids", 3, 5)


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def csv_roundtrip(spark, d):
    docs, path = fx.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), _new(spark, "csv")
    io.write_csv(docs, path)
    return spark.read.schema(docs.schema).option("header", True).csv(path)


@query(f"WITH {fx.SCORES} SELECT setting, seed, epoch, metric, value FROM scores")
def result_tree(spark, d):
    """Results written as a tree of JSON files, one a cell, and read back with their checks."""
    path, cell = _new(spark, "results"), F.struct("setting", "seed", "epoch", F.lit(0).cast("long").alias("step"))
    cells = fx.scores(spark, d).groupBy("setting", "seed", "epoch").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    folder = F.concat_ws("/", "setting", F.concat(F.lit("seed"), "seed"), F.concat(F.lit("epoch"), "epoch"))
    rows = cells.select(F.lit("v1").alias("schema"), cell.alias("cell"), F.lit(True).alias("complete"), F.create_map(F.lit("task"), "m").alias("tasks"), folder.alias("folder"))
    rows.write.partitionBy("folder").json(path)
    return io.read_results(spark, path, "v1").select("setting", "seed", "epoch", "metric", "value")


@query("SELECT 1003 AS n")
def placeholder(spark, d):
    return io.placeholder(spark, 1003).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, (3.0 * (16 * (2.0 * (doc_id % 4096 + 1) * 1024 * (16 + 2 * 4) * 64 + 4.0 * 16 * (doc_id % 4096 + 1) * (doc_id % 4096 + 1) * 64 + 2.0 * (doc_id % 4096 + 1) * 16 * 64 * 1024 + 6.0 * (doc_id % 4096 + 1) * 1024 * 4096) + 2.0 * (doc_id % 4096 + 1) * 1024 * 32000))::DOUBLE AS flops FROM documents")
def decoder_flops(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", sc.decoder_flops(16, 1024, 16, 4, 32000, (F.col("doc_id") % 4096 + 1).cast("double"), 4096).alias("flops"))


# --- Smaller pieces ------------------------------------------------------------------------------------------------------------------------
@query("SELECT DISTINCT doc_id // 100 AS shard, 3::BIGINT AS \"row\", n_chars FROM documents WHERE doc_id % 100 = 3")
def address_take(spark, d):
    docs = fx.table(spark, d, "documents")
    wanted = docs.where("doc_id % 100 = 3").select(F.floor(F.col("doc_id") / 100).alias("shard"), F.lit(3).cast("long").alias("row"))
    return match.take(wanted, "shard", "row", docs, "doc_id", 100, ["n_chars"])


@query("SELECT mbs, dp, CASE WHEN 1024 % (mbs * dp) = 0 THEN 1024 // (mbs * dp) END AS accum, round(3 * n_chars * 1000.0 / 2097152)::BIGINT AS steps FROM (SELECT doc_id % 5 + 1 AS mbs, doc_id % 4 + 1 AS dp, n_chars FROM documents)")
def step_arithmetic(spark, d):
    rows = fx.table(spark, d, "documents").select((F.col("doc_id") % 5 + 1).alias("mbs"), (F.col("doc_id") % 4 + 1).alias("dp"), "n_chars")
    return rows.select("mbs", "dp", sc.accumulation(F.lit(1024), F.col("mbs"), F.col("dp")).alias("accum"), sc.training_steps(F.col("n_chars") * 1000, 3).alias("steps"))


@query(r"SELECT doc_id, length(text) AS chars, round(len(regexp_extract_all(text, '\S+')) / nullif(length(text), 0), 6) AS tokens_a_char FROM documents")
def token_density(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.length("text").cast("long").alias("chars"), F.round(word_count(F.col("text")) / F.nullif(F.length("text"), F.lit(0)), 6).alias("tokens_a_char"))


@query("SELECT setting, seed, epoch, shard, suffix FROM (SELECT 's' || user_id % 4 AS setting, event_id % 3 AS seed, event_id // 3 % 2 AS epoch, event_id % 1000 AS shard, event_type AS suffix FROM events)")
def path_labels(spark, d):
    """Labels made into paths and parsed back."""
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    e = fx.table(spark, d, "events")
    path = F.concat(F.lit("/r/s"), F.col("user_id") % 4, F.lit("/seed"), F.col("event_id") % 3, F.lit("/epoch"), F.floor(F.col("event_id") / 3) % 2, F.lit("/part-"), F.lpad((F.col("event_id") % 1000).cast("string"), 5, "0"), F.lit("."), F.col("event_type"))
    rows = e.select(path.alias("path"))
    return rows.select(part("/r/(s[0-9]+)/").alias("setting"), part("/seed([0-9]+)/").cast("long").alias("seed"), part("/epoch([0-9]+)/").cast("long").alias("epoch"), part("part-0*([0-9]+)[.]").cast("long").alias("shard"), part("[.]([^./]+)$").alias("suffix"))


@query("SELECT 0 AS repeated, (SELECT count(*) FROM documents) AS samples")
def rank_batches(spark, d):
    """No sample of a strided deal is read by two ranks, and none is left out."""
    n = fx.table(spark, d, "documents").count()
    dealt = samplers.strided(spark, n, 4)
    by = dealt.groupBy("sample").agg(F.countDistinct("rank").alias("n"))
    return by.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count("*").alias("samples"))


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents")
def total_order(spark, d):
    df = fx.table(spark, d, "documents").select("doc_id", "n_chars")
    ranked = prefix.running_sum(df.withColumn("one", F.lit(1)), "n_chars", "doc_id", "one", "pos")
    return ranked.select("doc_id", "n_chars", (F.col("pos") - 1).alias("pos"))


@query("WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), h AS (SELECT source, n, 1 AS step FROM g UNION ALL SELECT source, n * n, 2 FROM g) SELECT source, step, round(n / sum(n) OVER (PARTITION BY step), 6) AS weight FROM h")
def weight_history(spark, d):
    by = fx.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    weights = lambda c: domains.count_weights(by.select("source", c.alias("n")), "n").select("source", F.round("weight", 6).alias("weight"))
    first = domains.with_history(None, weights(F.col("n") + 1), 2)
    return domains.with_history(domains.with_history(first, weights(F.col("n")), 1), weights(F.col("n") * F.col("n")), 2).select("source", "step", "weight")
