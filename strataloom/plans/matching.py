"""Queries: joins between corpora and passes, and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import match, sets as st, verify
from . import fixtures as fx
from .registry import query

_A, _B = fx.sql_passes("a"), fx.sql_passes("b")


# --- D: joins -----------------------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def positional_take(spark, d):
    return st.only(fx.table(spark, d, "documents").select("doc_id", "text"), "doc_id", fx.table(spark, d, "labels"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (l.doc_id IS NULL) AS unmatched FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_must_match(spark, d):
    return match.match_report(fx.table(spark, d, "documents"), fx.table(spark, d, "labels"), "doc_id")


@query(f"WITH {_A}, {_B} SELECT doc_id, b.status, a.status AS status_first FROM pass_b b JOIN pass_a a USING (doc_id)")
def pair_passes(spark, d):
    a, b = fx.passes(spark, d, "a"), fx.passes(spark, d, "b")
    return match.pair_passes(a, st.only(b, "doc_id", a), "doc_id", ["status"]).select("doc_id", "status", "status_first")


@query(f"WITH {_A}, {_B} SELECT a.status AS status_a, b.status AS status_b, count(*) AS docs, sum(coalesce(a.rewritten_tokens, b.rewritten_tokens))::BIGINT AS tokens FROM pass_a a FULL JOIN pass_b b USING (doc_id) GROUP BY ALL")
def cross_pass(spark, d):
    return match.cross_pass(fx.passes(spark, d, "a"), fx.passes(spark, d, "b"), "doc_id", "status", "rewritten_tokens")


@query(f"WITH {_A}, {_B}, u AS (SELECT *, 'x' AS p FROM pass_a UNION ALL SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'y' END FROM pass_b) SELECT x.doc_id, x.topic, count(*) AS n FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.p = y.p GROUP BY ALL")
def composite_key_match(spark, d):
    a = fx.passes(spark, d, "a").select("doc_id", "topic", F.lit("x").alias("p"))
    b = fx.passes(spark, d, "b").select("doc_id", "topic", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y").alias("p"))
    u = a.unionByName(b)
    return u.join(u.select("doc_id", "p"), ["doc_id", "p"]).groupBy("doc_id", "topic").agg(F.count("*").alias("n"))


@query(f"WITH {_A}, {_B} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.status AS a, b.status AS b FROM pass_a a FULL JOIN pass_b b ON a.doc_id = b.doc_id")
def pivot_prompts(spark, d):
    rows = fx.passes(spark, d, "a").select("doc_id", "status", F.lit("a").alias("p")).unionByName(fx.passes(spark, d, "b").select("doc_id", "status", F.lit("b").alias("p")))
    return match.pivot_prompts(rows, "doc_id", "p", "status", ["a", "b"])


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON substr(b.text, 1, 2) = substr(d.text, 1, 2)")
def prefix_hash_match(spark, d):
    return match.prefix_matches(fx.table(spark, d, "benchmark"), fx.table(spark, d, "documents"), "item_id", "doc_id", "text", 2)


@query("WITH n AS (SELECT item_id, (SELECT count(*) FROM documents d WHERE substr(d.text, 1, 4) = substr(b.text, 1, 4)) AS n FROM benchmark b) SELECT CASE WHEN n > 1 THEN '>1' ELSE n::VARCHAR END AS matches, count(*) AS keys FROM n GROUP BY ALL")
def match_histogram(spark, d):
    return match.match_histogram(fx.table(spark, d, "benchmark"), fx.table(spark, d, "documents"), "item_id", "text", 4)


_REPEATED = "removed AS (SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY substr(text, 1, 200)) AS f FROM documents) WHERE doc_id > f)"


@query(f"WITH {_REPEATED}, k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM removed)) SELECT doc_id, new_id, new_id // 100 AS shard FROM k")
def remove_renumber(spark, d):
    docs = fx.table(spark, d, "documents")
    removed = match.repeated_prefixes(docs, "doc_id", "text", 200)
    return match.remove_renumber(docs.select("doc_id"), "doc_id", removed, fx.SHARD_ROWS).select("doc_id", "new_id", "shard")


@query(f"WITH {fx.SETS}, {_A} SELECT count(*) AS docs, sum(rewritten_tokens)::BIGINT AS tokens FROM pass_a WHERE doc_id IN (SELECT doc_id FROM consensus)")
def semi_join_tokens(spark, d):
    return st.only(fx.passes(spark, d, "a"), "doc_id", fx.sets(fx.alive(spark, d))["consensus"]).agg(F.count("*").alias("docs"), F.sum("rewritten_tokens").alias("tokens"))


_FILES = f"""{fx.POOL}, files AS (SELECT doc_id // 100 AS file, sum(tok)::BIGINT AS size FROM pool GROUP BY 1), placed AS (SELECT file, size, (sum(size) OVER (ORDER BY file))::BIGINT - size AS start FROM files)"""


def _files(spark, d):
    from ..operators.tokens import offsets

    files = fx.pool(spark, d).groupBy(F.floor(F.col("doc_id") / fx.SHARD_ROWS).alias("file")).agg(F.sum("tok").alias("size"))
    return offsets(files, "file", F.col("size")).select("file", "size", "start")


@query(f"WITH {_FILES}, p AS (SELECT range * 997 AS pos FROM range(0, 40)) SELECT pos, file, pos - start AS inside FROM p JOIN placed ON pos >= start AND pos < start + size")
def offset_locate(spark, d):
    points = spark.range(40).select((F.col("id") * 997).alias("pos"))
    return match.locate(points, "pos", _files(spark, d), "start", "size").select("pos", "file", (F.col("pos") - F.col("start")).alias("inside"))


@query(f"WITH {_FILES} SELECT file, start, start + size AS ends FROM placed WHERE greatest(start, 5000) < least(start + size, 40000)")
def interval_overlap(spark, d):
    files = _files(spark, d).withColumn("ends", F.col("start") + F.col("size"))
    return match.overlapping(files, "start", "ends", 5000, 40000).select("file", "start", "ends")


@query(f"WITH {_A}, {_B}, u AS (SELECT doc_id, rewritten FROM pass_b UNION ALL SELECT doc_id, text FROM documents) SELECT a.doc_id, coalesce(bool_or(a.rewritten = u.rewritten), false) AS any_equal FROM pass_a a LEFT JOIN u USING (doc_id) GROUP BY a.doc_id")
def any_equal_rewrite(spark, d):
    originals = fx.passes(spark, d, "b").select("doc_id", "rewritten").unionByName(fx.table(spark, d, "documents").select("doc_id", F.col("text").alias("rewritten")))
    return match.any_equal(fx.passes(spark, d, "a"), originals, "doc_id", "rewritten")


@query(f"WITH {_A}, {_B} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right only' WHEN b.doc_id IS NULL THEN 'left only' ELSE 'different' END AS difference FROM pass_a a FULL JOIN pass_b b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.status <> b.status OR a.rewritten <> b.rewritten")
def tables_equal(spark, d):
    return match.differences(fx.passes(spark, d, "a"), fx.passes(spark, d, "b"), "doc_id", ["status", "rewritten"])


@query(f"WITH {fx.SETS}, {fx.TAGGED} SELECT doc_id, sum(bit)::INTEGER AS bits FROM tagged GROUP BY doc_id")
def membership_matrix(spark, d):
    return st.membership(fx.sets(fx.alive(spark, d)), "doc_id")


@query("WITH c AS (SELECT doc_id, text FROM documents) SELECT doc_id, count(DISTINCT h) AS hashes, count(DISTINCT k) AS n_copies FROM (SELECT doc_id, 1 AS k, sha256(substr(text, 1, 256)) AS h FROM c UNION ALL SELECT doc_id, 2, sha256(substr(CASE WHEN doc_id % 3 = 0 THEN 'x' || text ELSE text END, 1, 256)) FROM c WHERE doc_id % 7 <> 0) GROUP BY doc_id HAVING count(DISTINCT h) > 1 OR count(DISTINCT k) < 2")
def alignment_gate(spark, d):
    a = fx.table(spark, d, "documents").select("doc_id", "text")
    b = a.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    return match.alignment({"a": a, "b": b}, "doc_id", "text")


@query("SELECT * FROM (VALUES ('model.layers', '24', '32', false), ('data.seed', '42', NULL, true), ('run.name', 'a', 'b', true)) t(key, a, b, allowed)")
def config_diff(spark, d):
    a = match.flatten_config({"model": {"layers": 24, "hidden": 64}, "data": {"seed": 42}, "run": {"name": "a"}, "steps": [1, 2]})
    b = match.flatten_config({"model": {"layers": 32, "hidden": 64}, "run": {"name": "b"}, "steps": [1, 2]})
    table = lambda c: spark.createDataFrame(list(c.items()), "key string, value string")
    return match.config_differences(table(a), table(b), ["data.seed", "run.name"])


# --- I, C: text -----------------------------------------------------------------------------------------------------------------------
@query(rf"""WITH {fx.STYLED} SELECT doc_id, regexp_matches(text, '^\s*#{{1,6}}\s') AS heading, regexp_matches(text, '(?m)^\s*(?:[-*+]|\d{{1,3}}[.)])\s+\S') AS list_item,
    regexp_matches(text, '(?i){tx.WEB_WORDS}') AS web FROM styled""")
def style_predicates(spark, d):
    return fx.styled(spark, d).select("doc_id", tx.heading(F.col("text")).alias("heading"), tx.list_item(F.col("text")).alias("list_item"), tx.web_words(F.col("text")).alias("web"))


@query(f"""WITH {fx.STYLED} SELECT doc_id, CASE WHEN starts_with(text, '{tx.LEAK_ANCHOR}') THEN CASE WHEN instr(text, chr(10) || chr(10)) > 0 THEN substr(text, instr(text, chr(10) || chr(10)) + 2) ELSE '' END ELSE text END AS text FROM styled""")
def leak_strip(spark, d):
    return fx.styled(spark, d).select("doc_id", tx.strip_leak(F.col("text")).alias("text"))


_MARK = rf"(regexp_matches({{r}}, '^(?:##|\*\*)') OR regexp_matches(lower({{r}}), '^(?:{tx.OPENERS.replace(chr(39), chr(39) * 2)})'))"


@query(rf"""WITH {fx.STYLED}, p AS (SELECT *, instr(text, chr(10) || chr(10)) AS b, instr(text, chr(10)) AS l FROM styled),
    q AS (SELECT *, regexp_replace(substr(text, 1, b - 1), '^\s+|\s+$', '', 'g') AS hb, regexp_replace(substr(text, 1, l - 1), '^\s+|\s+$', '', 'g') AS hl FROM p)
    SELECT doc_id, CASE WHEN b BETWEEN 1 AND 121 AND (({_MARK.format(r="hb")} AND regexp_matches(lower(hb), '{tx.PREAMBLE_WORDS}')) OR (starts_with(lower(hb), 'paraphrased') AND ends_with(hb, ':'))) THEN substr(text, b + 2)
      WHEN l BETWEEN 1 AND 121 AND regexp_matches(lower(hl), '{tx.PREAMBLE_WORDS}') AND ends_with(hl, ':') AND ({_MARK.format(r="hl")} OR starts_with(lower(hl), 'paraphrased')) THEN ltrim(substr(text, l + 1), chr(10)) ELSE text END AS text FROM q""")
def preamble_strip(spark, d):
    return fx.styled(spark, d).select("doc_id", tx.strip_preamble(F.col("text")).alias("text"))


@query(r"SELECT doc_id, substr(translate(coalesce(text, ''), chr(10) || chr(13), '  '), 1, 100000) AS text FROM documents")
def scorer_clean(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tx.scorer_clean(F.col("text")).alias("text"))


@query(rf"WITH {_A} SELECT doc_id, trim(regexp_replace(rewritten, '\s+', ' ', 'g')) = trim(regexp_replace(text, '\s+', ' ', 'g')) AS same FROM pass_a JOIN documents USING (doc_id)")
def ws_equal(spark, d):
    both = fx.passes(spark, d, "a").join(fx.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return both.select("doc_id", (tx.squeezed(F.col("rewritten")) == tx.squeezed(F.col("text"))).alias("same"))


@query(f"""WITH {_A}, p AS (SELECT doc_id, least(length(rewritten), length(text)) AS n, list_position(list_transform(list_zip(string_split(rewritten, ''), string_split(text, ''), true), lambda x: x[1] = x[2]), false) AS f
    FROM pass_a JOIN documents USING (doc_id)) SELECT doc_id, coalesce(f - 1, n)::BIGINT AS pos FROM p""")
def first_diff(spark, d):
    both = fx.passes(spark, d, "a").join(fx.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return both.select("doc_id", tx.first_difference(F.col("rewritten"), F.col("text")).cast("long").alias("pos"))


@query()
def similarity(spark, d):
    both = fx.passes(spark, d, "a").join(fx.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return both.select("doc_id", F.round(tx.similarity(F.col("rewritten"), F.col("text")), 6).alias("ratio"))


_LOG = r"'iteration: ' || event_id || ' / 9000 | consumed_tokens: ' || (event_id % 977)::VARCHAR || ['', 'K', 'M', 'B', 'T'][(event_id % 5 + 1)::INTEGER] || ' | lr: 1'"


@query(rf"""WITH l AS (SELECT event_id, {_LOG} AS line FROM events) SELECT event_id, regexp_extract(line, 'iteration:\s*(\d+)', 1)::BIGINT AS iteration,
    regexp_extract(line, 'consumed_tokens:\s*([\d.]+)([KMBT]?)', 1)::DOUBLE * CASE regexp_extract(line, 'consumed_tokens:\s*([\d.]+)([KMBT]?)', 2) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'T' THEN 1e12 ELSE 1 END AS tokens FROM l""")
def log_scrape(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ["", "K", "M", "B", "T"])), (F.col("event_id") % 5 + 1).cast("int"))
    line = F.concat(F.lit("iteration: "), "event_id", F.lit(" / 9000 | consumed_tokens: "), F.col("event_id") % 977, unit, F.lit(" | lr: 1"))
    iteration, tokens = tx.log_iteration(line)
    return fx.table(spark, d, "events").select("event_id", iteration.alias("iteration"), tokens.alias("tokens"))


_DURATIONS = [("90", 5400), ("5:30", 330), ("1:02:03", 3723), ("2-3", 183600), ("1-2:30", 95400), ("0-0:0:59", 59)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {s}::BIGINT)" for t, s in _DURATIONS) + ") v(t, seconds)")
def duration_parse(spark, d):
    return spark.createDataFrame([(t,) for t, _ in _DURATIONS], "t string").select("t", tx.duration_seconds(F.col("t")).alias("seconds"))


@query(rf"""WITH {_A}, w AS (SELECT doc_id, rewritten, rewritten_tokens, text, len(regexp_extract_all(text, '\S+')) AS tok, list_distinct(list_filter(regexp_split_to_array(lower(rewritten), '[^A-Za-z0-9_]+'), lambda x: x <> '')) AS o,
      list_distinct(list_filter(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+'), lambda x: x <> '')) AS i FROM pass_a JOIN documents USING (doc_id)),
    f AS (SELECT doc_id, CASE WHEN len(o) = 0 THEN false ELSE len(list_intersect(o, i)) / len(o) > 0.9 END AS format_only, rewritten_tokens < 20 AND tok > 200 AS short, rewritten FROM w),
    k AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, substr(rewritten, k + 1, 50) AS s, count(*) AS n FROM (SELECT doc_id, rewritten, unnest(range(0, greatest(length(rewritten) - 49, 0), 10)) AS k FROM f) GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, format_only, coalesce(n >= 5, false) AS repetition, short FROM f LEFT JOIN k USING (doc_id)""")
def quality_flags(spark, d):
    both = fx.passes(spark, d, "a").join(fx.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    a, b = F.col("text"), F.col("rewritten")
    return both.select("doc_id", tx.copies_input(a, b).alias("format_only"), tx.repeats(b).alias("repetition"), tx.too_short(F.col("rewritten_tokens"), tx.word_count(a)).alias("short"))


@query("SELECT doc_id, 'Rewrite: ' || text || ' END' AS prompt, length(text) AS chars, ['x', 'y', 'z', 'w'][(" + fx.sql_h("assign") + " % 4 + 1)::INTEGER] AS style FROM documents")
def style_assign(spark, d):
    style = F.element_at(F.array(*map(F.lit, "xyzw")), (fx.h("assign", F.col("doc_id")) % 4 + 1).cast("int"))
    return fx.table(spark, d, "documents").select("doc_id", F.replace(F.lit("Rewrite: [TEXT] END"), F.lit("[TEXT]"), F.col("text")).alias("prompt"), F.length("text").cast("long").alias("chars"), style.alias("style"))


@query(r"""SELECT doc_id, regexp_extract_all('{{NAME}} and {{' || upper(lang) || '}} {{low}}', '\{\{([A-Z0-9_]+)\}\}', 1) AS slots FROM documents""")
def placeholder_scan(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tx.placeholders(F.concat(F.lit("{{NAME}} and {{"), F.upper("lang"), F.lit("}} {{low}}"))).alias("slots"))


# --- N: leakage and corpus verification ---------------------------------------------------------------------------------------------
@query(rf"""WITH {fx.STYLED}, r AS (SELECT source, count(*) AS docs, avg(regexp_matches(text, '^\s*#{{1,6}}\s')::INT) AS heading, avg(regexp_matches(text, '(?m)^\s*(?:[-*+]|\d{{1,3}}[.)])\s+\S')::INT) AS list_item,
    avg(regexp_matches(text, '(?i){tx.WEB_WORDS}')::INT) AS web FROM styled GROUP BY source) SELECT a.source AS a, b.source AS b, round(abs(a.heading - b.heading) + abs(a.list_item - b.list_item) + abs(a.web - b.web), 6) AS l1 FROM r a JOIN r b ON a.source < b.source""")
def leakage_style(spark, d):
    return verify.style_distance(verify.style_rates(fx.styled(spark, d), "text", "source"), "source").select("a", "b", F.round("l1", 6).alias("l1"))


@query("WITH f AS (SELECT source AS name, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source) SELECT name, CASE WHEN name = 'src1' THEN 'unknown' WHEN name = 'src2' THEN 'different' ELSE 'ok' END AS state FROM f")
def registry_check(spark, d):
    found = fx.table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    registry = found.where("name <> 'src1'").withColumn("docs", F.when(F.col("name") == "src2", -1).otherwise(F.col("docs")))
    return verify.registry_check(found, registry, "name", ["docs", "chars"])


@query(f"WITH {fx.POOL}, {_A} SELECT 1 AS stage, count(*) AS docs, sum(tok)::BIGINT AS tokens FROM pool UNION ALL SELECT 2, count(*), sum(rewritten_tokens)::BIGINT FROM pass_a UNION ALL SELECT 3, count(*), sum(rewritten_tokens)::BIGINT FROM pass_a WHERE status = 2")
def funnel(spark, d):
    a = fx.passes(spark, d, "a").select(F.col("rewritten_tokens").alias("tok"), "status")
    parts = [fx.pool(spark, d).select("tok"), a.select("tok"), a.where("status = 2").select("tok")]
    rows = [p.agg(F.lit(i + 1).alias("stage"), F.count("*").alias("docs"), F.sum("tok").alias("tokens")) for i, p in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
