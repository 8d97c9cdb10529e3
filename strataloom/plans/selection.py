"""Queries: scores, filters, ranks, budget fills, sets and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators import distribution as ds
from ..operators import match, prefix, rank, sets as st
from ..session import materialised
from ..sources import io
from . import fixtures as fx
from .registry import query

r6 = lambda c, n: F.round(c, 6).alias(n)
BUDGET = 30_000


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus budget selection, summarised by stratum."""
    filled = prefix.budget_fill(fx.alive(spark, sf_dir), "q", "tie", "len", BUDGET)
    return filled.groupBy("topic").agg(F.count("*").alias("docs"), F.sum("len").alias("tokens"), r6(F.min(F.col("q").cast("double")), "least_q"))


# --- A, B: scans and expressions --------------------------------------------------------------------------------------------------
@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def scan_project(spark, d):
    return io.read_parquet(spark, f"{d}/documents.parquet", ["doc_id", "lang", "n_chars"]).where("lang = 'en' and n_chars > 500")


@query("SELECT * FROM documents")
def jsonl_roundtrip(spark, d):
    return io.jsonl_roundtrip(fx.table(spark, d, "documents"))


@query(f"""WITH a AS (SELECT 'docs' AS dataset, doc_id AS id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS t FROM documents),
    b AS (SELECT 'convs' AS dataset, conv_id AS id, row_number() OVER (ORDER BY conv_id) AS n, count(*) OVER () AS t FROM (SELECT DISTINCT conv_id FROM conversations)),
    u AS (SELECT dataset, id FROM a WHERE n <= floor(0.25 * t) UNION ALL SELECT dataset, id FROM b WHERE n <= floor(0.5 * t))
    SELECT dataset, id, row_number() OVER (ORDER BY {fx.sql_h("mix", "dataset || ':' || id")}) - 1 AS pos FROM u""")
def dataset_mix(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    convs = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return io.mix({"docs": (docs, 0.25), "convs": (convs, 0.5)}, "id")


@query(f"""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY {fx.sql_h("shuffle")}) - 1 AS pos, count(*) OVER () AS n FROM documents)
    SELECT doc_id, pos, (pos // ((n + 15) // 16))::BIGINT AS file_no FROM s""")
def ordered_export_plan(spark, d):
    return io.file_plan(io.seeded_order(fx.table(spark, d, "documents").select("doc_id"), "doc_id"), "pos", 16)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {fx.sql_h('shuffle')}) - 1 AS pos FROM documents")
def seeded_shuffle(spark, d):
    return io.seeded_order(fx.table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT source, 'new/tok|' || regexp_extract(line, '[^|]*$') AS line, count(*) AS n FROM (SELECT source, '/a/b|' || lang || '|' || (2 + 2 * (doc_id % 2)) AS line FROM documents) GROUP BY ALL")
def metadata_rewrite(spark, d):
    docs = fx.table(spark, d, "documents").select("source", F.concat(F.lit("/a/b|"), "lang", F.lit("|"), 2 + 2 * (F.col("doc_id") % 2)).alias("line"))
    return io.rewrite_metadata(docs, "line", "new/tok").groupBy("source", "line").agg(F.count("*").alias("n"))


@query(f"WITH {fx.POOL} SELECT doc_id, tok, tok + 1 AS train_tokens FROM pool")
def train_tokens(spark, d):
    return fx.pool(spark, d).select("doc_id", "tok", sc.train_length(F.col("tok")).alias("train_tokens"))


@query(f"WITH {fx.RANKED} SELECT doc_id, round(r1::DOUBLE, 6) AS r1, round(r2::DOUBLE, 6) AS r2, round(r3::DOUBLE, 6) AS r3, round(q::DOUBLE, 6) AS q FROM ranked")
def consensus_q(spark, d):
    return fx.ranked(spark, d).select("doc_id", *[r6(F.col(c).cast("double"), c) for c in ("r1", "r2", "r3", "q")])


@query(f"WITH {fx.RANKED} SELECT doc_id, round(v::DOUBLE, 6) AS v FROM ranked")
def disagreement_v(spark, d):
    return fx.ranked(spark, d).select("doc_id", r6(F.col("v").cast("double"), "v"))


@query(f"WITH {fx.RANKED} SELECT doc_id, round((q + 0.5::FLOAT * sqrt(v)::FLOAT)::DOUBLE, 6) AS u FROM ranked")
def utility_u(spark, d):
    return fx.ranked(spark, d).select("doc_id", r6(sc.utility(F.col("q"), F.col("v"), F.lit(0.5)).cast("double"), "u"))


@query("SELECT doc_id, doc_id // 100 AS shard, doc_id % 100 AS at, 'f' || (doc_id // 100) || ':r' || (doc_id % 100) AS label, doc_id AS back FROM documents")
def shard_address(spark, d):
    shard, at = sc.address(F.col("doc_id"), fx.SHARD_ROWS)
    rows = fx.table(spark, d, "documents").select("doc_id", shard.alias("shard"), at.alias("at"))
    rows = rows.withColumn("label", F.concat(F.lit("f"), "shard", F.lit(":r"), "at"))
    return rows.withColumn("back", F.regexp_extract("label", r"f(\d+):r(\d+)", 1).cast("long") * fx.SHARD_ROWS + F.regexp_extract("label", r"f(\d+):r(\d+)", 2).cast("long"))


@query("SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM documents")
def dictionary_encode(spark, d):
    return match.dense_code(fx.table(spark, d, "documents").select("doc_id", "source"), "source", "code")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'anchor' ELSE 'strategy' END AS part, 'wrap_' || lang AS source_prompt, text FROM documents")
def conditional_relabel(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "anchor").otherwise("strategy").alias("part"), F.concat(F.lit("wrap_"), "lang").alias("source_prompt"), "text")


@query("""SELECT step, round((CASE WHEN step <= 20 THEN 0.003 * step / 20 WHEN step < 50 THEN 0.003 WHEN step < 150 THEN 0.0003 + 0.0027 * (1 + cos(pi() * (step - 50) / 100)) / 2 ELSE 0.0003 END) / 0.003, 6) AS cosine,
    round((CASE WHEN step <= 20 THEN 0.003 * step / 20 WHEN step < 50 THEN 0.003 WHEN step < 150 THEN 0.0003 + 0.0027 * (1 - (step - 50) / 100) ELSE 0.0003 END) / 0.003, 6) AS linear,
    round((CASE WHEN step <= 20 THEN 0.003 * step / 20 WHEN step < 50 THEN 0.003 WHEN step < 150 THEN 0.0003 + 0.0027 * (1 - sqrt((step - 50) / 100)) ELSE 0.0003 END) / 0.003, 6) AS one_sqrt FROM range(0, 200) r(step)""")
def lr_schedule(spark, d):
    step = F.col("step")
    rate = lambda style: sc.learning_rate(step, 0.003, 0.0003, 20, 50, 100, style)
    return spark.range(200).select(F.col("id").alias("step")).select("step", r6(rate("cosine"), "cosine"), r6(rate("linear"), "linear"), r6(rate("1-sqrt"), "one_sqrt"))


@query("""WITH x AS (SELECT doc_id, (n_chars - 900)::DOUBLE / 1000 + 0.0001 AS x FROM documents)
    SELECT doc_id, round(x * 100, 6) AS points, CASE WHEN printf('%+.2f', x) = '-0.00' THEN '+0.00' ELSE printf('%+.2f', x) END AS signed FROM x""")
def formatted_points(spark, d):
    x = (F.col("n_chars") - 900).cast("double") / 1000 + 0.0001
    return fx.table(spark, d, "documents").select("doc_id", r6(sc.points(x), "points"), sc.signed(x).alias("signed"))


@query("SELECT doc_id, round(n_chars::DOUBLE / sum(n_chars) OVER (), 9) AS weight FROM documents")
def normalised_weights(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.round(F.col("n_chars") / prefix.total(docs, "n_chars"), 9).alias("weight"))


# --- C: filters ---------------------------------------------------------------------------------------------------------------------
@query(f"WITH {fx.HELD} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM held)")
def exclude_holdout(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    return st.exclude(docs, "doc_id", fx.holdout(docs))


@query(f"WITH {fx.HELD}, shared AS (SELECT doc_id FROM documents WHERE {fx.sql_h('shared')} % 5 = 0) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM held) AND doc_id NOT IN (SELECT doc_id FROM shared)")
def exclude_multi(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    return st.exclude(docs, "doc_id", fx.holdout(docs), docs.where(fx.h("shared", F.col("doc_id")) % 5 == 0))


@query(f"""WITH {fx.RANKED} SELECT doc_id FROM ranked WHERE q::DOUBLE >= (SELECT quantile_cont(q::DOUBLE, 0.3) FROM ranked) AND v::DOUBLE <= (SELECT quantile_cont(v::DOUBLE, 0.9) FROM ranked)""")
def percentile_constraint(spark, d):
    df = materialised(fx.ranked(spark, d).select("doc_id", "q", "v"))
    at = lambda c, p: rank.percentiles_by(df, c, [p]).select(F.get("p", F.lit(0))).scalar()
    return df.where((F.col("q").cast("double") >= at("q", 0.3)) & (F.col("v").cast("double") <= at("v", 0.9))).select("doc_id")


@query(f"WITH {fx.sql_passes('a')} SELECT doc_id, CASE WHEN rewritten_tokens > 400 THEN 0 ELSE status END AS status FROM pass_a WHERE status = 2 OR rewritten_tokens > 400")
def over_length(spark, d):
    rows = fx.passes(spark, d, "a").where("status = 2 or rewritten_tokens > 400")
    return rows.select("doc_id", F.when(F.col("rewritten_tokens") > 400, 0).otherwise(F.col("status")).alias("status"))


# --- F: fills, ranks -------------------------------------------------------------------------------------------------------------------
@query(f"WITH {fx.ALIVE}, c AS (SELECT doc_id, q, len, {fx.SUM} AS cum FROM alive) SELECT doc_id, round(q::DOUBLE, 6) AS q, cum FROM c WHERE cum - len < {BUDGET}")
def budget_fill(spark, d):
    return prefix.budget_fill(fx.alive(spark, d), "q", "tie", "len", BUDGET).select("doc_id", r6(F.col("q").cast("double"), "q"), "cum")


@query(f"""WITH {fx.ALIVE}, c AS (SELECT doc_id, len, {fx.SUM} AS cum FROM alive), e1 AS (SELECT max(cum) AS e FROM c WHERE cum - len < {BUDGET}),
    e2 AS (SELECT max(cum) AS e FROM c, e1 WHERE cum - len < e1.e + {BUDGET}) SELECT doc_id, cum, CASE WHEN cum <= e1.e THEN 1 ELSE 2 END AS stage FROM c, e1, e2 WHERE cum <= e2.e""")
def chained_fill(spark, d):
    return prefix.chained_fill(fx.alive(spark, d), "q", "tie", "len", [BUDGET, BUDGET]).select("doc_id", "cum", "stage")


@query(f"""WITH {fx.ALIVE}, c AS (SELECT doc_id, len, (sum(len) OVER (ORDER BY {fx.sql_h("random")} ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM alive) SELECT doc_id, cum FROM c WHERE cum - len < {BUDGET}""")
def random_fill(spark, d):
    return prefix.budget_fill(fx.alive(spark, d).withColumn("h", fx.h("random", F.col("doc_id"))), None, "h", "len", BUDGET).select("doc_id", "cum")


@query(f"""WITH {fx.ALIVE}, t AS (SELECT topic, sum(len) AS t FROM alive GROUP BY topic), c AS (SELECT a.*, {BUDGET} * t.t // (SELECT sum(len) FROM alive) AS quota,
      (sum(len) OVER (PARTITION BY topic ORDER BY {fx.ORDER} ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM alive a JOIN t USING (topic)),
    p1 AS (SELECT doc_id, topic, len, cum, 1 AS pass FROM c WHERE cum - len < quota), miss AS (SELECT {BUDGET} - coalesce(sum(len), 0) AS m FROM p1),
    rest AS (SELECT doc_id, topic, len, (sum(len) OVER (ORDER BY {fx.ORDER} ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM c WHERE cum - len >= quota)
    SELECT doc_id, topic, cum, pass FROM p1 UNION ALL SELECT doc_id, topic, cum, 2 FROM rest, miss WHERE m > 0 AND cum - len < m""")
def quota_fill(spark, d):
    return prefix.quota_fill(fx.alive(spark, d), "topic", "q", "tie", "len", BUDGET).select("doc_id", "topic", "cum", "pass")


@query(f"""WITH {fx.ALIVE}, s AS (SELECT *, ({fx.sql_h("src")} % 2)::INTEGER AS src, 8000 AS quota FROM alive), c AS (SELECT *, (sum(len) OVER (PARTITION BY topic ORDER BY src, {fx.ORDER} ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM s)
    SELECT doc_id, topic, src, cum FROM c WHERE cum - len < quota""")
def topup_fill(spark, d):
    df = fx.alive(spark, d).withColumns({"src": (fx.h("src", F.col("doc_id")) % 2).cast("int"), "quota": F.lit(8000)})
    return prefix.topup_fill(df, ["topic"], "src", "q", "tie", "len", "quota").select("doc_id", "topic", "src", "cum")


@query(f"WITH {fx.SETS} SELECT doc_id FROM top1")
def top_decile_tokens(spark, d):
    return prefix.top_share(fx.alive(spark, d), "s1", "tie", "len", 0.1).select("doc_id")


_LAMBDAS = [0.0, 0.5, 1.0]


@query(f"""WITH {fx.ALIVE}, l AS (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS lam), u AS (SELECT lam, doc_id, len, tie, (q + lam::FLOAT * sqrt(v)::FLOAT) AS u FROM alive, l),
    c AS (SELECT *, row_number() OVER w - 1 AS pos, (sum(len) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM u WINDOW w AS (PARTITION BY lam ORDER BY u::DOUBLE DESC, tie))
    SELECT lam, doc_id, pos, cum - len < {BUDGET} AS selected FROM c""")
def lambda_grid(spark, d):
    grid = F.explode(F.array(*map(F.lit, _LAMBDAS)))
    rows = fx.alive(spark, d).withColumn("lambda", grid).withColumn("u", sc.utility(F.col("q"), F.col("v"), F.col("lambda")))
    ranked = prefix.running_sum(rows, "u", "tie", "len", "cum", ["lambda"], rank="n")
    return ranked.select(F.col("lambda").alias("lam"), "doc_id", (F.col("n") - 1).alias("pos"), (F.col("cum") - F.col("len") < BUDGET).alias("selected"))


@query(f"""WITH {fx.ALIVE}, c AS (SELECT *, {fx.SUM} AS cum FROM alive), f AS (SELECT * FROM c WHERE cum - len < {BUDGET}), x AS (SELECT min(q) AS last FROM f)
    SELECT (SELECT count(*) FROM f) AS docs, (SELECT sum(len)::BIGINT FROM f) AS tokens, round(last::DOUBLE, 6) AS last_score, (SELECT count(*) FROM alive WHERE q = last) AS cluster_docs,
    (SELECT count(*) FROM f WHERE q = last) AS cluster_selected, (SELECT doc_id FROM c WHERE cum - len >= {BUDGET} ORDER BY cum LIMIT 1) AS next_key FROM x""")
def boundary_report(spark, d):
    df = fx.alive(spark, d)
    out = prefix.boundary(prefix.budget_fill(df, "q", "tie", "len", BUDGET), df, "doc_id", "q", "tie", "len")
    return out.withColumn("last_score", F.round(F.col("last_score").cast("double"), 6))


@query(f"WITH {fx.POOL} SELECT doc_id, round(((rank() OVER (ORDER BY s3) + (count(*) OVER (PARTITION BY s3) - 1) / 2.0)::DOUBLE / count(*) OVER ())::FLOAT::DOUBLE, 6) AS pct FROM pool")
def avg_rank_pct(spark, d):
    return rank.average_rank_pct(fx.pool(spark, d), "s3", "pct").select("doc_id", r6(F.col("pct").cast("double"), "pct"))


@query(f"""WITH {fx.POOL}, ref AS (SELECT s3 FROM pool WHERE doc_id % 2 = 0), n AS (SELECT count(*) AS n FROM ref)
    SELECT doc_id, round((((SELECT count(*) FROM ref WHERE ref.s3 < p.s3) + (SELECT count(*) FROM ref WHERE ref.s3 <= p.s3) + 1)::DOUBLE / 2 / n)::FLOAT::DOUBLE, 6) AS pct FROM pool p, n WHERE doc_id % 2 = 1""")
def rank_vs_reference(spark, d):
    df = fx.pool(spark, d)
    return rank.rank_against(df.where("doc_id % 2 = 1"), "s3", df.where("doc_id % 2 = 0"), "s3", "pct").select("doc_id", r6(F.col("pct").cast("double"), "pct"))


@query(f"WITH {fx.SCORES} SELECT setting, seed, epoch, metric, (rank() OVER (PARTITION BY metric, epoch, seed ORDER BY value DESC) + (count(*) OVER (PARTITION BY metric, epoch, seed, value) - 1) / 2.0)::DOUBLE AS r FROM scores")
def tie_ranks(spark, d):
    return rank.group_average_rank(fx.scores(spark, d), ["metric", "epoch", "seed"], "value", "r").select("setting", "seed", "epoch", "metric", "r")


@query(f"""WITH {fx.RANKED}, g AS (SELECT s3, min(r3) AS lo, max(r3) AS hi FROM ranked GROUP BY s3), l AS (SELECT *, lag(hi) OVER (ORDER BY s3) AS p FROM g)
    SELECT count(*) AS distinct_raw, bool_and(lo = hi) AS equal_raw_equal_pct, bool_and(p IS NULL OR lo >= p) AS non_decreasing, count(*) FILTER (lo > p) AS strict_increases FROM l""")
def tie_validation(spark, d):
    return rank.tie_validation(fx.ranked(spark, d), "s3", "r3")


@query(f"WITH {fx.POOL}, c AS (SELECT s3, count(*) AS n FROM pool GROUP BY s3) SELECT arg_min(n, s3) AS at_min, arg_max(n, s3) AS at_max, max(n) AS largest, count(*) AS distinct_values FROM c")
def tie_cluster(spark, d):
    return rank.tie_cluster(fx.pool(spark, d), "s3")


@query("SELECT count(*) AS n, min(doc_id) AS low, max(doc_id) AS high, count(DISTINCT doc_id) AS n_distinct, min(doc_id) = 0 AND max(doc_id) = count(*) - 1 AND count(DISTINCT doc_id) = count(*) AS contiguous FROM documents")
def contiguity(spark, d):
    from ..operators.verify import contiguity as check

    return check(fx.table(spark, d, "documents"), "doc_id")


@query(f"WITH {fx.POOL} (SELECT 'short' AS side, doc_id, tok FROM pool WHERE tok > 0 ORDER BY tok, doc_id LIMIT 3) UNION ALL (SELECT 'long', doc_id, tok FROM pool ORDER BY tok DESC, doc_id LIMIT 3)")
def extremes(spark, d):
    df = fx.pool(spark, d).select("doc_id", "tok")
    short, long = df.where("tok > 0").orderBy("tok", "doc_id").limit(3), df.orderBy(F.desc("tok"), "doc_id").limit(3)
    return short.select(F.lit("short").alias("side"), "*").unionByName(long.select(F.lit("long").alias("side"), "*"))


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {fx.sql_h('sample')}) AS n FROM documents) WHERE n <= 3")
def sample_per_file(spark, d):
    """Three documents a source by hash: an aggregate of least hashes, so that a large source is not sorted in one task."""
    docs = fx.table(spark, d, "documents").select("source", "doc_id", fx.h("sample", F.col("doc_id")).alias("h"))
    cell = docs.groupBy("source", (F.col("h") % 64).alias("cell"))
    least = cell.agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "doc_id"))), 1, 3).alias("x"))
    few = least.groupBy("source").agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, 3).alias("x"))
    return few.select("source", F.explode("x.doc_id").alias("doc_id"))


@query(f"SELECT doc_id FROM documents ORDER BY {fx.sql_h('uniform')} LIMIT 50")
def uniform_sample(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", fx.h("uniform", F.col("doc_id")).alias("h")).orderBy("h").limit(50).select("doc_id")


# --- H: sets ----------------------------------------------------------------------------------------------------------------------------
@query(f"WITH {fx.SETS}, {fx.TAGGED} SELECT doc_id, count(*) AS votes, count(*) = 4 AS in_all FROM tagged GROUP BY doc_id")
def domain_union(spark, d):
    return st.votes(fx.sets(fx.alive(spark, d)), "doc_id").select("doc_id", F.col("votes").cast("long").alias("votes"), (F.col("votes") == 4).alias("in_all"))


@query(f"WITH {fx.SETS} SELECT doc_id FROM alive WHERE doc_id NOT IN (SELECT doc_id FROM consensus)")
def complement(spark, d):
    df = fx.alive(spark, d)
    return st.exclude(df.select("doc_id"), "doc_id", fx.sets(df)["consensus"])


_PAIRS = " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, (SELECT count(*) FROM {a}) AS a_docs, (SELECT count(*) FROM {b}) AS b_docs, (SELECT count(*) FROM {a} WHERE doc_id IN (SELECT doc_id FROM {b})) AS both_docs,
    (SELECT sum(len) FROM alive WHERE doc_id IN (SELECT doc_id FROM {a}))::BIGINT AS a_tokens, coalesce((SELECT sum(len) FROM alive WHERE doc_id IN (SELECT doc_id FROM {a}) AND doc_id IN (SELECT doc_id FROM {b})), 0)::BIGINT AS both_tokens"""
    for a in fx.SET_NAMES
    for b in fx.SET_NAMES
)


@query(f"""WITH {fx.SETS}, p AS ({_PAIRS}) SELECT a, b, a_docs, b_docs, both_docs, a_tokens, both_tokens, round(both_docs / (a_docs + b_docs - both_docs), 6) AS jaccard,
    round(both_docs / a_docs, 6) AS coverage_docs, round(both_tokens / a_tokens, 6) AS coverage_tokens FROM p""")
def overlap_matrix(spark, d):
    df = fx.alive(spark, d)
    out = st.overlap_matrix(fx.sets(df), "doc_id", df, "len")
    return out.select("a", "b", "a_docs", "b_docs", "both_docs", "a_tokens", "both_tokens", *[r6(F.col(c), c) for c in ("jaccard", "coverage_docs", "coverage_tokens")])


@query(f"WITH {fx.SETS} SELECT round(count(*)::DOUBLE / (SELECT count(*) FROM consensus), 6) AS docs, round(sum(len)::DOUBLE / (SELECT sum(len) FROM alive WHERE doc_id IN (SELECT doc_id FROM consensus)), 6) AS tokens FROM alive WHERE doc_id IN (SELECT doc_id FROM consensus) AND doc_id IN (SELECT doc_id FROM top1)")
def coverage(spark, d):
    df = fx.alive(spark, d)
    s = {k: v for k, v in fx.sets(df).items() if k in ("consensus", "top1")}
    out = st.overlap_matrix(s, "doc_id", df, "len").where("a = 'consensus' and b = 'top1'")
    return out.select(r6(F.col("coverage_docs"), "docs"), r6(F.col("coverage_tokens"), "tokens"))


@query(f"""WITH {fx.SETS}, n AS (SELECT (SELECT count(*) FROM alive) AS n, (SELECT count(*) FROM top1) AS a, (SELECT count(*) FROM top2) AS b, (SELECT count(*) FROM top1 WHERE doc_id IN (SELECT doc_id FROM top2)) AS i)
    SELECT i AS observed, round(i / (b * a::DOUBLE / n), 6) AS enrichment FROM n""")
def enrichment(spark, d):
    df = fx.alive(spark, d)
    s, n = fx.sets(df), df.agg(F.count("*")).scalar()
    m = st.membership({"a": s["top1"], "b": s["top2"]}, "doc_id").agg(F.count_if(F.col("bits").bitwiseAND(1) > 0).alias("a"), F.count_if(F.col("bits").bitwiseAND(2) > 0).alias("b"), F.count_if(F.col("bits") == 3).alias("observed"))
    return m.select("observed", r6(st.enrichment(F.col("observed"), F.col("b"), F.col("a").cast("double"), n), "enrichment"))


@query(f"""WITH {fx.SETS}, p AS (SELECT topic, sum(len)::DOUBLE AS x FROM alive WHERE doc_id IN (SELECT doc_id FROM consensus) GROUP BY topic), w AS (SELECT topic, sum(len)::DOUBLE AS x FROM alive GROUP BY topic),
    b AS (SELECT coalesce(p.x, 0) / (SELECT sum(x) FROM p) AS p, coalesce(w.x, 0) / (SELECT sum(x) FROM w) AS r FROM p FULL JOIN w USING (topic))
    SELECT round(sum(abs(p - r)) / 2, 6) AS tv, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + r)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(2 * r / (p + r)) ELSE 0 END) / 2, 6) AS js_bits FROM b""")
def tv_js(spark, d):
    df = fx.alive(spark, d)
    chosen = ds.strata_share(st.only(df, "doc_id", fx.sets(df)["consensus"]), "topic", "len", df)
    return ds.divergence(chosen, ds.strata_share(df, "topic", "len"), "topic", "token_share").select(r6(F.col("tv"), "tv"), r6(F.col("js_bits"), "js_bits"))


@query(f"""WITH {fx.sql_passes("a")}, {fx.sql_passes("b")} SELECT a.status = 2 AS kept_a, b.status = 2 AS kept_b, count(*) AS docs FROM pass_a a JOIN pass_b b USING (doc_id) GROUP BY ALL""")
def dual_membership(spark, d):
    a, b = (fx.passes(spark, d, x).select("doc_id", (F.col("status") == 2).alias(f"kept_{x}")) for x in "ab")
    return a.join(b, "doc_id").groupBy("kept_a", "kept_b").agg(F.count("*").alias("docs"))


@query(f"""WITH {fx.SETS} SELECT doc_id IN (SELECT doc_id FROM consensus) AS chosen, count(*) AS n, round(quantile_cont(tok, 0.25), 4) AS p25, round(quantile_cont(tok, 0.5), 4) AS p50, round(quantile_cont(tok, 0.75), 4) AS p75 FROM alive GROUP BY ALL""")
def selected_contrast(spark, d):
    df = fx.alive(spark, d)
    chosen = fx.sets(df)["consensus"].withColumn("hit", F.lit(True))
    df = df.join(chosen, "doc_id", "left").withColumn("chosen", F.coalesce("hit", F.lit(False)))
    return st.contrast(df, "chosen", "tok", [0.25, 0.5, 0.75]).select("chosen", "n", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")])


@query(f"""WITH {fx.SETS}, {fx.TAGGED} SELECT a.set AS a, b.set AS b, count(*) AS shared FROM tagged a JOIN tagged b USING (doc_id) WHERE a.set < b.set GROUP BY ALL""")
def exclusivity_report(spark, d):
    df = fx.alive(spark, d)
    out = st.overlap_matrix(fx.sets(df), "doc_id", df, "len")
    return out.where("a < b and both_docs > 0").select("a", "b", F.col("both_docs").alias("shared"))


@query(f"""WITH {fx.SETS}, {fx.TAGGED}, p AS (SELECT doc_id, sum(bit)::INTEGER AS bits FROM tagged GROUP BY doc_id) SELECT bits, count(*) AS docs, sum(len)::BIGINT AS tokens FROM p JOIN alive USING (doc_id) GROUP BY bits""")
def bit_patterns(spark, d):
    df = fx.alive(spark, d)
    return st.pattern_counts(fx.sets(df), "doc_id", df, "len")


@query(f"WITH {fx.SETS}, {fx.TAGGED}, v AS (SELECT doc_id, count(*) AS votes FROM tagged WHERE set <> 'consensus' GROUP BY doc_id) SELECT votes, count(*) AS docs FROM v GROUP BY votes")
def votes(spark, d):
    s = {k: v for k, v in fx.sets(fx.alive(spark, d)).items() if k != "consensus"}
    return st.votes(s, "doc_id").groupBy(F.col("votes").cast("long").alias("votes")).agg(F.count("*").alias("docs"))


@query(f"WITH {fx.SETS}, {fx.TAGGED} SELECT set, count(*) AS docs, round(avg(tok), 4) AS mean_tok, min(tok) AS min_tok, round(median(tok), 4) AS median_tok, round(avg(q::DOUBLE), 6) AS mean_q FROM tagged JOIN alive USING (doc_id) GROUP BY set")
def set_profiles(spark, d):
    df = fx.alive(spark, d)
    rows = st.tagged(fx.sets(df), "doc_id").join(df.withColumn("q", F.col("q").cast("double")), "doc_id")
    return ds.profile(rows, "set", ["tok", "q"]).select("set", "docs", F.round("mean_tok", 4).alias("mean_tok"), "min_tok", F.round("median_tok", 4).alias("median_tok"), r6(F.col("mean_q"), "mean_q"))
