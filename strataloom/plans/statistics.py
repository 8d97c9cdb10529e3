"""Queries: aggregates, paired statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distribution as ds
from ..operators import domains, paired, prefix
from ..operators.rank import percentiles_by
from . import fixtures as fx
from .registry import query

r6 = lambda c, n: F.round(c, 6).alias(n)


@query(f"WITH {fx.POOL} SELECT count(*) AS n, sum(tok)::BIGINT AS s, min(tok) AS lo, max(tok) AS hi, round(avg(tok), 6) AS mean, round(median(tok), 6) AS med FROM pool")
def scalar_stats(spark, d):
    df = fx.pool(spark, d)
    median = percentiles_by(df, "tok", [0.5]).select(F.get("p", F.lit(0))).scalar()
    return df.agg(F.count("*").alias("n"), F.sum("tok").alias("s"), F.min("tok").alias("lo"), F.max("tok").alias("hi"), r6(F.avg("tok"), "mean")).withColumn("med", F.round(median, 6))


_AT = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


@query(f"WITH {fx.POOL}, p AS (SELECT unnest({_AT}) AS p) SELECT p::DOUBLE AS p, round(quantile_cont(tok, p::DOUBLE), 4) AS value, round((SELECT avg(tok) FROM pool), 6) AS mean, round((SELECT stddev_pop(tok) FROM pool), 6) AS std FROM p, pool GROUP BY p".replace("quantile_cont(tok, p::DOUBLE)", "(SELECT list_extract(quantile_cont(tok, " + str(_AT) + "), list_position(" + str(_AT) + ", p)::INTEGER) FROM pool)").replace("FROM p, pool GROUP BY p", "FROM p"))
def percentile_table(spark, d):
    return ds.percentiles(fx.pool(spark, d), "tok", _AT).select("p", F.round("value", 4).alias("value"), r6(F.col("mean"), "mean"), r6(F.col("std"), "std"))


@query(f"WITH {fx.POOL}, o AS (SELECT tok, row_number() OVER (ORDER BY tok DESC, tie) AS r, count(*) OVER () AS n FROM pool), x AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS x) SELECT x, tok FROM o, x WHERE r = (x * (n - 1))::BIGINT + 1 - CASE WHEN (x * (n - 1))::BIGINT > x * (n - 1) THEN 1 ELSE 0 END")
def floor_quantile(spark, d):
    df = fx.pool(spark, d).withColumn("one", F.lit(1))
    ordered = prefix.running_sum(df, "tok", "tie", "one", "pos")
    return ds.floor_quantile(ordered, "pos", "tok", [0.1, 0.5, 0.9])


@query(f"WITH {fx.POOL} SELECT source, count(*) AS docs, sum(tok + 1)::BIGINT AS tokens FROM pool GROUP BY source")
def group_docs_tokens(spark, d):
    return fx.pool(spark, d).groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tok") + 1).alias("tokens"))


@query(f"WITH {fx.POOL} SELECT doc_id % 2 = 0 AS original, topic, sum(tok)::BIGINT AS tokens FROM pool GROUP BY ALL")
def group_two_keys(spark, d):
    return fx.pool(spark, d).groupBy((F.col("doc_id") % 2 == 0).alias("original"), "topic").agg(F.sum("tok").alias("tokens"))


@query(f"WITH {fx.POOL}, s AS (SELECT topic, tok FROM pool WHERE source = 'src3'), g AS (SELECT p.topic, (SELECT count(*) FROM s WHERE s.topic = p.topic) AS docs, coalesce((SELECT sum(tok) FROM s WHERE s.topic = p.topic), 0)::BIGINT AS tokens FROM (SELECT DISTINCT topic FROM pool) p) SELECT topic, docs, tokens, round(docs / sum(docs) OVER (), 6) AS doc_share, round(tokens / sum(tokens) OVER (), 6) AS token_share FROM g")
def weighted_histogram(spark, d):
    df = fx.pool(spark, d)
    return ds.strata_share(df.where("source = 'src3'"), "topic", "tok", df).select("topic", "docs", "tokens", r6(F.col("doc_share"), "doc_share"), r6(F.col("token_share"), "token_share"))


@query("WITH g AS (SELECT text, count(*) AS times FROM documents GROUP BY text) SELECT times, count(*) AS keys FROM g GROUP BY times")
def multiplicity_hist(spark, d):
    return ds.multiplicity(fx.table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("SELECT count(*) - count(DISTINCT text) AS duplicates, count(DISTINCT source) AS sources FROM documents")
def duplicate_count(spark, d):
    return fx.table(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "source").agg((F.count("*") - F.countDistinct("h")).alias("duplicates"), F.countDistinct("source").alias("sources"))


@query(f"WITH {fx.POOL} SELECT bool_and(tok >= 0) AS all_ok, bool_or(tok > 1000) AS any_long, arg_max(doc_id, tok * 1000000 + doc_id) AS longest, arg_min(doc_id, tok * 1000000 + doc_id) AS shortest FROM pool")
def boolean_and_arg(spark, d):
    by = F.struct("tok", "doc_id")
    return fx.pool(spark, d).agg(F.bool_and(F.col("tok") >= 0).alias("all_ok"), F.bool_or(F.col("tok") > 1000).alias("any_long"), F.max_by("doc_id", by).alias("longest"), F.min_by("doc_id", by).alias("shortest"))


@query(f"WITH {fx.POOL} SELECT topic, round(corr(n_chars, tok), 6) AS r FROM pool GROUP BY topic")
def pearson(spark, d):
    return fx.pool(spark, d).groupBy("topic").agg(r6(F.corr("n_chars", "tok"), "r"))


@query(f"WITH {fx.POOL}, f AS (SELECT tok > 100 AS floor_ok, n_chars < 5000 AS cap_ok FROM pool) SELECT floor_ok, cap_ok, count(*) AS n FROM f GROUP BY CUBE (floor_ok, cap_ok)")
def contingency_margins(spark, d):
    return ds.contingency(fx.pool(spark, d).select((F.col("tok") > 100).alias("floor_ok"), (F.col("n_chars") < 5000).alias("cap_ok")), "floor_ok", "cap_ok")


_SIX = [f"m{i}" for i in range(6)]


@query(f"WITH {fx.SCORES} SELECT setting, seed, epoch, 'mean6' AS metric, CASE WHEN count(DISTINCT metric) = 6 THEN round(avg(value), 6) END AS value FROM scores GROUP BY setting, seed, epoch")
def macro_average(spark, d):
    return paired.macro_average(fx.scores(spark, d), _SIX, "mean6").withColumn("value", F.round("value", 6))


@query("SELECT event_type, round(sum(CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END) / nullif(count(*) FILTER (event_id % 3 = 0), 0), 6) AS m FROM events GROUP BY event_type")
def masked_mean(spark, d):
    return fx.table(spark, d, "events").groupBy("event_type").agg(r6(ds.masked_mean(F.col("value"), F.col("event_id") % 3 == 0), "m"))


_LOSSES = "l AS (SELECT event_id // 4 AS sample, event_type AS dom, value / 100 AS loss, ({h} % 1000) / 1000.0 AS ref FROM events)".format(h=fx.sql_h("ref", "event_id"))


def _losses(spark, d):
    e = fx.table(spark, d, "events")
    return e.select(F.floor(F.col("event_id") / 4).alias("sample"), F.col("event_type").alias("dom"), (F.col("value") / 100).alias("loss"), ((fx.h("ref", F.col("event_id")) % 1000) / 1000.0).alias("ref"))


def _domains(spark, d):
    rows = _losses(spark, d).select("dom")
    return rows.unionByName(spark.createDataFrame([("empty",)], "dom string")).distinct()


@query(f"WITH {_LOSSES} SELECT dom, round(sum(loss) / (count(DISTINCT sample) * 128), 6) AS loss, count(DISTINCT sample) AS samples FROM l GROUP BY dom UNION ALL SELECT 'empty', 0, 0")
def per_domain_loss(spark, d):
    return domains.per_domain_loss(_losses(spark, d), _domains(spark, d), "dom", "loss", 128).withColumn("loss", F.round("loss", 6))


@query(f"""WITH {_LOSSES}, x AS (SELECT dom, sum(greatest(loss - ref, 0)) / (count(DISTINCT sample) * 4) AS x FROM l GROUP BY dom UNION ALL SELECT 'empty', 0), n AS (SELECT dom, x, exp(ln(1.0 / count(*) OVER ()) + 1.5 * x) AS up, count(*) OVER () AS k FROM x)
    SELECT dom, round(0.9 * up / sum(up) OVER () + 0.1 / k, 6) AS weight FROM n""")
def doremi_update(spark, d):
    doms = _domains(spark, d)
    excess = domains.excess(_losses(spark, d), "loss", "ref")
    loss = domains.per_domain_loss(excess, doms, "dom", "loss", 4)
    return domains.update_weights(doms.withColumn("weight", F.lit(1.0) / doms.agg(F.count("*")).scalar()), loss, "dom", 1.5, 0.1).withColumn("weight", F.round("weight", 6))


@query("SELECT source, n, round(n / sum(n) OVER (), 6) AS weight FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def count_weights(spark, d):
    return domains.count_weights(fx.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "n").withColumn("weight", F.round("weight", 6))


@query("""WITH m AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS a, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM events) SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
    round(sum(abs(value)), 4) AS norm_l1, round(sqrt(sum(value * value)), 4) AS norm_l2, round(avg((abs(value) < 1e-10)::INT), 6) AS zero_frac, round(avg(pow((value - a) / s, 4)) - 3, 6) AS kurtosis FROM m GROUP BY event_type""")
def tensor_stats(spark, d):
    out = fx.table(spark, d, "events").groupBy("event_type").agg(*ds.tensor_stats("value"))
    return out.select("event_type", *[F.round(c, 4 if "norm" in c else 6).alias(c) for c in out.columns[1:]])


@query(f"""WITH {fx.POOL}, g AS (SELECT doc_id % 8 AS grp, count(*) AS n, count(*) FILTER (tok > 300) AS hits FROM pool GROUP BY 1), p AS (SELECT *, sum(hits) OVER () / sum(n) OVER () AS p FROM g)
    SELECT grp, n, hits, round(hits / n, 6) AS rate, round(CASE WHEN p > 0 AND p < 1 THEN (hits / n - p) / sqrt(p * (1 - p) / n) ELSE 0 END, 6) AS z FROM p""")
def binomial_z(spark, d):
    return ds.group_z(fx.pool(spark, d), F.col("doc_id") % 8, F.col("tok") > 300).select("grp", "n", "hits", r6(F.col("rate"), "rate"), r6(F.col("z"), "z"))


@query(f"WITH {fx.POOL} SELECT CASE WHEN tok >= 1000 THEN 1000 WHEN tok >= 300 THEN 300 WHEN tok >= 100 THEN 100 WHEN tok >= 0 THEN 0 END AS lo, count(*) AS n, round(avg((n_chars % 2)::DOUBLE), 6) AS rate FROM pool GROUP BY 1")
def length_bins(spark, d):
    return ds.length_bins(fx.pool(spark, d), "tok", F.col("n_chars") % 2 == 1, [0, 100, 300, 1000]).withColumn("rate", F.round("rate", 6))


@query("SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (toxic IS NULL) AS toxic FROM labels")
def null_counts(spark, d):
    return ds.null_counts(fx.table(spark, d, "labels"))


@query(f"WITH {fx.POOL} SELECT topic, source, sum(tok)::BIGINT AS tokens FROM pool GROUP BY ROLLUP (topic, source)")
def stage_totals(spark, d):
    return fx.pool(spark, d).rollup("topic", "source").agg(F.sum("tok").alias("tokens"))


# --- N: paired statistics -------------------------------------------------------------------------------------------------------------
_PAIRED = f"""{fx.SCORES}, p AS (SELECT CASE WHEN a.setting = 's0' AND b.setting = 's3' THEN b.setting ELSE a.setting END AS setting_a, CASE WHEN a.setting = 's0' AND b.setting = 's3' THEN a.setting ELSE b.setting END AS setting_b
      FROM (SELECT DISTINCT setting FROM scores) a JOIN (SELECT DISTINCT setting FROM scores) b ON a.setting < b.setting),
    x AS (SELECT metric, epoch, setting_a, setting_b, a.value - b.value AS d FROM p JOIN scores a ON a.setting = setting_a JOIN scores b USING (seed, epoch, metric) WHERE b.setting = setting_b),
    pd AS (SELECT metric, epoch, setting_a, setting_b, avg(d) AS m, stddev_samp(d) AS s, count(*) FILTER (d > 0) AS n_pos, count(*) FILTER (d < 0) AS n_neg, count(*) AS n FROM x GROUP BY ALL)"""


def _paired(spark, d):
    scores = fx.scores(spark, d)
    return paired.paired(scores, paired.all_pairs(scores, [("s3", "s0")]))


@query(f"WITH {_PAIRED} SELECT metric, epoch, setting_a, setting_b, round(m, 6) AS mean_diff, round(s, 6) AS sd_diff, n_pos, n_neg, n FROM pd")
def paired_diff(spark, d):
    return _paired(spark, d).withColumns({"mean_diff": F.round("mean_diff", 6), "sd_diff": F.round("sd_diff", 6)})


@query(f"WITH {_PAIRED} SELECT metric, epoch, setting_a, setting_b, (n_pos = n AND m > s) OR (n_neg = n AND -m > s) AS met, CASE WHEN n_pos = n AND m > s THEN setting_a WHEN n_neg = n AND -m > s THEN setting_b END AS winner FROM pd")
def support_rule(spark, d):
    met, winner = paired.supported()
    return _paired(spark, d).select("metric", "epoch", "setting_a", "setting_b", met.alias("met"), winner.alias("winner"))


@query(f"WITH {_PAIRED} SELECT metric, epoch, CASE WHEN m < 0 THEN setting_b ELSE setting_a END AS first, CASE WHEN m < 0 THEN setting_a ELSE setting_b END AS second, round(abs(m), 6) AS gap, CASE WHEN (n_pos = n AND m > s) OR (n_neg = n AND -m > s) THEN 'strong' WHEN n_pos = n OR n_neg = n THEN 'weak' ELSE 'none' END AS label FROM pd")
def classify_pairs(spark, d):
    return paired.classify(_paired(spark, d)).withColumn("gap", F.round("gap", 6))


@query(f"WITH {fx.SCORES} SELECT a.setting, a.seed, a.epoch, a.metric AS dropped, round((SELECT avg(value) FROM scores b WHERE b.setting = a.setting AND b.seed = a.seed AND b.epoch = a.epoch AND b.metric <> a.metric), 6) AS value FROM scores a")
def loo_mean(spark, d):
    return paired.leave_one_out(fx.scores(spark, d), _SIX).withColumn("value", F.round("value", 6))


@query(f"""WITH {fx.SCORES}, l AS (SELECT a.setting, a.seed, a.epoch, a.metric AS metric, (SELECT avg(value) FROM scores b WHERE b.setting = a.setting AND b.seed = a.seed AND b.epoch = a.epoch AND b.metric <> a.metric) AS value FROM scores a),
    x AS (SELECT a.metric, a.epoch, a.setting AS sa, b.setting AS sb, a.value - b.value AS d FROM l a JOIN l b USING (seed, epoch, metric) WHERE a.setting < b.setting), p AS (SELECT metric, epoch, sa, sb, avg(d) AS m, stddev_samp(d) AS s, count(*) FILTER (d > 0) AS np, count(*) FILTER (d < 0) AS nn, count(*) AS n FROM x GROUP BY ALL)
    SELECT epoch, sa AS setting_a, sb AS setting_b, count(*) FILTER ((np = n AND m > s) OR (nn = n AND -m > s)) AS keeps, count(DISTINCT sign(m)) > 1 AS flips FROM p GROUP BY ALL""")
def loto(spark, d):
    """Leave-one-task-out: in how many of the reduced means a pair is supported, and whether the sign of its mean changes."""
    reduced = paired.leave_one_out(fx.scores(spark, d), _SIX).withColumnRenamed("dropped", "metric")
    met, _ = paired.supported()
    pairs = paired.paired(reduced, paired.all_pairs(reduced)).withColumn("met", met)
    return pairs.groupBy("epoch", "setting_a", "setting_b").agg(F.count_if("met").alias("keeps"), (F.countDistinct(F.signum("mean_diff")) > 1).alias("flips"))


@query(f"WITH {fx.SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY metric, epoch, seed ORDER BY value DESC) + (count(*) OVER (PARTITION BY metric, epoch, seed, value) - 1) / 2.0 AS r FROM scores) SELECT metric, epoch, setting, round(avg(r), 6) AS mean_rank, min(r) = max(r) AS same_rank FROM r GROUP BY ALL")
def seed_ranks(spark, d):
    from ..operators.rank import group_average_rank

    ranks = group_average_rank(fx.scores(spark, d), ["metric", "epoch", "seed"], "value", "r")
    return ranks.groupBy("metric", "epoch", "setting").agg(r6(F.avg("r"), "mean_rank"), (F.min("r") == F.max("r")).alias("same_rank"))


@query(f"WITH {fx.SCORES}, p AS (SELECT *, round(value + CASE WHEN hash0 % 50 = 0 THEN 0.02 ELSE 0 END, 2) AS printed FROM (SELECT *, {fx.sql_h('cell', 'metric || setting || seed || epoch')} AS hash0 FROM scores)) SELECT count(*) AS cells, count(*) FILTER (abs(value - printed) > 0.005 + 1e-9) AS failed, round(max(abs(value - printed)), 4) AS worst FROM p")
def reference_check(spark, d):
    scores = fx.scores(spark, d)
    cell = fx.h("cell", F.concat("metric", "setting", "seed", "epoch"))
    printed = scores.withColumn("value", F.round(F.col("value") + F.when(cell % 50 == 0, 0.02).otherwise(0), 2))
    return paired.reference_check(scores, printed, ["setting", "seed", "epoch", "metric"], "value").withColumn("worst", F.round("worst", 4))


@query(f"""WITH {fx.POOL}, s AS (SELECT topic, tok, {fx.sql_h("arm")} % 2 AS arm FROM pool) SELECT topic, round(sum(tok) FILTER (arm = 0) / (SELECT sum(tok) FROM s WHERE arm = 0), 6) AS rewritten, round(sum(tok) FILTER (arm = 1) / (SELECT sum(tok) FROM s WHERE arm = 1), 6) AS shared, round(sum(tok) / (SELECT sum(tok) FROM s), 6) AS combined FROM s GROUP BY topic""")
def topic_three_way(spark, d):
    df = fx.pool(spark, d).withColumn("arm", fx.h("arm", F.col("doc_id")) % 2)
    by = df.groupBy("topic").agg(*[F.sum(F.when(c, F.col("tok")).otherwise(0)).alias(n) for n, c in (("rewritten", F.col("arm") == 0), ("shared", F.col("arm") == 1), ("combined", F.lit(True)))])
    return by.select("topic", *[r6(F.col(c) / prefix.total(by, c), c) for c in ("rewritten", "shared", "combined")])


@query()
def ridge(spark, d):
    """Ridge regression on L2-normalised embeddings by normal equations, solved on the driver."""
    import numpy as np

    e = fx.table(spark, d, "embeddings").select("embedding", F.col("label").cast("double").alias("y"))
    a, b = ds.normal_equations(e, "embedding", "y")
    solved = np.linalg.solve(np.eye(len(b)) + a, b) if len(b) else []
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(solved)], "dim int, coef double")
