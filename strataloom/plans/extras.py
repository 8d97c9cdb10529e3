"""Queries: digests, parsers, orders of samples, and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators import report
from ..operators import tokens as tk
from ..operators.prefix import numbered
from . import fixtures as fx
from .registry import query


@query("""WITH x AS (SELECT event_id, event_id::DOUBLE * 1000 + 7 AS x FROM events), p AS (SELECT event_id, x, least(greatest(floor(log10(greatest(abs(x), 1)) / 3), 0), 4)::INTEGER AS p FROM x), s AS (SELECT event_id, p, x / pow(1000.0, p) AS s FROM p),
    t AS (SELECT event_id, p, CASE WHEN s < 10 THEN printf('%.2f', s) WHEN s < 100 THEN printf('%.1f', s) ELSE printf('%.0f', s) END AS t FROM s) SELECT event_id, CASE WHEN contains(t, '.') THEN regexp_replace(t, '\\.?0+$', '') ELSE t END || ['', 'K', 'M', 'B', 'T'][p + 1] AS label FROM t""".replace("\\\\", "\\"))
def human_format(spark, d):
    return fx.table(spark, d, "events").select("event_id", sc.human(F.col("event_id").cast("double") * 1000 + 7).alias("label"))


@query("SELECT mbs, accum, dp, mbs * accum * dp * 2048 AS tokens, mbs * accum * dp * 2048 = 2097152 AS holds FROM (SELECT (doc_id % 5 + 1)::BIGINT AS mbs, (doc_id % 129)::BIGINT AS accum, (doc_id % 4 + 1)::BIGINT AS dp FROM documents)")
def batch_invariant(spark, d):
    key = F.col("doc_id")
    rows = fx.table(spark, d, "documents").select((key % 5 + 1).alias("mbs"), (key % 129).alias("accum"), (key % 4 + 1).alias("dp"))
    return rows.withColumn("tokens", F.col("mbs") * F.col("accum") * F.col("dp") * 2048).withColumn("holds", F.col("tokens") == 2_097_152)


@query(r"""WITH c AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 3) || '/3' ELSE '$' || printf('%.2f', value) || ' \pm ' || printf('%.2f', value / 8 + 0.001) || '$' END AS cell FROM (SELECT event_id, (event_id % 9973)::DOUBLE / 4 AS value FROM events))
    SELECT event_id, try_cast(nullif(regexp_extract(cell, '([+-]?\d+\.\d+)\s*\\pm\s*(\d+\.\d+)', 1), '') AS DOUBLE) AS mean, try_cast(nullif(regexp_extract(cell, '([+-]?\d+\.\d+)\s*\\pm\s*(\d+\.\d+)', 2), '') AS DOUBLE) AS sd, try_cast(nullif(regexp_extract(cell, '(\d+)/3', 1), '') AS INTEGER) AS k FROM c""")
def latex_scrape(spark, d):
    value = (F.col("event_id") % 9973).cast("double") / 4
    cell = F.when(F.col("event_id") % 4 == 0, F.concat(F.col("event_id") % 3, F.lit("/3"))).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", value), F.lit(" \\pm "), F.format_string("%.2f", value / 8 + 0.001), F.lit("$")))
    mean, sd, k = report.latex_cell(cell)
    return fx.table(spark, d, "events").select("event_id", mean.alias("mean"), sd.alias("sd"), k.alias("k"))


@query(f"SELECT row_number() OVER (ORDER BY doc_id >= (SELECT max(doc_id) FROM documents) - 150, {fx.sql_h('segment')}) - 1 AS pos, doc_id FROM documents")
def segment_shuffle(spark, d):
    """A sample index shuffled in two segments: the last 151 ids stay after the others."""
    docs = fx.table(spark, d, "documents").select("doc_id")
    cut = docs.agg(F.max("doc_id") - 150).scalar()
    return numbered(docs.withColumns({"late": F.col("doc_id") >= cut, "t": fx.h("segment", F.col("doc_id"))}), ["late", "t"], "pos").select("pos", "doc_id")


@query("SELECT doc_id, pos, pos // 16 AS chunk, pos // 16 % 4 AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)")
def round_robin_chunks(spark, d):
    rows = numbered(fx.table(spark, d, "documents").select("doc_id"), "doc_id", "pos")
    return rows.withColumn("chunk", F.floor(F.col("pos") / 16)).withColumn("rank", F.col("chunk") % 4)


@query("""WITH p AS (SELECT doc_id, list_concat(list_transform(range(0, doc_id % 7), lambda i: 0::INTEGER), list_transform(range(0, 12 - doc_id % 7), lambda i: (i + 5)::INTEGER)) AS ids, doc_id % 7 AS n FROM documents)
    SELECT doc_id, list_transform(range(0, 12), lambda i: greatest(i - n, 0)::INTEGER) AS positions FROM p""")
def padded_positions(spark, d):
    at = F.sequence(F.lit(0), F.lit(11))
    ids = F.transform(at, lambda i: F.when(i < F.col("doc_id") % 7, 0).otherwise(i - F.col("doc_id") % 7 + 5).cast("int"))
    return fx.table(spark, d, "documents").select("doc_id", tk.left_padded_positions(ids, 0).alias("positions"))


_PROBS = """e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings), w AS (SELECT vec_id, dim, x * x AS w FROM e), p AS (SELECT vec_id, dim, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w)"""


def _probabilities(spark, d):
    """A distribution over dimensions by vector: squared components, normalised. A vector has a fixed number of them."""
    from pyspark.sql import Window

    e = fx.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    w = e.select("vec_id", "dim", (F.col("x").cast("double") * F.col("x").cast("double")).alias("w"))
    return w.select("vec_id", "dim", (F.col("w") / F.sum("w").over(Window.partitionBy("vec_id"))).alias("p"))


@query(f"WITH {_PROBS}, c AS (SELECT vec_id, dim, p, sum(p) OVER (PARTITION BY vec_id ORDER BY p, dim DESC ROWS UNBOUNDED PRECEDING) AS c FROM p) SELECT vec_id, count(*) AS kept, round(sum(p), 6) AS mass FROM c WHERE c > 1 - 0.9 GROUP BY vec_id")
def nucleus(spark, d):
    """Top-p: the smallest mass goes while its cumulative sum is at most 1 - p."""
    from pyspark.sql import Window

    by = Window.partitionBy("vec_id").orderBy("p", F.desc("dim")).rowsBetween(Window.unboundedPreceding, 0)
    kept = _probabilities(spark, d).withColumn("c", F.sum("p").over(by)).where(F.col("c") > 1 - 0.9)
    return kept.groupBy("vec_id").agg(F.count("*").alias("kept"), F.round(F.sum("p"), 6).alias("mass"))


@query(f"WITH {_PROBS}, r AS (SELECT dim % 8 AS expert, vec_id, sum(p) AS p FROM p GROUP BY ALL), k AS (SELECT expert, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS n FROM r) SELECT expert::INTEGER AS expert, count(*) AS routed FROM k WHERE n <= 2 GROUP BY expert")
def top_k_routing(spark, d):
    """Two best of eight experts by vector, and how many vectors each gets."""
    from pyspark.sql import Window

    r = _probabilities(spark, d).groupBy("vec_id", (F.col("dim") % 8).alias("expert")).agg(F.sum("p").alias("p"))
    best = r.withColumn("n", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("p"), "expert"))).where("n <= 2")
    return best.groupBy("expert").agg(F.count("*").alias("routed"))
