"""Domain losses and the weights that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_domain_loss(losses: DataFrame, domains: DataFrame, domain: str, loss: str, seq_len: int) -> DataFrame:
    """(domain, loss, samples): summed token losses over samples * seq_len; a domain without samples has 0."""
    by = losses.groupBy(domain).agg(F.sum(loss).alias("total"), F.countDistinct("sample").alias("samples"))
    out = domains.select(domain).distinct().join(by, domain, "left").na.fill(0, ["samples"])
    return out.select(domain, F.when(F.col("samples") > 0, F.col("total") / (F.col("samples") * seq_len)).otherwise(0.0).alias("loss"), "samples")


def update_weights(weights: DataFrame, losses: DataFrame, domain: str, step: float, smoothing: float) -> DataFrame:
    """w * exp(step * excess), normalised and smoothed to uniform. One row a domain, so the window is small."""
    whole = Window.partitionBy()
    both = weights.join(losses, domain, "left").na.fill(0.0, ["loss"]).withColumn("__log", F.log("weight") + step * F.col("loss"))
    raised = both.withColumn("__up", F.exp(F.col("__log") - F.max("__log").over(whole)))
    new = (1 - smoothing) * F.col("__up") / F.sum("__up").over(whole) + smoothing / F.count("*").over(whole)
    return raised.select(domain, new.alias("weight"))


def excess(losses: DataFrame, loss: str, reference: str, out: str = "loss") -> DataFrame:
    return losses.withColumn(out, F.greatest(F.col(loss) - F.col(reference), F.lit(0.0)))


def with_history(history: DataFrame | None, weights: DataFrame, step: int) -> DataFrame:
    """The weights of a step after those of the steps before; a step that is there already is replaced."""
    now = weights.withColumn("step", F.lit(step))
    return now if history is None else history.where(F.col("step") != step).unionByName(now.select(*history.columns))


def count_weights(counts: DataFrame, n: str) -> DataFrame:
    """Weights in proportion to a count (of samples, or of tokens)."""
    return counts.withColumn("weight", F.col(n) / F.sum(n).over(Window.partitionBy()))  # one row a domain
