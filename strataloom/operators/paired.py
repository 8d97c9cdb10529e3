"""Paired statistics over a long table of results (setting, seed, epoch, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (metric, epoch, pair): mean and sample deviation of within-seed differences, and how many are positive or negative.
    pairs: (setting_a, setting_b), in the orientation wanted. The join is on (seed, epoch, metric) for the settings of a pair."""
    a = scores.select(F.col("setting").alias("setting_a"), "seed", "epoch", "metric", F.col("value").alias("va"))
    b = scores.select(F.col("setting").alias("setting_b"), "seed", "epoch", "metric", F.col("value").alias("vb"))
    rows = pairs.join(a, "setting_a").join(b, ["setting_b", "seed", "epoch", "metric"]).withColumn("d", F.col("va") - F.col("vb"))
    return rows.groupBy("metric", "epoch", "setting_a", "setting_b").agg(
        F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"), F.count_if(F.col("d") > 0).alias("n_pos"), F.count_if(F.col("d") < 0).alias("n_neg"), F.count("*").alias("n")
    )


def all_pairs(settings: DataFrame, requested: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Unordered pairs in name order, turned round where the other orientation is requested."""
    names = settings.select("setting").distinct()
    pairs = names.withColumnRenamed("setting", "setting_a").join(names.withColumnRenamed("setting", "setting_b"), F.col("setting_a") < F.col("setting_b"))
    turn = F.lit(False)
    for a, b in requested:
        turn = turn | (F.col("setting_a") == b) & (F.col("setting_b") == a)
    return pairs.select(F.when(turn, F.col("setting_b")).otherwise(F.col("setting_a")).alias("setting_a"), F.when(turn, F.col("setting_a")).otherwise(F.col("setting_b")).alias("setting_b"))


def supported() -> tuple[Column, Column]:
    """Whether all seeds agree in sign and the mean exceeds the deviation; and the winner."""
    up = (F.col("n_pos") == F.col("n")) & (F.col("mean_diff") > F.col("sd_diff"))
    down = (F.col("n_neg") == F.col("n")) & (-F.col("mean_diff") > F.col("sd_diff"))
    return up | down, F.when(up, F.col("setting_a")).when(down, F.col("setting_b"))


def classify(pairs: DataFrame) -> DataFrame:
    """strong: supported; weak: all seeds agree; else none. Differences are turned so that the winner stands first."""
    met, _ = supported()
    agree = (F.col("n_pos") == F.col("n")) | (F.col("n_neg") == F.col("n"))
    label = F.when(met, "strong").when(agree, "weak").otherwise("none")
    turn = F.col("mean_diff") < 0
    first, second = F.when(turn, F.col("setting_b")).otherwise(F.col("setting_a")), F.when(turn, F.col("setting_a")).otherwise(F.col("setting_b"))
    return pairs.select("metric", "epoch", first.alias("first"), second.alias("second"), F.abs("mean_diff").alias("gap"), label.alias("label"))


def leave_one_out(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(setting, seed, epoch, dropped, value): mean over all metrics but one, from the sum of all."""
    some = scores.where(F.col("metric").isin(list(metrics)))
    total = some.groupBy("setting", "seed", "epoch").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    return some.join(total, ["setting", "seed", "epoch"]).select("setting", "seed", "epoch", F.col("metric").alias("dropped"), ((F.col("s") - F.col("value")) / (F.col("n") - 1)).alias("value"))


def macro_average(scores: DataFrame, metrics: Sequence[str], out: str) -> DataFrame:
    """Unweighted mean over a fixed list; results that lack one of them are refused (null)."""
    by = scores.where(F.col("metric").isin(list(metrics))).groupBy("setting", "seed", "epoch").agg(F.avg("value").alias("v"), F.countDistinct("metric").alias("n"))
    return by.select("setting", "seed", "epoch", F.lit(out).alias("metric"), F.when(F.col("n") == len(metrics), F.col("v")).alias("value"))


def reference_check(computed: DataFrame, printed: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.005 + 1e-9) -> DataFrame:
    """One row: cells compared, cells off by more than the tolerance or missing, and the worst deviation."""
    both = printed.select(*keys, F.col(value).alias("__p")).join(computed.select(*keys, F.col(value).alias("__c")), list(keys), "left")
    gap = F.abs(F.col("__c") - F.col("__p"))
    return both.agg(F.count("*").alias("cells"), F.count_if(F.coalesce(gap > tolerance, F.lit(True))).alias("failed"), F.max(gap).alias("worst"))
