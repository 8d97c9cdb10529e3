"""Tie-aware ranks through the table of distinct values, which may be far smaller than the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import previous, running_sum, total


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, upto): rows at each distinct value, and rows at or below it, in each group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running_sum(counts, None, [*by, value], "n", "upto", by)


def average_rank_pcts(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Average rank of each value over the number of rows, as float32 in (0, 1], for columns of one type: {value: out}. All columns
    are ranked in one pass over long rows (column, value). Rows with a null value go."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("__c"), F.col(v).alias("__v")) for i, v in enumerate(values)])).alias("x")).select("x.*")
    table = value_counts(long, "__v", ["__c"])
    n = df.agg(F.count("*")).scalar()
    pct = ((F.col("upto") - F.col("n") + 1 + (F.col("n") - 1) / 2) / n).cast("float")
    table = table.select("__c", "__v", pct.alias("__pct"))
    for i, (value, out) in enumerate(values.items()):
        own = table.where(F.col("__c") == i).select(F.col("__v").alias("__value"), F.col("__pct").alias(out))
        df = df.join(own, F.col(value) == F.col("__value")).drop("__value")
    return df


def average_rank_pct(df: DataFrame, value: str, out: str) -> DataFrame:
    """average_rank_pcts() of one column."""
    return average_rank_pcts(df, {value: out})


def rank_against(df: DataFrame, value: str, reference: DataFrame, reference_value: str, out: str) -> DataFrame:
    """Percentile of each value in a reference: (below + at or below + 1) / 2 / N. Both sides' distinct values are counted in one table."""
    both = reference.select(F.col(reference_value).alias("__v"), F.lit(1).alias("__w")).unionByName(df.select(F.col(value).alias("__v"), F.lit(0).alias("__w")))
    counts = both.groupBy("__v").agg(F.sum("__w").alias("n"))
    table = running_sum(counts, None, "__v", "n", "upto")
    pct = (((F.col("upto") - F.col("n")) + F.col("upto") + 1) / 2 / total(reference.select(F.lit(1).alias("n")), "n")).cast("float")
    return df.join(table.select(F.col("__v").alias("__v"), pct.alias(out)), F.col(value) == F.col("__v")).drop("__v")


def group_average_rank(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank in each (small) group, best first; equal values share the mean of their ranks."""
    by = Window.partitionBy(*groups)
    ties = Window.partitionBy(*groups, value)
    return df.withColumn(out, F.rank().over(by.orderBy(F.col(value).desc())) + (F.count("*").over(ties) - 1) / 2)


def percentiles_by(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, p: array of one value for each of `at`): exact percentiles by linear interpolation, from the running count of distinct
    values, so that no task holds a group's values. Null values don't count."""
    table = value_counts(df, value, by)
    sizes = table.groupBy(*[F.col(f"`{b}`").alias(f"__g{i}") for i, b in enumerate(by)]).agg(F.sum("n").alias("__n"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"__g{i}"))
    rows = table.join(sizes, same).drop(*[f"__g{i}" for i in range(len(by))]) if by else table.withColumn("__n", total(table, "n"))
    point = lambda p, rounded: F.min(F.when(F.col("upto") > rounded(F.lit(p) * (F.col("__n") - 1)), F.col(value).cast("double")))
    cells = [F.struct(point(p, F.floor).alias("low"), point(p, F.ceil).alias("high"), F.lit(p).alias("p")) for p in at]
    found = rows.groupBy(*by).agg(F.max("__n").alias("n"), F.array(*cells).alias("p"))
    part = lambda p: p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))
    return found.withColumn("p", F.transform("p", lambda x: x["low"] + (x["high"] - x["low"]) * part(x["p"])))


def dense_code(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): codes 0.. of the sorted distinct values; null has none."""
    distinct = df.where(F.col(value).isNotNull()).select(value).distinct().withColumn("__one", F.lit(1))
    return running_sum(distinct, None, value, "__one", out).select(value, (F.col(out) - 1).alias(out))


def tie_validation(df: DataFrame, raw: str, pct: str) -> DataFrame:
    """One row: distinct raw values; whether equal raw means equal percentile; whether percentiles never fall as raw rises; rises."""
    by = df.groupBy(raw).agg(F.min(pct).alias("low"), F.max(pct).alias("high"))
    step = previous(by, raw, "high", "before")
    return step.agg(
        F.count("*").alias("distinct_raw"),
        F.bool_and(F.col("low") == F.col("high")).alias("equal_raw_equal_pct"),
        F.bool_and(F.col("before").isNull() | (F.col("low") >= F.col("before"))).alias("non_decreasing"),
        F.sum((F.col("low") > F.col("before")).cast("long")).alias("strict_increases"),
    )


def tie_cluster(df: DataFrame, value: str) -> DataFrame:
    """Rows at the least, the greatest and the most frequent value."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.agg(
        F.min_by("n", value).alias("at_min"), F.max_by("n", value).alias("at_max"), F.max("n").alias("largest"), F.count("*").alias("distinct_values")
    )
