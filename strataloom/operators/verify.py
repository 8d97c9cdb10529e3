"""Checks that fail loudly: conservation, contiguity, monotony, digests, leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


class CheckFailed(AssertionError):
    """A check that a pipeline must pass did not hold."""


def contiguity(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, least, greatest, distinct, and whether ids are exactly 0..n-1."""
    out = df.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.countDistinct(key).alias("n_distinct"))
    return out.withColumn("contiguous", (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n")))


def conserved(before: DataFrame, after: DataFrame, weight: str) -> None:
    """Raise unless row count and total weight are equal."""
    a, b = (df.agg(F.count("*"), F.sum(weight)).first() for df in (before, after))
    if tuple(a) != tuple(b):
        raise CheckFailed(f"not conserved: {tuple(a)} became {tuple(b)}")


def deterministic(make, runs: int = 2) -> DataFrame:
    """Run twice; raise unless the results are equal. Returns the first."""
    first = make()
    for _ in range(runs - 1):
        again = make()
        if not (first.exceptAll(again).isEmpty() and again.exceptAll(first).isEmpty()):
            raise CheckFailed("two runs differ")
    return first


def style_rates(df: DataFrame, text: str, by: str) -> DataFrame:
    """Share of texts with a heading, a list item and web words, by arm."""
    flags = {"heading": tx.heading, "list_item": tx.list_item, "web": tx.web_words}
    return df.groupBy(by).agg(F.count("*").alias("docs"), *[F.avg(f(F.col(text)).cast("double")).alias(n) for n, f in flags.items()])


def style_distance(rates: DataFrame, by: str) -> DataFrame:
    """L1 distance of style rates for each pair of arms (a row an arm)."""
    columns = ["heading", "list_item", "web"]
    a = rates.select(F.col(by).alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = rates.select(F.col(by).alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    gap = sum((F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) for c in columns), F.lit(0.0))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", gap.alias("l1"))


def assert_values(df: DataFrame, expected: dict) -> None:
    """Raise unless the one row of df has the expected values."""
    row = df.first().asDict()
    wrong = {k: (row.get(k), v) for k, v in expected.items() if row.get(k) != v}
    if wrong:
        raise CheckFailed(f"golden values differ (found, expected): {wrong}")


def registry_check(found: DataFrame, registry: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Names with values that differ from the registry, or that it doesn't know."""
    known = registry.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = found.join(known, key, "left")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    ok = same[0]
    for s in same[1:]:
        ok = ok & s
    return both.select(key, F.when(F.col(f"__{columns[0]}").isNull(), "unknown").when(~ok, "different").otherwise("ok").alias("state"))


def ranks_disjoint(batches: DataFrame, sample: str, rank: str) -> bool:
    """Whether no sample is read by two ranks."""
    return batches.groupBy(sample).agg(F.countDistinct(rank).alias("n")).where("n > 1").isEmpty()
