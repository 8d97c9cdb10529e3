"""Set algebra over id tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import percentiles_by


def exclude(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(key), key, "left_anti"), others, df)


def only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def tagged(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """(set, key) of several id tables."""
    return reduce(DataFrame.unionByName, (ids.select(F.lit(name).alias("set"), key) for name, ids in sets.items()))


def membership(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, bits): bit i for the i-th set. One shuffle, whatever the number of sets."""
    bits = F.create_map(*[x for i, name in enumerate(sets) for x in (F.lit(name), F.lit(1 << i))])
    return tagged(sets, key).groupBy(key).agg(F.bit_or(bits[F.col("set")]).alias("bits"))


def votes(sets: dict[str, DataFrame], key: str) -> DataFrame:
    return membership(sets, key).select(key, F.bit_count("bits").alias("votes"))


def pattern_counts(sets: dict[str, DataFrame], key: str, weights: DataFrame, weight: str) -> DataFrame:
    """Rows and weight by membership pattern."""
    return membership(sets, key).join(weights.select(key, weight), key).groupBy("bits").agg(F.count("*").alias("docs"), F.sum(weight).alias("tokens"))


def overlap_matrix(sets: dict[str, DataFrame], key: str, weights: DataFrame, weight: str) -> DataFrame:
    """For each pair of sets: sizes, intersection, union, by rows and by weight, Jaccard, and coverage of a by b. Made from the
    pattern counts, of which there are at most 2**sets, not from pairs of rows."""
    patterns = pattern_counts(sets, key, weights, weight)
    names = list(sets)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(names) for j, b in enumerate(names)]))
    rows = patterns.select("*", pairs.alias("p")).select("*", "p.*")
    has = lambda c: F.call_function("shiftright", F.col("bits"), F.col(c)).bitwiseAND(1) == 1
    total = lambda condition, column: F.sum(F.when(condition, F.col(column)).otherwise(0))
    agg = rows.groupBy("a", "b").agg(*[total(c, column).alias(f"{n}_{column}") for column in ("docs", "tokens") for n, c in (("a", has("i")), ("b", has("j")), ("both", has("i") & has("j")), ("either", has("i") | has("j")))])
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return agg.withColumns({"jaccard": ratio("both_docs", "either_docs"), "coverage_docs": ratio("both_docs", "a_docs"), "coverage_tokens": ratio("both_tokens", "a_tokens")})


def enrichment(observed: Column, size: Column, part: Column, whole: Column) -> Column:
    """Observed overlap over what a random subset of that size would have."""
    return observed / (size * part / whole)


def domain(sets: dict[str, DataFrame], key: str, at_least: int = 1) -> DataFrame:
    """Ids in at least so many sets: 1 is the union, all is the intersection."""
    return votes(sets, key).where(F.col("votes") >= at_least).select(key)


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have equal rows, with multiplicity."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def subset(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b.select(key), key, "left_anti").isEmpty()


def concat_exclusive(parts: dict[str, DataFrame], key: str, tag: str = "source") -> DataFrame:
    """Union with a tag; raises if parts share a key or repeat one."""
    whole = reduce(DataFrame.unionByName, (df.withColumn(tag, F.lit(name)) for name, df in parts.items()))
    if not whole.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"parts overlap or repeat {key}")
    return whole


def contrast(df: DataFrame, flag: str, value: str, percentiles: Sequence[float]) -> DataFrame:
    """Percentiles of a value for selected and rejected rows."""
    found = percentiles_by(df, value, percentiles, [flag])
    return found.select(flag, "n", *[F.get("p", F.lit(i)).alias(f"p{int(p * 100)}") for i, p in enumerate(percentiles)])
