"""Running sums along a total order, and the budget fills made of them.

A window over a whole table would sort it in one task. Here rows are dealt to ranges of the order, whose bounds are quantiles of a
sample: the row of least hash in each of many cells, so the same rows whatever the partitioning. Bounds compare the whole key in its
own types, so a heavy score is dealt on by the tie key. Ranges have totals, a small table, whose running sums are the offsets of sums
inside each range. One shuffle moves the rows, whatever their number; building the plan starts no job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled rows a range: a range's size strays by about a quarter of the mean.
SAMPLES = 16


def _order(df: DataFrame, score: str | None, tie: str | Sequence[str]) -> tuple[list[Column], list[Column]]:
    """The key as columns that are compared in ascending order, and the sort order that says the same: score descending (NaN first,
    null last), then ties ascending (null first)."""
    ties = [F.col(f"`{t}`") for t in ([tie] if isinstance(tie, str) else tie)]
    if score is None:
        return ties, [t.asc() for t in ties]
    value, kind = F.col(f"`{score}`"), df.schema[score].dataType
    if isinstance(kind, T.IntegralType):
        falling = [value.isNull(), F.bitwise_not(value)]
    elif isinstance(kind, T.FractionalType):
        nan = [] if isinstance(kind, T.DecimalType) else [~F.coalesce(F.isnan(value), F.lit(False))]
        falling = [value.isNull(), *nan, -value]
    else:
        raise TypeError(f"a score is a number, not {kind.simpleString()}")
    return [*falling, *ties], [value.desc(), *(t.asc() for t in ties)]


def with_range(df: DataFrame, score: str | None, tie: str | Sequence[str], parts: int | None = None, out: str = "__range") -> DataFrame:
    """Add the number of the row's range of the order: as many ranges as shuffle partitions, of about as many rows each."""
    parts = parts or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys, _ = _order(df, score, tie)
    names = [f"k{i}" for i in range(len(keys))]
    hashed = df.select(F.xxhash64(*keys).alias("h"), *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    # aggregates of fixed-width values, which hash aggregation keeps in place: at most parts * SAMPLES rows a task
    cells = hashed.groupBy(F.pmod("h", F.lit(parts * SAMPLES)).alias("cell")).agg(*[F.min_by(n, "h").alias(n) for n in names])
    sample = F.array_sort(F.collect_list(F.struct(*names)))
    at = F.sequence(F.lit(1), F.lit(parts - 1))
    bounds = cells.agg(sample.alias("s")).select(F.transform(at, lambda i: F.get("s", F.floor(i * F.size("s") / parts).cast("int"))).alias("b")).scalar()
    key = F.struct(*[k.alias(n) for k, n in zip(keys, names, strict=True)])
    found = df.withColumn(out, F.lit(0))
    for s in (1 << i for i in reversed(range((parts - 1).bit_length()))):  # binary search: the number of bounds at or before the row
        at_or_after = (F.col(out) + s < parts) & (F.get(bounds, F.col(out) + (s - 1)) <= key)
        found = found.withColumn(out, F.col(out) + F.when(at_or_after, s).otherwise(0))
    return found


def running_sum(df: DataFrame, score: str | None, tie: str | Sequence[str], length: str, out: str = "cum", strata: Sequence[str] = (), rank: str | None = None) -> DataFrame:
    """Add the sum of length over all rows up to and including each, by score descending then tie ascending (without a score: by tie
    alone), in each stratum; and the 1-based position, if rank names it. Score and ties together must be unique. Null strata are a stratum."""
    ranged = with_range(df, score, tie)
    totals = ranged.groupBy(*strata, "__range").agg(F.sum(length).alias("__sum"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*strata).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    same = [f"__s{i}" for i in range(len(strata))]
    offsets = totals.select(
        *[F.col(f"`{s}`").alias(n) for s, n in zip(strata, same, strict=True)], F.col("__range").alias("__r"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__ahead"),
    )
    inside = Window.partitionBy(*strata, "__range").orderBy(*_order(df, score, tie)[1])
    to_here = inside.rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({"__own": F.sum(length).over(to_here), "__nth": F.row_number().over(inside)})
    on = F.col("__range") == F.col("__r")
    for s, n in zip(strata, same, strict=True):
        on = on & F.col(f"`{s}`").eqNullSafe(F.col(n))
    joined = summed.join(offsets, on).withColumn(out, F.col("__own") + F.col("__before"))
    if rank:
        joined = joined.withColumn(rank, F.col("__nth") + F.col("__ahead"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in (out, rank)], out, *([rank] if rank else []))


def numbered(df: DataFrame, tie: str | Sequence[str], out: str, strata: Sequence[str] = ()) -> DataFrame:
    """Add each row's 0-based position in the order of the tie key."""
    return running_sum(df.withColumn("__one", F.lit(1)), None, tie, "__one", out, strata).withColumn(out, F.col(out) - 1).drop("__one")


def previous(df: DataFrame, tie: str | Sequence[str], value: str, out: str) -> DataFrame:
    """Add the value of the row before, in the order of the tie key; null at the first."""
    ranged = with_range(df, None, tie)
    keys = F.struct(*_order(df, None, tie)[0])
    ends = ranged.groupBy(F.col("__range").alias("__r")).agg(F.max_by(F.struct(value), keys).alias("__end"))
    ends = ends.select("__r", F.lag("__end").over(Window.orderBy("__r")).alias("__end"))  # one row a range
    inside = Window.partitionBy("__range").orderBy(*_order(df, None, tie)[1])
    near = ranged.withColumn("__near", F.lag(F.struct(value)).over(inside)).join(ends, F.col("__range") == F.col("__r"))
    return near.withColumn(out, F.coalesce("__near", "__end")[value]).drop("__near", "__end", "__range", "__r")


def total(df: DataFrame, length: str) -> Column:
    """The sum of a column as a value that is found when the query runs; 0 of no rows."""
    return df.agg(F.coalesce(F.sum(length), F.lit(0))).scalar()


def budget_fill(df: DataFrame, score: str | None, tie: str, length: str, target: int | Column, out: str = "cum", strata: Sequence[str] = ()) -> DataFrame:
    """Whole rows along the order, up to and including the first whose running sum reaches the target (by stratum, the target may
    be a column)."""
    summed = running_sum(df, score, tie, length, out, strata)
    return summed.where(F.col(out) - F.col(length) < target)


def shortfall(filled: DataFrame, length: str, target: int) -> int:
    """Tokens missing to the target: 0 if it was reached."""
    return max(0, target - (filled.agg(F.sum(length)).first()[0] or 0))


def chained_fill(df: DataFrame, score: str | None, tie: str, length: str, targets: Sequence[int], out: str = "stage") -> DataFrame:
    """Fills one after another along the same order; each starts at the row after the one before ended, so its target shifts by
    that one's overshoot. Rows past all fills go. A boundary is an aggregate of the one running sum."""
    summed = running_sum(df, score, tie, length, "cum")
    stage, ended = F.lit(None).cast("int"), F.lit(0)
    for i, target in enumerate(targets):
        reached = summed.where((F.col("cum") - F.col(length) < ended + target)).agg(F.coalesce(F.max("cum"), F.lit(0))).scalar()
        stage = F.when((F.col("cum") > ended) & (F.col("cum") <= reached), i + 1).otherwise(stage)
        ended = reached
    return summed.withColumn(out, stage).where(F.col(out).isNotNull())


def quota_fill(df: DataFrame, stratum: str, score: str | None, tie: str, length: str, target: int) -> DataFrame:
    """Quota by stratum, in proportion to its tokens, filled along the order of each; then a global top-up of what is missing.
    Adds cum and pass (1 quota, 2 top-up)."""
    totals = df.groupBy(stratum).agg(F.sum(length).alias("__tokens"))
    quotas = totals.select(F.col(stratum).alias("__stratum"), F.floor(F.lit(target) * F.col("__tokens") / F.greatest(total(df, length), F.lit(1))).alias("quota"))
    first = running_sum(df, score, tie, length, "cum", [stratum]).join(quotas, F.col(stratum).eqNullSafe(F.col("__stratum"))).drop("__stratum")
    taken = first.where(F.col("cum") - F.col(length) < F.col("quota")).drop("quota").withColumn("pass", F.lit(1))
    rest = first.where(F.col("cum") - F.col(length) >= F.col("quota")).select(*df.columns)
    more = budget_fill(rest, score, tie, length, F.lit(target) - total(taken, length))
    return taken.unionByName(more.withColumn("pass", F.lit(2)))


def topup_fill(df: DataFrame, strata: Sequence[str], source: str, score: str | None, tie: str, length: str, quota: str) -> DataFrame:
    """Fill each stratum's quota from sources in order of their number, each by score: one running sum over (source, score)."""
    totals = df.groupBy(*strata, source).agg(F.sum(length).alias("__t"))
    before = Window.partitionBy(*strata).orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*strata, source, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__offset"))
    summed = running_sum(df, score, tie, length, "cum", [*strata, source]).join(offsets, [*strata, source])
    summed = summed.withColumn("cum", F.col("cum") + F.col("__offset")).drop("__offset")
    return summed.where(F.col("cum") - F.col(length) < F.col(quota))


def top_share(df: DataFrame, score: str | None, tie: str, length: str, share: float) -> DataFrame:
    """The first rows that hold a share of all tokens."""
    return budget_fill(df, score, tie, length, F.lit(share) * total(df, length))


def boundary(filled: DataFrame, whole: DataFrame, key: str, score: str, tie: str, length: str) -> DataFrame:
    """One row about where a fill stopped: documents, tokens, last score, rows at that score in all and selected, and the next row."""
    last = filled.agg(F.count("*").alias("docs"), F.sum(length).alias("tokens"), F.min_by(score, F.struct(F.col(score).cast("double"), -F.col(tie))).alias("last_score"))
    at_last = lambda df: df.join(F.broadcast(last.select("last_score")), F.col(score) == F.col("last_score"), "left_semi")  # noqa: E731  one row
    rest = whole.join(filled.select(key), key, "left_anti")
    following = rest.agg(F.max_by(key, F.struct(F.col(score).cast("double"), -F.col(tie))).alias("next_key"))
    counts = at_last(whole).agg(F.count("*").alias("cluster_docs")), at_last(filled).agg(F.count("*").alias("cluster_selected"))
    one = F.lit(1).alias("__one")
    out = last.select("*", one)
    for part in (*counts, following):
        out = out.join(part.select("*", one), "__one")  # one row each
    return out.drop("__one")
