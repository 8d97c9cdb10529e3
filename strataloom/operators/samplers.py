"""Which rank reads which sample in which step: closed forms over a sample number, and domain batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import priority


def sequential(spark: SparkSession, total: int, consumed: int, micro: int, ranks: int) -> DataFrame:
    """(sample, micro_batch, rank) of consecutive blocks of micro * ranks samples after `consumed`; the last partial block is dropped."""
    block = micro * ranks
    end = consumed + (total - consumed) // block * block
    at = F.col("sample") - consumed
    rows = spark.range(consumed, max(end, consumed)).select(F.col("id").alias("sample"))
    return rows.withColumns({"micro_batch": F.floor(at / block), "rank": F.floor(at % block / micro)})


def cyclic(spark: SparkSession, total: int, consumed: int, micro: int, ranks: int) -> DataFrame:
    """(epoch, sample, micro_batch, rank) for the epoch under way: each rank has a contiguous chunk and goes on where it stopped."""
    active = total - total % (micro * ranks)
    done = consumed % active
    chunk, start = active // ranks, done // ranks
    rows = spark.range(active).select(F.lit(consumed // active).alias("epoch"), F.col("id").alias("sample"), F.floor(F.col("id") / chunk).alias("rank"))
    inside = F.col("sample") - F.col("rank") * chunk
    return rows.where(inside >= start).withColumn("micro_batch", F.floor((inside - start) / micro))


def random_buckets(spark: SparkSession, total: int, consumed: int, micro: int, ranks: int, seed: int = 42) -> DataFrame:
    """As cyclic(), but each rank reads its chunk in a hash order of (epoch, sample)."""
    from .prefix import numbered

    active = total - total % (micro * ranks)
    epoch, done = consumed // active, consumed % active
    chunk, start = active // ranks, done // ranks
    rows = spark.range(active).select(F.lit(epoch).alias("epoch"), F.col("id").alias("sample"), F.floor(F.col("id") / chunk).alias("rank"))
    rows = rows.withColumn("__tie", priority("sampler", F.col("epoch"), F.col("sample"), seed=seed))
    placed = numbered(rows, "__tie", "__n", ["rank"])
    return placed.where(F.col("__n") >= start).select("epoch", "sample", "rank", F.floor((F.col("__n") - start) / micro).alias("micro_batch"))


def strided(spark: SparkSession, total: int, ranks: int, wrap: bool = False) -> DataFrame:
    """(slot, sample, rank): slot i goes to rank i % ranks; with wrap, slots are rounded up and start over at the first samples."""
    slots = -(-total // ranks) * ranks if wrap else total
    return spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") % total).alias("sample"), (F.col("id") % ranks).alias("rank"))


def skip(df: DataFrame, position: str, batches: int, ranks: int) -> DataFrame:
    """Rows of a rank after what it has read when resuming."""
    return df.where(F.col(position) >= batches // ranks)


def batches(total: Column, micro: int, ranks: int, drop_last: bool = True) -> Column:
    return F.floor(total / (micro * ranks)) if drop_last else F.ceil(total / (micro * ranks))


def apportion(weights: Sequence[float], size: int) -> list[int]:
    """Samples by domain in a batch: half-even rounding, at least one each, repaired to the size at the largest remainders."""
    exact = [w * size for w in weights]
    counts = [max(1, round(x)) for x in exact]
    while sum(counts) != size:
        up = sum(counts) < size
        order = sorted(range(len(counts)), key=lambda d: ((exact[d] - counts[d]) * (-1 if up else 1), d))
        d = next(i for i in order if up or counts[i] > 1)
        counts[d] += 1 if up else -1
    return counts


def domain_batches(spark: SparkSession, weights: Sequence[float], lengths: Sequence[int], size: int, ranks: int) -> DataFrame:
    """(step, rank, domain, sample): each step takes the next samples of each domain, domains in order, dealt to ranks in equal
    parts; it ends before the first step in which a domain has too few left."""
    counts = apportion(weights, size)
    steps = min(n // c for n, c in zip(lengths, counts, strict=True))
    starts = [sum(counts[:d]) for d in range(len(counts))]
    rows = [F.struct(F.lit(d).alias("domain"), F.lit(c).cast("long").alias("count"), F.lit(s).cast("long").alias("start")) for d, (c, s) in enumerate(zip(counts, starts, strict=True))]
    table = spark.range(steps).select(F.col("id").alias("step"), F.explode(F.array(*rows)).alias("d")).select("step", "d.*")
    table = table.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    return table.select("step", F.floor((F.col("start") + F.col("k")) / (size // ranks)).alias("rank"), "domain", (F.col("step") * F.col("count") + F.col("k")).alias("sample"))
