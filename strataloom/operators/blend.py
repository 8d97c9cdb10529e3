"""Blending of datasets: which dataset and which of its samples stands at each position."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normalised(weights: Sequence[float]) -> list[float]:
    total = sum(weights)
    if total <= 0:
        raise ValueError("the sum of weights must be positive")
    return [w / total for w in weights]


def sample_counts(weights: Sequence[float], samples: int) -> list[int]:
    """Samples to prepare for each dataset: half a percent more than its share."""
    return [math.ceil(samples * w * 1.005) for w in normalised(weights)]


def greedy(spark: SparkSession, weights: Sequence[float], lengths: Sequence[int], n: int) -> DataFrame:
    """(pos, ds, ds_sample): at each position the dataset that is furthest behind its weight, the first on ties. Sequential by
    definition, so one task generates it, batch by batch, in memory that doesn't grow with n."""
    w = list(normalised(weights))

    def walk(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for _ in batches:
            pass
        taken = [0] * len(w)
        for start in range(0, n, 1 << 16):
            size = min(1 << 16, n - start)
            ds, at = np.empty(size, np.int32), np.empty(size, np.int64)
            for k in range(size):
                i = max(start + k, 1)
                best, most = 0, -math.inf
                for d, (x, t) in enumerate(zip(w, taken, strict=True)):
                    if x * i - t > most:
                        best, most = d, x * i - t
                ds[k], at[k] = best, taken[best] % lengths[best]
                taken[best] += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + size)), pa.array(ds), pa.array(at)], ["pos", "ds", "ds_sample"])

    return spark.range(1, numPartitions=1).mapInArrow(walk, "pos long, ds int, ds_sample long")


def bins(weights: Sequence[float], weight_bins: int) -> list[tuple[int, int, int]]:
    """(bin, ds, bias): each dataset has bins in proportion; those left by rounding go to the last, with new biases."""
    out: list[tuple[int, int, int]] = []
    for d, w in enumerate(normalised(weights)):
        out += [(len(out) + k, d, k) for k in range(int(w * weight_bins))]
    last = max(d for _, d, _ in out)
    have = sum(d == last for _, d, _ in out)
    return out + [(len(out) + k, last, have + k) for k in range(weight_bins - len(out))]


def bin_blend(spark: SparkSession, weights: Sequence[float], lengths: Sequence[int], n: int, weight_bins: int = 100) -> DataFrame:
    """(pos, ds, ds_sample) in closed form: no position depends on another."""
    weight_bins = min(weight_bins, n)
    table = bins(weights, weight_bins)
    size = {d: sum(x[1] == d for x in table) for d in range(len(weights))}
    if not all(size.values()):
        raise ValueError("a dataset has no bin; raise weight_bins")
    array = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    at = (F.col("pos") % weight_bins).cast("int")
    ds = F.get(array([d for _, d, _ in table], "int"), at)
    rows = spark.range(n).select(F.col("id").alias("pos")).withColumn("ds", ds)
    bias = F.get(array([b for *_, b in table], "long"), at)
    step = F.get(array([size[d] for d in size], "long"), F.col("ds"))
    return rows.withColumn("ds_sample", (bias + F.floor(F.col("pos") / weight_bins) * step) % F.get(array(lengths, "long"), F.col("ds")))


def largest_remainder(spark: SparkSession, weights: Sequence[float], lengths: Sequence[int], n: int, seed: int = 42) -> DataFrame:
    """(pos, ds, ds_sample): each dataset has its rounded share (largest remainders up), positions are in hash order, and a dataset's
    samples run on along them, wrapping at its length."""
    from ..functions.hashing import priority
    from .prefix import numbered

    exact = [w * n for w in normalised(weights)]
    counts = [int(x) for x in exact]
    for d in sorted(range(len(exact)), key=lambda d: (counts[d] - exact[d], d))[: n - sum(counts)]:
        counts[d] += 1
    table = spark.createDataFrame([(d, c, lengths[d]) for d, c in enumerate(counts) if c], "ds int, c long, length long")
    rows = table.select("ds", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("k"))
    rows = rows.withColumn("__tie", priority("blend", F.col("ds"), F.col("k"), seed=seed))
    placed = numbered(numbered(rows, "__tie", "pos"), "__tie", "__nth", ["ds"])
    return placed.select("pos", "ds", (F.col("__nth") % F.col("length")).alias("ds_sample"))


def stage_offset(blend: DataFrame, consumed: DataFrame, seq_len: int) -> DataFrame:
    """Shift samples by what earlier stages consumed of the same folder: consumed (ds, tokens)."""
    shift = consumed.groupBy("ds").agg(F.floor(F.sum("tokens") / seq_len).alias("__shift"))
    return blend.join(shift, "ds", "left").withColumn("ds_sample", F.col("ds_sample") + F.coalesce("__shift", F.lit(0))).drop("__shift")


def consumption(blend: DataFrame, low: int, high: int, seq_len: int) -> DataFrame:
    """Tokens each dataset gives to positions [low, high)."""
    return blend.where((F.col("pos") >= low) & (F.col("pos") < high)).groupBy("ds").agg((F.count("*") * seq_len).alias("tokens"))


def stage_of(steps: DataFrame, step: str, stages: Sequence[tuple[str, int]]) -> DataFrame:
    """Add the stage that each step is in, and the steps of it that remain; stages are (name, first step) in order."""
    bounds = [*stages[1:], (None, None)]
    name, rest = F.lit(None).cast("string"), F.lit(None).cast("long")
    for (own, first), (_, after) in zip(stages, bounds, strict=True):
        inside = F.col(step) >= first if after is None else (F.col(step) >= first) & (F.col(step) < after)
        name = F.when(inside, own).otherwise(name)
        rest = F.when(inside, F.lit(after) - F.col(step) if after is not None else F.lit(None)).otherwise(rest)
    return steps.withColumns({"stage": name, "remaining": rest.cast("long")})


def capacity(needed: DataFrame, available: DataFrame) -> DataFrame:
    """Whether each dataset has the samples that are asked of it."""
    both = needed.join(available, "ds", "left")
    return both.withColumn("enough", F.coalesce(F.col("available") >= F.col("needed"), F.lit(False)))

