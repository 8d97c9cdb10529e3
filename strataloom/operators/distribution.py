"""Aggregates over strata, lengths and tensors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import percentiles_by


def strata_share(df: DataFrame, stratum: str, weight: str, strata: DataFrame | None = None) -> DataFrame:
    """Documents, tokens and their shares by stratum; strata that have no row are 0 if a table of all is given."""
    by = df.groupBy(stratum).agg(F.count("*").alias("docs"), F.sum(weight).alias("tokens"))
    if strata is not None:
        by = strata.select(stratum).distinct().join(by, stratum, "left").na.fill(0, ["docs", "tokens"])
    whole = Window.partitionBy()  # one row a stratum
    return by.withColumns({"doc_share": F.col("docs") / F.sum("docs").over(whole), "token_share": F.col("tokens") / F.sum("tokens").over(whole)})


def divergence(p: DataFrame, q: DataFrame, stratum: str, share: str) -> DataFrame:
    """One row: total variation and Jensen-Shannon divergence in bits of two share tables."""
    both = p.select(stratum, F.col(share).alias("p")).join(q.select(stratum, F.col(share).alias("q")), stratum, "full").na.fill(0.0, ["p", "q"])
    mid = (F.col("p") + F.col("q")) / 2
    bits = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mid)).otherwise(0.0)
    return both.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"), (F.sum(bits("p") + bits("q")) / 2).alias("js_bits"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """2 x 2 counts with margins; a margin's flag is null."""
    return df.cube(a, b).agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, value: str, at: Sequence[float]) -> DataFrame:
    """(p, value) by linear interpolation, with mean and population standard deviation."""
    found = percentiles_by(df, value, at).select(F.explode(F.arrays_zip(F.lit(list(at)).alias("p"), F.col("p").alias("v"))).alias("x"))
    return found.select("x.p", F.col("x.v").alias("value"), df.agg(F.avg(value)).scalar().alias("mean"), df.agg(F.stddev_pop(value)).scalar().alias("std"))


def floor_quantile(ordered: DataFrame, position: str, value: str, at: Sequence[float]) -> DataFrame:
    """Order statistics at floor(x (n - 1)), from a table that has each row's 1-based position."""
    n = ordered.agg(F.count("*")).scalar()
    points = ordered.sparkSession.createDataFrame([(float(x),) for x in at], "x double")
    wanted = points.withColumn("__at", F.floor(F.col("x") * (n - 1)) + 1)
    return ordered.join(F.broadcast(wanted), F.col(position) == F.col("__at")).select("x", value)  # a row a quantile


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur so many times."""
    return df.groupBy(key).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("keys"))


def tensor_stats(value: str) -> list[Column]:
    """Mean, sample deviation, extremes, norms, share near zero, and excess kurtosis with the sample deviation; those of an empty
    tensor are 0, but the share near zero is 1."""
    x = F.col(value)
    n = F.count(value)
    kurtosis = (F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2)) - 3
    stats = {
        "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "norm_l1": F.sum(F.abs(x)), "norm_l2": F.sqrt(F.sum(x * x)),
        "zero_frac": F.avg((F.abs(x) < 1e-10).cast("double")), "kurtosis": F.when(F.stddev_samp(x) > 0, kurtosis).otherwise(0.0),
    }
    return [F.coalesce(c, F.lit(1.0 if k == "zero_frac" else 0.0)).alias(k) for k, c in stats.items()]


def masked_mean(value: Column, mask: Column) -> Column:
    """Sum of masked values over the number of them; NaN where there is none."""
    n = F.sum(mask.cast("double"))
    return F.when(n > 0, F.sum(value * mask.cast("double")) / n).otherwise(F.lit(float("nan")))


def group_z(df: DataFrame, group: Column, hit: Column) -> DataFrame:
    """Rate of a flag by group with the binomial z-score against the overall rate."""
    by = df.groupBy(group.alias("grp")).agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("hits"))
    whole = Window.partitionBy()  # one row a group
    p = F.sum("hits").over(whole) / F.sum("n").over(whole)
    by = by.withColumn("p", p)
    spread = F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return by.withColumns({"rate": F.col("hits") / F.col("n"), "z": F.when(spread > 0, (F.col("hits") / F.col("n") - F.col("p")) / spread).otherwise(0.0)})


def length_bins(df: DataFrame, value: str, hit: Column, edges: Sequence[int]) -> DataFrame:
    """Rate of a flag by fixed bins [lo, hi)."""
    chain = F.lit(None).cast("int")
    for lo, hi in reversed(list(zip(edges, [*edges[1:], None], strict=True))):
        inside = F.col(value) >= lo if hi is None else (F.col(value) >= lo) & (F.col(value) < hi)
        chain = F.when(inside, lo).otherwise(chain)
    return df.groupBy(chain.alias("lo")).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("rate"))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def profile(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Means, least values and medians by group."""
    out = df.groupBy(group).agg(F.count("*").alias("docs"), *[f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("min", F.min))])
    for v in values:
        median = percentiles_by(df, v, [0.5], [group]).select(F.col(group).alias("__group"), F.get("p", F.lit(0)).alias(f"median_{v}"))
        out = out.join(median, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")
    return out


def normal_equations(df: DataFrame, vector: str, target: str):
    """X'X and X'y in numpy, X the L2-normalised vectors (null or zero ones count as zeros). Each task sums its own rows' products; the sums,
    of dimensions squared, are added up by tree, whatever the rows."""
    import numpy as np

    def own(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for one in batches:
            rows = [v for v in one.column(0).to_pylist() if v]
            if not rows:
                continue
            x = np.array(rows, float)
            y = np.array([t or 0.0 for v, t in zip(one.column(0).to_pylist(), one.column(1).to_pylist(), strict=True) if v])
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            part = np.column_stack([x.T @ x, x.T @ y])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.shape[0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["dims", "sums"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, dims = None, 0
        for one in batches:
            for n, b in zip(one.column(0).to_pylist(), one.column(1).to_pylist(), strict=True):
                part = np.frombuffer(b)
                total, dims = (part if total is None else total + part), n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["dims", "sums"])

    schema = "dims int, sums binary"
    parts = df.select(F.col(vector), F.col(target).cast("double")).mapInArrow(own, schema)
    found = parts.repartition(16).mapInArrow(add, schema).collect()  # at most 16 rows of fixed size
    if not found:
        return np.zeros((0, 0)), np.zeros(0)
    whole = sum(np.frombuffer(bytes(r.sums)) for r in found).reshape(found[0].dims, found[0].dims + 1)
    return whole[:, :-1], whole[:, -1]
