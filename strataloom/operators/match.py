"""Joins between corpora and passes: lookups that must match, prefix matching, removal, pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import prefix_key
from .prefix import numbered
from .rank import dense_code as codes_of


class Unmatched(ValueError):
    """A lookup that had to match every row did not."""


def lookup(df: DataFrame, table: DataFrame, key: str | Sequence[str], must_match: bool = False) -> DataFrame:
    """Left join; with must_match, raises if a row finds nothing, and so must have a key that is unique in the table."""
    keys = [key] if isinstance(key, str) else list(key)
    joined = df.join(table.withColumn("__hit", F.lit(1)), keys, "left")
    if must_match and (missing := joined.where("__hit is null").count()):
        raise Unmatched(f"{missing} rows match nothing on {keys}")
    return joined.drop("__hit")


def match_report(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """One row: rows, and rows that match nothing."""
    hit = df.join(table.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    return hit.agg(F.count("*").alias("n_rows"), F.count_if(F.col("__hit").isNull()).alias("unmatched"))


def prefix_matches(small: DataFrame, pool: DataFrame, key: str, pool_key: str, text: str, length: int) -> DataFrame:
    """(key, pool_key) of all pairs with an equal prefix of so many characters; many to many. Texts don't move: only hashes do."""
    a = small.select(key, prefix_key(F.col(text), length).alias("__h"))
    b = pool.select(pool_key, prefix_key(F.col(text), length).alias("__h"))
    return b.join(a, "__h").select(key, pool_key)


def match_histogram(small: DataFrame, pool: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """How many keys match nothing, one or more pool rows. Pool prefixes are counted before the join, so a hot one is one row."""
    counts = pool.groupBy(prefix_key(F.col(text), length).alias("__h")).count()
    hits = small.select(key, prefix_key(F.col(text), length).alias("__h")).join(counts, "__h", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    return hits.groupBy(F.when(F.col("n") > 1, ">1").otherwise(F.col("n").cast("string")).alias("matches")).agg(F.count("*").alias("keys"))


def repeated_prefixes(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Rows whose prefix a row with a smaller key has."""
    first = df.groupBy(prefix_key(F.col(text), length).alias("__h")).agg(F.min(key).alias("__first"))
    return df.select(key, prefix_key(F.col(text), length).alias("__h")).join(first, "__h").where(F.col(key) > F.col("__first")).select(key)


def remove_renumber(df: DataFrame, key: str, removed: DataFrame, shard_rows: int, out: str = "new_id") -> DataFrame:
    """Anti join, then dense 0-based ids in the order of the key, and shards of so many rows. The dense id is a scalable prefix sum."""
    kept = df.join(removed.select(key), key, "left_anti")
    return numbered(kept, key, out).withColumn("shard", F.floor(F.col(out) / shard_rows))


def pair_passes(first: DataFrame, second: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """second with the columns of first for the same key, suffixed; raises if a key is missing."""
    renamed = first.select(key, *[F.col(c).alias(f"{c}_first") for c in columns])
    return lookup(second, renamed, key, must_match=True)


def cross_pass(first: DataFrame, second: DataFrame, key: str, status: str, weight: str) -> DataFrame:
    """Documents and tokens by status in two passes; a row that one pass lacks has null there."""
    a = first.select(key, F.col(status).alias("status_a"), F.col(weight).alias("__wa"))
    b = second.select(key, F.col(status).alias("status_b"), F.col(weight).alias("__wb"))
    both = a.join(b, key, "full")
    return both.groupBy("status_a", "status_b").agg(F.count("*").alias("docs"), F.sum(F.coalesce("__wa", "__wb")).alias("tokens"))


def any_equal(df: DataFrame, originals: DataFrame, key: str, text: str) -> DataFrame:
    """Per key, whether the text equals any of the originals of that key (1:n)."""
    a = df.select(key, F.sha2(F.col(text), 256).alias("__a"))
    b = originals.select(key, F.sha2(F.col(text), 256).alias("__b"))
    return a.join(b, key, "left").groupBy(key).agg(F.coalesce(F.bool_or(F.col("__a") == F.col("__b")), F.lit(False)).alias("any_equal"))


def differences(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys where two tables differ: present in one side only, or with a null-safe difference."""
    left = a.select(key, F.struct(*columns).alias("__a"))
    right = b.select(key, F.struct(*columns).alias("__b"))
    both = left.join(right, key, "full")
    side = F.when(F.col("__a").isNull(), "right only").when(F.col("__b").isNull(), "left only").when(~F.col("__a").eqNullSafe(F.col("__b")), "different")
    return both.select(key, side.alias("difference")).where("difference is not null")


def alignment(copies: dict[str, DataFrame], key: str, text: str, length: int = 256) -> DataFrame:
    """Positions whose text prefix is not the same in all copies, or that a copy lacks."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, (df.select(key, F.lit(n).alias("copy"), F.sha2(F.substring(F.col(text), 1, length), 256).alias("h")) for n, df in copies.items()))
    by = rows.groupBy(key).agg(F.countDistinct("h").alias("hashes"), F.countDistinct("copy").alias("n_copies"))
    return by.where((F.col("hashes") > 1) | (F.col("n_copies") < len(copies)))


def locate(points: DataFrame, at: str, files: DataFrame, start: str, size: str) -> DataFrame:
    """The file that holds each offset. Both sides are cut to equal blocks of the offset axis, so that the range join is an equi-join
    on the block; a file joins each block it spans."""
    block = files.agg(F.max(size)).first()[0] or 1
    spans = files.withColumn("__block", F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.col(start) + F.greatest(F.col(size), F.lit(1)) - 1) / block))))
    keyed = points.withColumn("__block", F.floor(F.col(at) / block))
    return keyed.join(spans, "__block").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(size))).drop("__block")


def overlapping(files: DataFrame, start: str, end: str, low: int, high: int) -> DataFrame:
    """Files whose span [start, end) meets [low, high)."""
    return files.where(F.greatest(F.col(start), F.lit(low)) < F.least(F.col(end), F.lit(high)))


def pivot_prompts(df: DataFrame, key: str, prompt: str, value: str, prompts: Sequence[str]) -> DataFrame:
    """One row a key, a column a prompt."""
    return df.groupBy(key).pivot(prompt, list(prompts)).agg(F.first(value))


def dense_code(df: DataFrame, value: str, out: str, size: int | None = None) -> DataFrame:
    """Codes 0.. of the sorted vocabulary; rows with a null value go. size: what the vocabulary must number, or this raises."""
    codes = codes_of(df, value, out)
    if size is not None and (found := codes.count()) != size:
        raise ValueError(f"{value} has {found} values, not {size}")
    return df.join(codes, value)


def take(addresses: DataFrame, shard: str, row: str, table: DataFrame, key: str, rows_a_shard: int, columns: Sequence[str]) -> DataFrame:
    """(shard, row, columns) of rows by positional address; raises if an address has no row."""
    wanted = addresses.select(shard, row, (F.col(shard) * rows_a_shard + F.col(row)).alias("__key"))
    return lookup(wanted, table.select(F.col(key).alias("__key"), *columns), "__key", must_match=True).drop("__key")


def config_differences(a: DataFrame, b: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Keys of two flattened configurations (key, value) that differ or are in one alone, and whether that is allowed."""
    both = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).withColumn("allowed", F.col("key").isin(list(allowed)) if allowed else F.lit(False))


def flatten_config(config: dict, prefix: str = "") -> dict[str, str]:
    """Dotted keys of nested dictionaries and lists."""
    out: dict[str, str] = {}
    for key, value in config.items() if isinstance(config, dict) else enumerate(config):
        name = f"{prefix}{key}"
        if isinstance(value, (dict, list)):
            out |= flatten_config(value, f"{name}.")
        else:
            out[name] = str(value)
    return out

