"""Sharding by extendible hashing.

A row's shard is a prefix of its hash bits. The directory starts with one shard, and only a shard over the byte limit splits on
another bit, until each fits or holds one row. The splits are found from a histogram of bytes by hash prefix, a few bits finer
than the mean shard needs, and repeated on deeper bits for those prefixes alone that are still too large. The directory stays a
DataFrame; rows find their shard by an equi-join on the histogram's prefix, which carries no text.

Defined results: null text counts as 0 bytes. The hash is of id and text, so rows that repeat an id part; rows equal in both have
one hash and stay together, the one case (beside a single row over the limit) in which a shard may exceed it. A very long text is one
row of a shard, only its size and digest move. An empty table has no shards. Extra columns may have any name but shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

HASH_BITS = 60
LIMIT_BYTES = 32 << 20


def _hash(key: str, text: str) -> Column:
    """60 bits of md5 over id and text digest."""
    whole = F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    return F.conv(F.substring(whole, 1, 15), 16, 10).cast("long")


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bytes, hash)"""
    size = F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long")
    return docs.select(F.col(f"`{key}`").alias("doc_id"), size.alias("bytes"), _hash(key, text).alias("hash"))


def _prefix(depth: Column) -> Column:
    return F.call_function("shiftright", F.col("hash"), (F.lit(HASH_BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int = LIMIT_BYTES, extra_bits: int = 4) -> list[tuple[int, DataFrame]]:
    """[(bits, cells)], cells: (cell, depth, shard_bytes, shard_docs) by hash prefix of that many bits; cells still too large have
    no row but go on in the next entry, with more bits."""
    total = rows.agg(F.sum("bytes"), F.count("*")).first()
    if not total[1]:
        return []
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total[0]) / limit + 1))) + extra_bits)
    done, least, found = None, 0, []
    while True:
        source = rows if done is None else _unsettled(rows, found)
        cells = source.groupBy(_prefix(F.lit(bits)).alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        depths = F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("depth")
        up = cells.select("cell", "b", "n", depths).withColumn("at", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int")))
        sums = up.groupBy("depth", "at").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == HASH_BITS)
        best = up.select("cell", "depth", "at").join(sums.where(fits), ["depth", "at"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("x"))
        settled = checkpointed(best.select("cell", "x.depth", "x.shard_bytes", "x.shard_docs"))
        found.append((bits, settled))
        # the settled cells' bytes and rows tell whether any cell is left
        shards = settled.select("depth", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int")).alias("at"), "shard_docs").distinct()
        counted = (shards.agg(F.sum("shard_docs")).first()[0] or 0) + (done or 0)
        if bits == HASH_BITS or counted >= total[1]:
            return found
        done, least, bits = counted, bits + 1, min(HASH_BITS, bits + 8)


def _unsettled(rows: DataFrame, found: list[tuple[int, DataFrame]]) -> DataFrame:
    for bits, cells in found:
        rows = rows.withColumn("cell", _prefix(F.lit(bits))).join(cells.select("cell"), "cell", "left_anti").drop("cell")
    return rows


def assign(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, shard_docs); shard is the prefix as a string of depth bits."""
    rows = hashed(docs, key, text)
    return _located(rows, directory(rows, limit)).select("doc_id", "bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs")


def _located(rows: DataFrame, found: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows, which have a hash, with shard, depth, shard_bytes and shard_docs, by an equi-join on the hash prefix."""
    out = None
    for n, (bits, cells) in enumerate(found):
        part = _unsettled(rows, found[:n]).withColumn("cell", _prefix(F.lit(bits))).join(cells, "cell").drop("cell")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select("*", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs"))
    shard = F.substring(F.lpad(F.conv(F.col("hash").cast("string"), 10, 2), HASH_BITS, "0"), F.lit(1), F.col("depth"))
    return out.withColumn("shard", shard)


def write(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """Write docs to a folder for each shard (a column called shard is replaced). A row's hash goes with it, so rows that repeat an id
    keep their own shards. Each shard is one task's output, so its size is bounded by the limit."""
    columns = [c for c in docs.columns if c != "shard"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), _hash(key, text).alias("hash"))
    located = _located(rows, directory(hashed(docs, key, text), limit)).select("row.*", F.concat(F.lit("s"), "shard").alias("shard"))
    located.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
