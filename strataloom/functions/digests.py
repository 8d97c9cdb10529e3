"""sha256 over a whole column in an order, byte for byte as a one-pass program makes it, so that digests can be compared with published ones.

A digest of this kind is sequential by definition. Rows are dealt to ranges of the order and sorted there in parallel, each range packs
its bytes into blocks, and one task streams over the blocks in order, in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import with_range

BLOCK_BYTES = 1 << 20


def little_endian(value: Column) -> Column:
    """The 8 bytes of a long, least first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8))))


def streamed(df: DataFrame, order: str | Sequence[str], piece: Column) -> DataFrame:
    """One row (n, digest): rows, and the hex sha256 of the pieces (binary) one after another in the order, whose key must be unique."""
    names = [order] if isinstance(order, str) else list(order)
    ranged = with_range(df.select(*names, piece.alias("__piece")), None, names).repartition("__range").sortWithinPartitions("__range", *names)

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(at: int, seq: int, rows: int, held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([seq], pa.int64()), pa.array([rows], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["part", "seq", "n", "bytes"])

        at, seq, held, size = -1, 0, [], 0
        for one in batches:
            for r, b in zip(one.column("__range").to_pylist(), one.column("__piece").to_pylist(), strict=True):
                if r != at or size >= BLOCK_BYTES:
                    if held:
                        yield out(at, seq, len(held), held)
                    at, seq, held, size = r, seq + 1 if r == at else 0, [], 0
                held.append(b or b"")
                size += len(b or b"")
        if held:
            yield out(at, seq, len(held), held)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        digest, n = hashlib.sha256(), 0
        for one in batches:
            for rows, b in zip(one.column("n").to_pylist(), one.column("bytes").to_pylist(), strict=True):
                digest.update(b)
                n += rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["n", "digest"])

    blocks = ranged.select("__range", "__piece").mapInArrow(pack, "part int, seq long, n long, bytes binary")
    found = blocks.repartition(1).sortWithinPartitions("part", "seq").mapInArrow(run, "n long, digest string")
    return found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))  # a row of no rows too


def id_digest(df: DataFrame, key: str, order: str | Sequence[str] | None = None) -> DataFrame:
    """sha256 over ids as little-endian longs: in the given order, or, if none is given, sorted (the digest of the set)."""
    return streamed(df, order or key, little_endian(F.col(key)))


def rolling_digest(df: DataFrame, key: str, value: Column) -> DataFrame:
    """sha256 over lines `id:hash` in the order of ids."""
    return streamed(df, key, F.concat(F.col(key).cast("string"), F.lit(":"), value, F.lit("\n")).cast("binary"))


def named_digest(df: DataFrame, name: str, value: Column) -> DataFrame:
    """(name, sha256) by logical name, and under the name `*` the digest over all lines `name:sha256` in order: the same whatever the
    files that hold the values."""
    own = df.groupBy(F.col(name).alias("name")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(value.cast("string"))), ","), 256).alias("sha256"))
    whole = streamed(own, "name", F.concat("name", F.lit(":"), "sha256", F.lit("\n")).cast("binary")).select(F.lit("*").alias("name"), F.col("digest").alias("sha256"))
    return own.unionByName(whole)
