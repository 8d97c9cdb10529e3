"""Packed shuffles: rows of numpy records travel as a few messages (bucket, part, kind, payload) instead of one row each, so that
the JVM moves and sorts bytes, not billions of tiny rows. Buckets follow the number of shuffle partitions."""

from __future__ import annotations

from collections.abc import Iterator

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets

MESSAGE = "bucket int, part int, kind int, payload binary"


def batch(rows: list[tuple]):
    """An Arrow batch of messages."""
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "part", "kind", "payload"])


def messages(batches: Iterator) -> Iterator[tuple]:
    for one in batches:
        yield from zip(*(c.to_pylist() for c in one.columns), strict=True)


def by_bucket(kind: int, keys: np.ndarray, rows: np.ndarray, n: int, part: int = 0) -> Iterator[tuple]:
    """Messages of rows by key % n."""
    at = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    cuts = np.flatnonzero(np.diff(at, prepend=-1)) if len(at) else []
    for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
        yield int(at[a]), part, kind, rows[a:b].tobytes()


class Outbox:
    """Collects rows of one kind up to a bound, then hands them on by bucket."""

    def __init__(self, kind: int, key: str, n: int, most: int = 1 << 18):
        self.kind, self.key, self.n, self.most = kind, key, n, most
        self.held: list[np.ndarray] = []
        self.size = 0

    def put(self, rows: np.ndarray) -> Iterator:
        if len(rows):
            self.held.append(rows)
            self.size += len(rows)
        if self.size > self.most:
            yield from self.rest()

    def rest(self) -> Iterator:
        if self.held:
            rows = np.concatenate(self.held)
            self.held, self.size = [], 0
            yield batch(list(by_bucket(self.kind, rows[self.key], rows, self.n)))


@cache
def _keys(n: int) -> list[int]:
    """For each of n partitions an integer that Spark's hash partitioning (Murmur3, seed 42) puts there."""
    mask, keys, left, k = (1 << 32) - 1, [0] * n, set(range(n)), 0
    turn = lambda x, r: (x << r | x >> (32 - r)) & mask
    while left:
        h = 42 ^ turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h = (turn(h, 13) * 5 + 0xE6546B64 & mask) ^ 4
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        h ^= h >> 16
        at = (h - (1 << 32) if h >> 31 else h) % n
        if at in left:
            left.remove(at)
            keys[at] = k
        k += 1
    return keys


def spread(df: DataFrame) -> DataFrame:
    """Messages by bucket, each bucket in a partition of its own (were bucket numbers hashed, some partitions would get several)."""
    keys = F.array(*map(F.lit, _keys(buckets(df.sparkSession))))
    return df.repartition(F.get(keys, F.col("bucket")))


def dealt(df: DataFrame) -> DataFrame:
    """Messages of a bucket together, lower kinds first."""
    return spread(df).sortWithinPartitions("bucket", "kind")
