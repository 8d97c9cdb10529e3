"""Deterministic priorities and digests: no result depends on partitioning, row order or a random generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def priority(stream: str, *keys: Column, seed: int = SEED) -> Column:
    """A uniform 60-bit integer for a key: the first 15 hex digits of md5('seed:stream:key')."""
    whole = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def prefix_key(text: Column, length: int) -> Column:
    return F.sha1(F.substring(text, 1, length))


def name_hash(name: Column, digits: int = 8) -> Column:
    """A number of so many digits from sha256 of a name."""
    return F.pmod(F.conv(F.substring(F.sha2(name, 256), 1, 15), 16, 10).cast("long"), F.lit(10**digits))
