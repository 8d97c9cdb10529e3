"""Helpers shared by the training-data operators: bounded Arrow batches, checkpoints, fixed-size key filters, word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows an Arrow batch may hold, and text bytes that a Python mapper works on at a time.
BATCH_ROWS = 512
CHUNK_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size of the session, so that a batch of long texts stays small. Never raises it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that the cluster names in spark.checkpoint.dir (session.shared_folder). The shuffle files behind it go as
    soon as it is written; else they would stay until the driver's garbage collector finds their plan dead."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shared_folder(spark)
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # holds for plans made from now on
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(key, before)


def discarded(*frames: DataFrame) -> None:
    """Delete what checkpointed() has written for frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def buckets(spark: SparkSession) -> int:
    """Logical buckets of a packed shuffle: one for each shuffle partition."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- Filters over keys, of bounded size ---------------------------------------------------------------------------------------
#: Least and most bits of a key filter, as powers of two; as 64-bit words it is a table of 2**17 to 2**21 rows (2 to 32 MB).
FILTER_BITS, MOST_BITS = 23, 27


def filter_bits(keys: DataFrame) -> int:
    """Bits for a filter of so many keys: eight a key, within the bounds. Past the upper one, a filter lets more rows through, which costs
    work but changes no result."""
    return min(MOST_BITS, max(FILTER_BITS, keys.count().bit_length() + 3))


def _position(key: Column, bits: int) -> Column:
    return F.xxhash64(key, F.lit(bits)).bitwiseAND(F.lit((1 << bits) - 1))


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The words of a one-hash Bloom filter over a key column: (word, mask), at most 2**(bits - 6) rows, so its size has a proven bound.
    Null keys count as a key."""
    at = keys.select(_position(F.col(key), bits).alias("at"))
    return at.groupBy(F.shiftright("at", 6).alias("filter_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("filter_mask")
    )


def maybe_in(df: DataFrame, key: Column, words: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """Add a boolean column that is true where key may be in the filter and false where it is surely not. The words table has a
    proven size bound (2 MB at the default, 32 MB at most), so it is broadcast."""
    at = _position(key, bits)
    own = words.select(F.col("filter_word").alias("__word"), F.col("filter_mask").alias("__mask"))
    out = df.withColumn("__at", at).join(F.broadcast(own), F.shiftright("__at", 6) == F.col("__word"), "left")
    bit = F.call_function("shiftright", F.coalesce("__mask", F.lit(0).cast("long")), F.col("__at").bitwiseAND(63).cast("int"))
    return out.withColumn(flag, bit.bitwiseAND(1) == 1).drop("__at", "__word", "__mask")


def keep_rows(df: DataFrame, key: str, drops: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Left anti join of df with drops on a key, which shuffles only those rows of df whose key may be among the drops. Rows
    whose key is null stay."""
    spark_columns = df.columns
    drops = drops.select(F.col(key).alias("__drop")).where(F.col("__drop").isNotNull())
    flagged = maybe_in(df, F.col(key), key_filter(drops, "__drop", bits), "__maybe", bits)
    sure = flagged.where(~F.col("__maybe")).select(*[F.col(f"`{c}`") for c in spark_columns])
    rest = flagged.where("__maybe").join(drops, F.col(f"`{key}`") == F.col("__drop"), "left_anti")
    return sure.unionByName(rest.select(*[F.col(f"`{c}`") for c in spark_columns]))


def keep_decided(df: DataFrame, key: str, digest: Column, marks: DataFrame) -> DataFrame:
    """df without the rows whose key and digest are among the marks (doc_id, digest, once); of those marked once, one row stays: the
    first by its JSON. Null keys are keys like others. Only rows whose key may be among the marks are digested and shuffled."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    marks = checkpointed(marks.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__mark"), "once").distinct())
    bits = filter_bits(marks)
    flagged = maybe_in(df, F.col(f"`{key}`"), key_filter(marks, "__id", bits), "__maybe", bits)
    sure = flagged.where(~F.col("__maybe")).select(*columns)
    rest = flagged.where("__maybe").withColumn("__digest", digest)
    same = F.col(f"`{key}`").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__mark"))
    stay = rest.join(marks, same, "left_anti").select(*columns)
    once = rest.join(marks.where("once"), same, "left_semi").groupBy(F.col(f"`{key}`").alias("__id"), "__digest")
    one = once.agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("__row")).select("__row.*")
    return sure.unionByName(stay).unionByName(one)


# --- Texts in numpy -----------------------------------------------------------------------------------------------------------
def chunks(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `most`; a larger row has a range of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the n + 1 offsets of its rows; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all rows, A-Z lower-cased, and the n + 1 offsets of each row's words.
    A hash depends on the word's bytes alone: it comes from prefix sums of a polynomial over the whole buffer."""
    return hashed_words(data, offsets)[:2]


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes() with each word's first byte and the byte past its last one."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    solid = ~_WHITE[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    starts[inner] = solid[inner]
    ends = np.empty(n, bool)
    ends[:-1] = solid[:-1] & (~solid[1:] | starts[1:])
    ends[-1] = solid[-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    values = (sums[last] - sums[first]) * inverse[first]
    return mix(values ^ ((last - first).astype(np.uint64) << np.uint64(56))), np.searchsorted(first, offsets), first, last
