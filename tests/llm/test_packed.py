"""Packed shuffles: a partition a bucket, and nothing lost on the way."""

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import common, packed


def test_one_partition_a_bucket(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = packed.spread(spark.range(37).selectExpr("cast(id as int) as bucket")).select("bucket", F.spark_partition_id().alias("p")).collect()
        assert len(rows) == 37 and all(r.bucket == r.p for r in rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_by_bucket_keeps_all_rows():
    rows = np.zeros(1000, [("k", "<u8"), ("v", "<i8")])
    rows["k"], rows["v"] = np.random.default_rng(1).integers(0, 1 << 62, 1000), np.arange(1000)
    out = packed.Outbox(3, "k", 7, most=100)
    made = [b for part in np.split(rows, 9 and [100, 300, 301]) for b in out.put(part)] + list(out.rest())
    back = [(bucket, np.frombuffer(payload, rows.dtype)) for bucket, _, kind, payload in packed.messages(iter(made)) if kind == 3]
    assert sorted(np.concatenate([x["v"] for _, x in back]).tolist()) == list(range(1000))
    assert all((x["k"] % 7 == bucket).all() for bucket, x in back)


def test_key_filter_has_no_false_negative(spark):
    keys = spark.range(0, 4000, 3).select(F.col("id").alias("k"))
    flagged = common.maybe_in(spark.range(4000), F.col("id"), common.key_filter(keys, "k", 12), "hit", 12).collect()
    assert all(r.hit for r in flagged if r.id % 3 == 0) and sum(r.hit for r in flagged) < 4000
    kept = common.keep_rows(spark.range(4000).withColumn("k", F.col("id")), "k", keys, 12)
    assert sorted(r.id for r in kept.collect()) == [i for i in range(4000) if i % 3]


def test_words_are_bytes_between_white_space():
    texts = ["a b", "", " \tA  b\n", "é\x0bx", "a" * 3000, "b a"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    hashes, at = common.word_hashes(np.frombuffer(b"".join(data), np.uint8), offsets)
    rows = [hashes[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert rows[0] == rows[2] and rows[1] == [] and rows[5] == rows[0][::-1] and len(rows[3]) == 2 and len(rows[4]) == 1
    assert len({x for r in rows for x in r}) == 5
