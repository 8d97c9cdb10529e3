"""Exact dedup by progressive refinement, in DataFrame functions only.

Texts are equal when identical after every run of white space `[\\x20\\x09-\\x0D]` becomes one space. Rows are refined in three
steps, each of which works only on what the one before could not tell apart:

1. group by length of the normalised text: a length that occurs once has no copies;
2. of rows whose length recurs, group by length and hash of a prefix;
3. of rows whose length and prefix recur, hash the full text and group by that.

Texts are read twice: for lengths and prefixes, a narrow table of a few bytes a row, and for the full hashes of what survives it, another
one. The surviving groups travel as a key filter whose size follows their number within a bound (see common.key_filter), so no step
shuffles a text or joins on a hot group: a group of copies is counted by partial aggregation, and a false positive of the filter only
means one more hash.

Defined results: null text counts as empty; a very long text is hashed whole, in its own row. Null ids sort last: a group whose ids are all null has a null keep_id. Repeated rows
(same id, same text) count one by one in group_size, and exactly one row of each group is kept. Extra columns don't matter, whatever
their names: only key and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .common import filter_bits, keep_decided, key_filter, maybe_in

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text", every_digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. The digest is null for rows that refinement
    settled without reading their full text, unless every_digest asks for it as part of the result."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("__text"))
    rows = rows.withColumn("__length", F.length("__text")).withColumn("__prefix", F.xxhash64("__length", F.substring("__text", 1, PREFIX_CHARS)))
    groups = rows.groupBy("__length", "__prefix").agg(F.count(F.lit(1)).alias("n"))
    groups = materialised(groups)
    lengths = groups.groupBy("__length").agg(F.sum("n").alias("n")).where("n > 1").select("__length")
    prefixes = groups.join(lengths, "__length", "left_semi").where("n > 1").select("__prefix")
    rows = maybe_in(rows, F.col("__prefix"), key_filter(prefixes, "__prefix", bits := filter_bits(prefixes)), "__refine", bits)
    digest = F.sha2("__text", 256)
    rows = materialised(rows.select("doc_id", "__refine", (digest if every_digest else F.when(F.col("__refine"), digest)).alias("text_sha256")))

    same = rows.where("__refine").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The key of the groups is an expression too, so that both sides are shuffled for the join itself: then Spark can split the
    # partition of a group that holds many copies. It can't be null, or Spark would hash every text to filter nulls before the scan.
    same = same.where("group_size > 1").select(F.coalesce(F.concat(F.lit("="), "text_sha256"), F.lit("")).alias("__digest"), "keep_id", "group_size")
    # Rows without a digest get a key of their own, which no group has, so that they don't meet in one partition.
    joined = F.coalesce(F.concat(F.lit("="), "text_sha256"), F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.join(same, joined == F.col("__digest"), "left")
    out = rows.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
    )
    return _one_kept(out)


def _one_kept(rows: DataFrame) -> DataFrame:
    """kept for the row with the smallest id. Where the id itself repeats in a group, for one of its rows: such rows are counted
    by key (a partial aggregation) and dealt out again, which needs no window over a group."""
    candidate = (F.col("group_size") == 1) | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    settled = rows.where(~candidate).withColumn("kept", F.lit(False))
    first = rows.where(candidate).groupBy("doc_id", "keep_id", "group_size", "text_sha256").count()
    # group_size 1 without a digest may hold several rows only where ids are null or repeat across different texts: all stay
    nth = first.select("*", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("__nth")).drop("count")
    kept = nth.withColumn("kept", (F.col("group_size") == 1) | (F.col("__nth") == 1)).drop("__nth")
    return settled.unionByName(kept).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that decisions() does not keep: one row of each group of equal texts stays. Rows are told by id and
    digest, so that a row stays whose id occurs on a dropped copy too. Texts of rows that stay are not shuffled, but for the few that
    the key filter takes for dropped ones."""
    once = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("once")
    marks = decisions(docs, key, text).where("not kept").select("doc_id", F.col("text_sha256").alias("digest"), once)
    return keep_decided(docs, key, F.sha2(normalised(F.col(f"`{text}`")), 256), marks)
