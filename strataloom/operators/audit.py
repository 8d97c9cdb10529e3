"""Checks of a corpus or an export against the selection that it is made of. Each gives a table of findings; gate() raises on one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import id_digest
from .rank import average_rank_pct, percentiles_by, rank_against
from .verify import CheckFailed, style_rates


def findings(parts: Mapping[str, Column], df: DataFrame) -> DataFrame:
    """(name, value) of one-row aggregates, as strings."""
    row = df.agg(*[c.cast("string").alias(n) for n, c in parts.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in parts])).alias("x")).select("x.*")


def compared(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, found, expected, ok) of two tables (name, value); a name that one side lacks is not ok."""
    both = found.select("name", F.col("value").alias("found")).join(expected.select("name", F.col("value").alias("expected")), "name", "full")
    return both.withColumn("ok", F.coalesce(F.col("found") == F.col("expected"), F.lit(False)))


def gate(checks: DataFrame) -> DataFrame:
    """checks as they are; raises, before anything is written, if one is not ok."""
    failed = checks.where(~F.col("ok")).limit(20).collect()
    if failed:
        raise CheckFailed(f"gate: {[r.asDict() for r in failed]}")
    return checks


def selection_facts(selected: DataFrame, key: str, length: str) -> DataFrame:
    """(name, value): documents, tokens and the byte-exact digest of the id set."""
    facts = findings({"docs": F.count("*"), "tokens": F.coalesce(F.sum(length), F.lit(0))}, selected)
    return facts.unionByName(id_digest(selected, key).select(F.lit("docset_sha256").alias("name"), F.col("digest").alias("value")))


def export_report(export: DataFrame, selected: DataFrame, pool: DataFrame, key: str, position: str, planned: str, length: str, text: str) -> DataFrame:
    """One row about an export (key, position, text) of a selection (key, planned position) from a pool (key, length, text): rows,
    repeated ids, ids missing or in excess, tokens, whether the order is the planned one and differs from the ids' own, and texts
    that aren't the pool's, byte for byte."""
    by = export.groupBy(key).agg(F.count("*").alias("n"), F.min(position).alias("at"), F.min(F.sha2(text, 256)).alias("h"), F.max(F.sha2(text, 256)).alias("h2"))
    both = by.join(selected.select(key, F.col(planned).alias("planned")), key, "full").join(pool.select(key, F.col(length).alias("len"), F.sha2(text, 256).alias("own")), key, "left")
    there = F.col("n").isNotNull()
    ordered = selected.select(key).agg(F.min(key)).scalar()
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(~there).alias("missing"), F.count_if(there & F.col("planned").isNull()).alias("excess"),
        F.coalesce(F.sum(F.col("n") * F.col("len")), F.lit(0)).alias("tokens"), F.coalesce(F.bool_and(F.when(there, F.col("at") == F.col("planned"))), F.lit(True)).alias("order_as_planned"),
        F.coalesce(F.min_by(key, "at") != ordered, F.lit(False)).alias("order_differs_from_ids"), F.count_if(there & ~((F.col("h") == F.col("own")) & (F.col("h2") == F.col("own")))).alias("wrong_texts"),
    )


def percentile_check(df: DataFrame, raw: str, recorded: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: recorded percentiles against two recomputations, one by ranks and one by counts below and at or below."""
    again = rank_against(average_rank_pct(df, raw, "__ranks"), raw, df, raw, "__counts")
    gap = lambda c: F.abs(F.col(recorded).cast("double") - F.col(c).cast("double"))
    return again.agg(F.count("*").alias("n_rows"), F.count_if(gap("__ranks") > tolerance).alias("off_by_ranks"), F.count_if(gap("__counts") > tolerance).alias("off_by_counts"), F.max(F.greatest(gap("__ranks"), gap("__counts"))).alias("worst"))


def leakage_checks(corpus: DataFrame, pool: DataFrame, rewrites: DataFrame, held: DataFrame, key: str, text: str, part: str, sample: Column, tokens: Column) -> DataFrame:
    """(check, errors, passed) of a corpus whose rows are anchors or strategy rows (part): provenance (strategy ids are in the pool, none
    is held out or an anchor), anchor (texts are the pool's, byte for byte), hashes (sampled strategy texts are the pool's, have a
    rewrite and equal none), style (strategy texts are nearer to anchors than rewrites are) and lengths (medians differ from rewrites')."""
    strategy, anchor = corpus.where(F.col(part) == "strategy"), corpus.where(F.col(part) == "anchor")
    keys = strategy.select(key)
    outside = keys.join(pool.select(key), key, "left_anti").unionByName(keys.join(held.select(key), key, "left_semi")).unionByName(keys.join(anchor.select(key), key, "left_semi"))
    own = pool.select(key, F.sha2(text, 256).alias("__own"))
    digested = lambda df: df.select(key, F.sha2(text, 256).alias("__h")).join(own, key, "left")
    differs = ~F.col("__h").eqNullSafe(F.col("__own"))
    others = rewrites.select(key, F.sha2(text, 256).alias("__rw")).groupBy(key).agg(F.collect_set("__rw").alias("__rws"))  # a few rewrites a document
    sampled = digested(strategy.where(sample)).join(others, key, "left")
    bad = differs | F.col("__rws").isNull() | F.array_contains("__rws", F.col("__h"))
    arms = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("arm"), F.col(text).alias("t"), tokens.alias("tok")) for n, df in (("strategy", strategy), ("anchor", anchor), ("rewritten", rewrites))))
    rates = style_rates(arms, "t", "arm").groupBy().pivot("arm", ["strategy", "anchor", "rewritten"]).agg(F.first(F.struct("heading", "list_item", "web")))
    gap = lambda a, b: sum((F.abs(F.col(a)[c] - F.col(b)[c]) for c in ("heading", "list_item", "web")), F.lit(0.0))
    style = rates.select(F.when(gap("strategy", "anchor") <= gap("rewritten", "anchor"), 0).otherwise(1).cast("long").alias("errors"))
    medians = percentiles_by(arms, "tok", [0.5], ["arm"]).groupBy().pivot("arm", ["strategy", "rewritten"]).agg(F.first(F.get("p", F.lit(0))))
    lengths = medians.select(F.when(F.col("strategy") != F.col("rewritten"), 0).otherwise(1).cast("long").alias("errors"))
    counted = {"provenance": outside.agg(F.count("*").alias("errors")), "anchor": digested(anchor).agg(F.count_if(differs).alias("errors")), "hashes": sampled.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("errors")), "style": style, "lengths": lengths}
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("check"), "errors") for n, df in counted.items()))
    return rows.withColumn("passed", F.col("errors") == 0)


def assembly_report(parts: Mapping[str, DataFrame], targets: Mapping[str, int], key: str, length: str) -> DataFrame:
    """(part, docs, tokens, target, reached, shared): each part's size against its budget, and its keys that another part has too."""
    whole = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("part"), key, F.col(length).alias("len")) for n, df in parts.items()))
    times = whole.groupBy(key).agg(F.countDistinct("part").alias("n")).where("n > 1").select(key, F.lit(1).alias("__shared"))
    goal = F.create_map(*[x for n, t in targets.items() for x in (F.lit(n), F.lit(t))])[F.col("part")]
    by = whole.join(times, key, "left").groupBy("part").agg(F.count("*").alias("docs"), F.sum("len").alias("tokens"), F.count("__shared").alias("shared"))
    return by.select("part", "docs", "tokens", goal.cast("long").alias("target"), (F.col("tokens") >= goal).alias("reached"), "shared")


def one_value(df: DataFrame, column: str, expected: str) -> DataFrame:
    """One row: distinct values, and whether there is one and it is the expected one."""
    return df.agg(F.countDistinct(column).alias("values"), F.coalesce(F.bool_and(F.col(column).eqNullSafe(F.lit(expected))), F.lit(False)).alias("as_expected"))


def file_totals(files: DataFrame, folder: str, size: str, said: str, bytes_a_token: int = 2) -> DataFrame:
    """(folder, shards, tokens by file size, tokens by metadata, same) by folder."""
    by = files.groupBy(folder).agg(F.count("*").alias("shards"), F.floor(F.sum(size) / bytes_a_token).alias("by_size"), F.sum(said).alias("by_metadata"))
    return by.withColumn("same", F.col("by_size") == F.col("by_metadata"))


def replayed(published: DataFrame, key: str, position: str, order: Mapping[int, Sequence[Column]]) -> DataFrame:
    """(buckets, misplaced): for each candidate bucket count, rows whose published position is not that of the recomputed order. Only ids
    are needed."""
    from .prefix import numbered

    parts = []
    for buckets, keys in order.items():
        names = [f"__o{i}" for i in range(len(keys))]
        again = numbered(published.select(key, position, *[c.alias(n) for c, n in zip(keys, names, strict=True)]), [*names, key], "__at")
        parts.append(again.agg(F.lit(buckets).alias("buckets"), F.count_if(F.col("__at") != F.col(position)).alias("misplaced")))
    return reduce(DataFrame.unionByName, parts)
