"""Logical tables that the registered queries run over, and the same in SQL.

Tables are derived from the physical ones as a corpus job would see them: a scored pool, a holdout, a removal list, two passes over
the same documents, token streams, and a table of results by setting, seed and epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import priority
from ..functions.scores import consensus, disagreement
from ..functions.text import WEB_WORDS, word_count
from ..operators.prefix import running_sum, total
from ..operators.rank import average_rank_pcts
from ..session import materialised

HOLDOUT = 60
SHARD_ROWS = 100


def h(stream: str, *keys: Column) -> Column:
    return priority(stream, *keys)


def sql_h(stream: str, key: str = "doc_id") -> str:
    return f"('0x' || substr(md5('42:{stream}:' || {key}), 1, 15))::BIGINT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """doc_id, orig_doc_id, topic, source, n_chars, tok, s1, s2, s3, tie [, text]"""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    return docs.select(
        "doc_id", (key + F.floor(key / 7)).alias("orig_doc_id"), F.col("lang").alias("topic"), "source", "n_chars", word_count(F.col("text")).alias("tok"),
        ((h("s1", key) % 1000) / 1000.0).cast("float").alias("s1"), ((h("s2", key) % 997) / 997.0).cast("float").alias("s2"), (F.col("n_chars") % 17).cast("float").alias("s3"),
        h("tie", key).alias("tie"), *(["text"] if text else []),
    )


POOL = rf"""pool AS (SELECT doc_id, doc_id + doc_id // 7 AS orig_doc_id, lang AS topic, source, n_chars, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS tok,
    (({sql_h("s1")} % 1000) / 1000.0)::FLOAT AS s1, (({sql_h("s2")} % 997) / 997.0)::FLOAT AS s2, (n_chars % 17)::FLOAT AS s3, {sql_h("tie")} AS tie, text FROM documents)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool with percentile ranks r1, r2, r3 and float32 q and v."""
    df = average_rank_pcts(pool(spark, sf_dir), {f"s{i}": f"r{i}" for i in (1, 2, 3)})
    a, b, c = F.col("r1"), F.col("r2"), F.col("r3")
    return df.withColumn("q", consensus(a, b, c)).withColumn("v", disagreement(a, b, c, F.col("q")))


_RANK = "((rank() OVER (ORDER BY s{i}) + (count(*) OVER (PARTITION BY s{i}) - 1) / 2.0)::DOUBLE / count(*) OVER ())::FLOAT AS r{i}"
RANKED = f"""{POOL}, r AS (SELECT *, {", ".join(_RANK.format(i=i) for i in (1, 2, 3))} FROM pool),
    rq AS (SELECT *, ((r1 + r2 + r3)::DOUBLE / 3.0)::FLOAT AS q FROM r),
    ranked AS (SELECT *, (((r1 - q) * (r1 - q) + (r2 - q) * (r2 - q) + (r3 - q) * (r3 - q))::DOUBLE / 3.0)::FLOAT AS v FROM rq)"""


def holdout(df: DataFrame, k: int = HOLDOUT) -> DataFrame:
    """A seeded sample of k ids."""
    return df.select("doc_id", h("val", F.col("doc_id")).alias("__h")).orderBy("__h").limit(k).select("doc_id")


HELD = f"held AS (SELECT doc_id FROM documents ORDER BY {sql_h('val')} LIMIT {HOLDOUT})"


def alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked rows without the holdout, with training length `len`: a narrow table written once, as each query goes over it several times."""
    df = ranked(spark, sf_dir)
    return materialised(df.join(holdout(table(spark, sf_dir, "documents")), "doc_id", "left_anti").withColumn("len", F.col("tok") + 1))


ALIVE = f"{RANKED}, {HELD}, alive AS (SELECT *, tok + 1 AS len FROM ranked WHERE doc_id NOT IN (SELECT doc_id FROM held))"
ORDER = "q::DOUBLE DESC, tie"
SUM = "(sum(len) OVER (ORDER BY q::DOUBLE DESC, tie ROWS UNBOUNDED PRECEDING))::BIGINT"


def passes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A rewriting pass: doc_id, topic, status (0 skipped, 1 cut, 2 done), rewritten_tokens, rewritten."""
    docs = table(spark, sf_dir, "documents")
    status = (h(f"status_{name}", F.col("doc_id")) % 3).cast("int")
    rewritten = F.concat(F.when(h(f"pre_{name}", F.col("doc_id")) % 3 == 0, F.lit("Here is a condensed version:\n\n")).otherwise(""), F.regexp_replace("text", r"[ ]+", " "))
    keep = docs.where(h(f"in_{name}", F.col("doc_id")) % 10 != 0)
    return keep.select("doc_id", F.col("lang").alias("topic"), status.alias("status"), rewritten.alias("rewritten"), word_count(rewritten).alias("rewritten_tokens"))


def sql_passes(name: str) -> str:
    pre = f"CASE WHEN {sql_h(f'pre_{name}')} % 3 = 0 THEN 'Here is a condensed version:' || chr(10) || chr(10) ELSE '' END"
    return rf"""pass_{name} AS (SELECT doc_id, lang AS topic, ({sql_h(f"status_{name}")} % 3)::INTEGER AS status, {pre} || regexp_replace(text, '[ ]+', ' ', 'g') AS rewritten,
        len(regexp_extract_all({pre} || text, '\S+')) AS rewritten_tokens FROM documents WHERE {sql_h(f"in_{name}")} % 10 <> 0)"""


DECORATIONS = [
    "", "# Title\n", "  ## Part\n", "1. first\n2) second\n", "- item one\n", "See https://x.org and Click Here to Sign up\n", "Here is a condensed version:\n\n",
    "Important: Do not add any information, claims, or details that are not in it.\n\nBody ", "**Summary**: rewritten\n\n", "Sure, a paraphrase:\nrest ", "a - b\n", "x y\tz \n",
]


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, text with one of the decorations before it."""
    docs = table(spark, sf_dir, "documents")
    pick = F.element_at(F.array(*map(F.lit, DECORATIONS)), (h("style", F.col("doc_id")) % len(DECORATIONS) + 1).cast("int"))
    return docs.select("doc_id", "source", F.concat(pick, F.col("text")).alias("text"))


def _literal(text: str) -> str:
    for c in "\n\t  ":
        text = text.replace(c, f"' || chr({ord(c)}) || '")
    return f"('{text}')"


STYLED = f"styled AS (SELECT doc_id, source, [{', '.join(map(_literal, DECORATIONS))}][({sql_h('style')} % {len(DECORATIONS)} + 1)::INTEGER] || text AS text FROM documents)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long results: setting, seed, epoch, metric, value, from events; values are whole hundredths, the same in any order of summing."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("setting"), (F.col("event_id") % 3).alias("seed"), (F.floor(F.col("event_id") / 3) % 2).alias("epoch"),
        F.concat(F.lit("m"), (F.floor(F.col("event_id") / 6) % 6).cast("string")).alias("metric"), "value",
    )
    return rows.groupBy("setting", "seed", "epoch", "metric").agg((F.floor(F.sum(F.floor(F.col("value") * 100)) / F.count("*")) / 100.0).alias("value"))


SCORES = """scores AS (SELECT 's' || (user_id % 4) AS setting, event_id % 3 AS seed, event_id // 3 % 2 AS epoch, 'm' || (event_id // 6 % 6) AS metric, floor(sum(floor(value * 100)::BIGINT)::DOUBLE / count(*)) / 100.0::DOUBLE AS value
    FROM events GROUP BY ALL)"""


def sets(df: DataFrame) -> dict[str, DataFrame]:
    """Four selections of alive(): the first rows by each score, up to a tenth of the pool's tokens, and by consensus up to a fifth. One
    running sum over (set, score) makes all; the ids are written once, as a selection is kept."""
    grid = [F.struct(F.lit(n).alias("set"), F.col(c).alias("score"), F.lit(share).alias("share")) for n, c, share in (("top1", "s1", 0.1), ("top2", "s2", 0.1), ("top3", "s3", 0.1), ("consensus", "q", 0.2))]
    rows = df.select("doc_id", "tie", "len", F.explode(F.array(*grid)).alias("x")).select("doc_id", "tie", "len", "x.*")
    filled = running_sum(rows, "score", "tie", "len", "cum", ["set"]).where(F.col("cum") - F.col("len") < F.col("share") * total(df, "len"))
    chosen = materialised(filled.select("set", "doc_id"))
    return {n: chosen.where(F.col("set") == n).select("doc_id") for n in SET_NAMES}


def _set_sql(name: str, score: str, share: float) -> str:
    return f"""{name} AS (SELECT doc_id FROM (SELECT doc_id, len, sum(len) OVER (ORDER BY {score}::DOUBLE DESC, tie ROWS UNBOUNDED PRECEDING) AS c, sum(len) OVER () AS t FROM alive)
        WHERE c - len < {share}::DOUBLE * t)"""


SETS = f"{ALIVE}, " + ", ".join([*(_set_sql(f"top{i}", f"s{i}", 0.1) for i in (1, 2, 3)), _set_sql("consensus", "q", 0.2)])
SET_NAMES = ["top1", "top2", "top3", "consensus"]
TAGGED = "tagged AS (" + " UNION ALL ".join(f"SELECT '{n}' AS set, {1 << i} AS bit, doc_id FROM {n}" for i, n in enumerate(SET_NAMES)) + ")"
