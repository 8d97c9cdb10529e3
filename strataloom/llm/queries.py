"""The registered queries of the training-data operators: query name to function of (spark, sf_dir), and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, dedup, jaccard, langid, lm, pii, sharding, urls
from .common import documents


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> bytes:
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path(name))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.decisions(documents(spark, sf_dir), every_digest=True)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.run(documents(spark, sf_dir).select("doc_id", langid.held_out(parts=10, part=0).alias("held_out"), "text"))


#: Shards of the query: small enough that every table splits several times over.
SHARD_BYTES = 256 << 10


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), SHARD_BYTES)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir).select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long") for i, k in enumerate(pii.KINDS)}
    more = {"n_added": F.size("spans") - F.size("base"), "n_secret": F.size("secrets"), "n_found": F.size("spans") + F.size("secrets")}
    counts |= {n: c.cast("long") for n, c in more.items()}
    secrets = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", F.lit(pii.SECRET), s["start"], s["end"])), ",")
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"), secrets.alias("secrets"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


#: The conversation that op10 adds: control strings as plain content.
PLANTED = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], turns.schema)
    return chat.digests(turns.unionByName(planted), vocabulary())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def _glob(column: str, glob: str) -> str:
    return f"{column} LIKE '{glob.replace('_', '!_').replace('*', '%')}' ESCAPE '!'"


def oracle_sql() -> dict[str, str]:
    fits = "({path} AND (host = '{host}' OR host LIKE '%.{host}'))"
    rules = []
    for _, rule in sorted(urls.RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        rules.append(f"WHEN {fits.format(host=host, path=f"starts_with(path, '/{path}')")} THEN '{rule}'")
    verdicts = "".join(f" WHEN rule = '{rule}' THEN '{verdict}'" for verdict, rule in urls.RULES)
    verdicts += "".join(f" WHEN {_glob("'.' || host", h)} AND {_glob('path', p)} THEN '{v}'" for v, h, p in urls.GLOBS)
    tails = chat.TAILS.replace("'", "''")
    return {
        "op7_sharding": f"""
            WITH s AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes,
                              ('0x' || substr(md5(doc_id || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
            x AS (SELECT doc_id, bytes, h, d::INTEGER AS depth, sum(bytes) OVER (PARTITION BY d, h >> (60 - d::INTEGER))::BIGINT AS shard_bytes,
                         count(*) OVER (PARTITION BY d, h >> (60 - d::INTEGER)) AS shard_docs FROM s, range(0, 61) r(d)),
            y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) AS k FROM x WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1)
            SELECT doc_id, bytes, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard, depth, shard_bytes, shard_docs FROM y WHERE k = 1""",
        "op10_chat_format": rf"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PLANTED}'), (-1, 1, 'assistant', '{PLANTED}'))),
            e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)({tails})', '\1\\\2\3', 'g'))
                            + length(regexp_replace(role, '([<\[])(\\*)({tails})', '\1\\\2\3', 'g')) + {sum(map(len, chat.MARKS))} AS chars FROM c),
            g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
                         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum(chars)::BIGINT AS formatted_chars
                  FROM e GROUP BY conv_id)
            SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
        "op2_exact_dedup": r"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
            FROM n""",
        "op9_url_filters": rf"""
            WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
            c AS (SELECT page_id, host, path, CASE {" ".join(rules)} END AS rule FROM b)
            SELECT page_id, host, path, rule, CASE{verdicts} ELSE 'allow' END AS verdict FROM c""",
    }
