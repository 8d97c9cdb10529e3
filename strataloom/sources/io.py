"""Sources and sinks: documents, token files, manifests, ordered exports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import priority
from ..session import materialised, shared_folder
from ..operators.prefix import numbered, running_sum

DOCUMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata", T.StringType())])


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str], glob: str | None = None) -> DataFrame:
    """A pruned scan; glob names the tables in a folder, each a file or a folder of files."""
    return spark.read.parquet(f"{path}/{glob}" if glob else path).select(*columns)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT, glob: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(path)


def jsonl_roundtrip(df: DataFrame) -> DataFrame:
    """df as read back from JSONL, which is written to a new folder beside the checkpoints (session.shared_folder)."""
    path = f"{shared_folder(df.sparkSession)}/jsonl-{uuid.uuid4()}"
    df.write.json(path)
    return read_jsonl(df.sparkSession, path, df.schema)


def read_results(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A tree of results.json files as a long table (path, setting, seed, epoch, step, task, metric, value). Files of another schema
    tag are skipped; `matches_path` tells whether a file says what its path does, `complete` what it says of itself."""
    metrics = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    cell = T.StructType([T.StructField("setting", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("seed", "epoch", "step"))])
    schema = T.StructType([T.StructField("schema", T.StringType()), T.StructField("cell", cell), T.StructField("complete", T.BooleanType()), T.StructField("missing_tasks", T.ArrayType(T.StringType())), T.StructField("tasks", metrics)])
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("path", F.col("_metadata.file_path")).where(F.col("schema") == tag)
    said = F.concat_ws("/", "cell.setting", F.concat(F.lit("seed"), F.col("cell.seed")), F.concat(F.lit("epoch"), F.col("cell.epoch")))
    rows = rows.withColumn("matches_path", F.contains("path", said))
    tasks = rows.select("path", "matches_path", "complete", "cell.*", F.explode("tasks").alias("task", "values"))
    return tasks.select("*", F.explode("values").alias("metric", "value")).drop("values")


def results_problems(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(setting, seed, epoch, problem): cells missing, incomplete, misplaced or repeated."""
    keys = ["setting", "seed", "epoch"]
    cells = results.groupBy(*keys).agg(F.countDistinct("path").alias("files"), F.bool_and("complete").alias("complete"), F.bool_and("matches_path").alias("placed"))
    both = expected.select(*keys).join(cells, keys, "full")
    known = expected.select(*keys, F.lit(True).alias("__known"))
    problem = F.when(F.col("files").isNull(), "missing").when(F.col("files") > 1, "repeated").when(~F.col("complete"), "incomplete").when(~F.col("placed"), "misplaced").when(F.col("__known").isNull(), "unexpected")
    return both.join(known, keys, "left").select(*keys, problem.alias("problem")).where("problem is not null")


def mix(sources: dict[str, tuple[DataFrame, float]], key: str, seed: int = 42) -> DataFrame:
    """The head fraction of each source, in the order of its key, put together in a seeded order (column pos)."""
    parts = None
    for name, (df, fraction) in sources.items():
        if fraction < 0:
            raise ValueError(f"negative fraction for {name}")
        most = F.floor(F.lit(fraction) * df.agg(F.count("*")).scalar())
        ranked = numbered(df.withColumn("dataset", F.lit(name)), key, "__n").where(F.col("__n") < most).drop("__n")
        parts = ranked if parts is None else parts.unionByName(ranked)
    return numbered(parts.withColumn("__tie", priority("mix", F.col("dataset"), F.col(key), seed=seed)), "__tie", "pos").drop("__tie")


def seeded_order(df: DataFrame, key: str, stream: str = "shuffle", seed: int = 42) -> DataFrame:
    """Add pos: each row's place in a seeded shuffle, the same however the data are partitioned."""
    return numbered(df.withColumn("__tie", priority(stream, F.col(key), seed=seed)), ["__tie", key], "pos").drop("__tie")


def file_plan(ordered: DataFrame, position: str, files: int) -> DataFrame:
    """Add file_no: contiguous runs of ceil(n / files) rows along the position."""
    rows = ordered.agg(F.count("*")).scalar()
    return ordered.withColumn("file_no", F.floor(F.col(position) / F.greatest(F.ceil(rows / files), F.lit(1))))


def export_ordered(ordered: DataFrame, position: str, path: str, files: int = 16) -> None:
    """Write contiguous files in order: one range of positions a file."""
    planned = file_plan(ordered, position, files)
    planned.repartitionByRange(files, "file_no").sortWithinPartitions(position).write.mode("overwrite").partitionBy("file_no").parquet(path)


def write_checked(df: DataFrame, path: str) -> DataFrame:
    """Write, reread, and raise unless row count and the digest of all columns are the same. A complete earlier output of the same rows
    is kept. df is computed once, for a table beside the checkpoints that the digest and the write read."""
    digest = lambda salt, d: F.sum(F.xxhash64(F.lit(salt), *sorted(d.columns)).cast("decimal(38,0)"))
    mark = lambda d: tuple(d.agg(F.count("*"), digest(0, d), digest(1, d)).first())
    spark, df = df.sparkSession, materialised(df)
    want = mark(df)
    try:
        if sorted((earlier := spark.read.parquet(path)).columns) == sorted(df.columns) and mark(earlier) == want:
            return earlier
    except Exception as e:  # no output yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    if mark(back) != want:
        raise OSError(f"{path} does not hold what was written")
    return back


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """One JSON object, through Spark's commit protocol."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def rewrite_metadata(df: DataFrame, line: str, tokenizer: str) -> DataFrame:
    """Replace the part of a metadata line before its last bar, keep the token size after it."""
    return df.withColumn(line, F.concat(F.lit(f"{tokenizer}|"), F.substring_index(F.col(line), "|", -1)))


# --- Token files: little-endian ids, cumulative document ends, two lines of metadata ---------------------------------------------
def token_bytes(docs: DataFrame, ids: str, size: int = 2, out: str = "data") -> DataFrame:
    """Add the bytes of an array of ids, `size` bytes each."""
    kind = {2: "<u2", 4: "<u4"}[size]
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for one in batches:
            data = [np.array(x or [], kind).tobytes() for x in one.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array(data, pa.binary())], [*one.schema.names, out])

    return docs.mapInArrow(pack, schema)


def write_token_files(docs: DataFrame, key: str, ids: str, path: str, tokenizer: str, size: int = 2, max_tokens: int = 10**9) -> None:
    """Write a table (file_no, key, start, len, data) by file, and metadata. A file closes at the document with which it reaches
    max_tokens; documents keep the order of the key."""
    from ..operators.tokens import offsets

    placed = offsets(docs, key, F.size(ids)).withColumn("file_no", F.floor(F.col("start") / max_tokens))
    placed = token_bytes(placed.select("file_no", key, "start", "len", ids), ids, size).drop(ids)
    placed.repartition("file_no").sortWithinPartitions("file_no", key).write.mode("overwrite").partitionBy("file_no").parquet(f"{path}/tokens")
    totals = placed.groupBy("file_no").agg(F.sum("len").alias("tokens"), F.count("*").alias("documents"))
    totals.withColumn("line", F.lit(f"{tokenizer}|{size}")).write.mode("overwrite").parquet(f"{path}/metadata")


def read_token_files(spark: SparkSession, path: str, out: str = "ids") -> DataFrame:
    """(file_no, key, start, len, ids) of a folder that write_token_files() made."""
    size = int(spark.read.parquet(f"{path}/metadata").select(F.substring_index("line", "|", -1)).first()[0])
    df = spark.read.parquet(f"{path}/tokens")
    schema = T.StructType([f for f in df.schema.fields if f.name != "data"] + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def unpack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = {2: "<u2", 4: "<u4"}[size]
        for one in batches:
            data = [np.frombuffer(x, kind).astype(np.int32).tolist() for x in one.column("data").to_pylist()]
            kept = [c for n, c in zip(one.schema.names, one.columns, strict=True) if n != "data"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(data, pa.list_(pa.int32()))], schema.names)

    return df.mapInArrow(unpack, schema)


def merge_indexed(parts: Sequence[DataFrame], key: str, size: str) -> DataFrame:
    """Append indexed datasets: (part, key, size, pointer), with pointers run on over the whole."""
    whole = reduce(DataFrame.unionByName, (p.select(F.lit(i).alias("part"), key, size) for i, p in enumerate(parts)))
    summed = running_sum(whole, None, ["part", key], size, "__end")
    return summed.select("part", key, size, (F.col("__end") - F.col(size)).alias("pointer"))


def get_slice(indexed: DataFrame, ids: str, offset: int, length: int | None = None) -> DataFrame:
    """Part of each document's ids."""
    taken = F.lit(length) if length is not None else F.greatest(F.size(ids) - offset, F.lit(0))
    return indexed.withColumn(ids, F.slice(F.col(ids), offset + 1, taken))


def synthetic(spark: SparkSession, rows: int, seq_len: int, vocabulary: int, seed: int = 42) -> DataFrame:
    """Seeded random token windows."""
    at = F.sequence(F.lit(0), F.lit(seq_len))
    token = lambda i: F.pmod(priority("token", F.col("id"), i, seed=seed), F.lit(vocabulary)).cast("int")
    return spark.range(rows).select(F.col("id").alias("sample"), F.transform(at, token).alias("input_ids"))


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, bytes) of files whose name matches a regular expression, at any depth, by Spark's own file listing."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    return rows.where(F.element_at(F.split("path", "/"), -1).rlike(pattern))


# --- Token folders ---------------------------------------------------------------------------------------------------------------
def folder_files(files: DataFrame, name: str, tokens: str, seq_len: int, skip_tokens: int = 0, max_tokens: int | None = None) -> DataFrame:
    """(name, tokens, skipped, windows) of the files of a folder that are read, in the order of their names: windows of seq_len + 1 tokens
    of a file after what is left of skip_tokens, until max_tokens are reached. A file that is skipped whole, or lies past the limit, goes."""
    size = seq_len + 1
    rows = running_sum(files.withColumn("__windows", F.floor(F.col(tokens) / size)), None, name, "__windows", "__upto")
    rows = rows.withColumn("__before", F.col("__upto") - F.col("__windows"))
    # a file gives up windows to the skip until as many tokens as asked for are gone
    skip = -(-skip_tokens // size)
    rows = rows.withColumn("skipped", F.least(F.greatest(F.lit(skip) - F.col("__before"), F.lit(0)), F.col("__windows")))
    rows = rows.withColumn("windows", F.col("__windows") - F.col("skipped"))
    if max_tokens is not None:
        room = F.lit(max_tokens // size) - F.greatest(F.col("__before") - skip, F.lit(0))
        rows = rows.withColumn("windows", F.greatest(F.least(F.col("windows"), room), F.lit(0)))
    return rows.where("windows > 0").select(name, tokens, "skipped", "windows")


def folder_items(items: DataFrame, item: str, files: DataFrame, name: str, shuffle: str | None = None, seed: int = 42) -> DataFrame:
    """(item, epoch, name, window): which window of which file each item of an endless folder is; items past its end start it over. Files
    stand in the order of their names, or in a seeded one if shuffle names a stream. The file is found by an equi-join on blocks of the
    axis of windows."""
    from ..operators.match import locate

    keyed = files.withColumn("__order", priority(shuffle, F.col(name), seed=seed) if shuffle else F.lit(0))
    spans = running_sum(keyed, None, ["__order", name], "windows", "__end").withColumn("__start", F.col("__end") - F.col("windows"))
    n = files.agg(F.coalesce(F.sum("windows"), F.lit(0))).scalar()
    points = items.withColumns({"epoch": F.floor(F.col(item) / n), "__at": F.col(item) % n})
    found = locate(points, "__at", spans, "__start", "windows")
    return found.select(item, "epoch", name, (F.col("__at") - F.col("__start") + F.col("skipped")).alias("window"))


def parallel_index(samples: DataFrame, dataset: str, sample: str, wanted: int, seed: int = 42) -> DataFrame:
    """(pos, dataset, sample): one epoch's rows in one seeded order, for both columns alike, tiled until there are `wanted`."""
    placed = numbered(samples.withColumn("__tie", priority("index", F.col(dataset), F.col(sample), seed=seed)), ["__tie", dataset, sample], "__at").drop("__tie")
    n = samples.agg(F.count("*")).scalar()
    turns = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.lit(wanted - 1) / n)))
    return placed.withColumn("__turn", turns).select((F.col("__turn") * n + F.col("__at")).alias("pos"), dataset, sample).where(F.col("pos") < wanted)


def choose_buckets(size: Column, memory: Column, inflate: float = 4.0, share: float = 0.55, least: int = 16) -> Column:
    """Buckets of a two-pass shuffle: twice the text in memory over a share of it. Spark's own shuffle needs none; kept to size exports."""
    return F.greatest(F.lit(least), F.ceil(2.0 * size * inflate / (share * memory))).cast("long")


def bucketed_order(key: Column, buckets: int, seed: int = 42) -> list[Column]:
    """Sort keys of a bucketed shuffle: the bucket of a row, and its place in it."""
    return [F.pmod(priority("bucket", key, seed=seed), F.lit(buckets)), priority("inside", key, seed=seed)]


def worker_shards(shards: DataFrame, shard: str, workers: int, finished: DataFrame) -> DataFrame:
    """shards still to do, with the worker of each."""
    return shards.join(finished.select(shard), shard, "left_anti").withColumn("worker", F.col(shard) % workers)


# --- Small sources and sinks -----------------------------------------------------------------------------------------------------
def read_split(spark: SparkSession, path: str, split: str, config: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One split of a dataset kept as path/[config/]split*.parquet or split*.jsonl, on any file system."""
    folder = f"{path}/{config}" if config else path
    for pattern, reader in ((f"{split}*.parquet", spark.read.parquet), (f"{split}*.jsonl", spark.read.json)):
        try:
            df = reader(f"{folder}/{pattern}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            return df.select(*columns) if columns else df
    raise FileNotFoundError(f"{folder} has no split {split}")


def placeholder(spark: SparkSession, rows: int) -> DataFrame:
    """A table without columns that has a length."""
    return spark.range(rows).select()


def cached(spark: SparkSession, folder: str, params: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s table, kept in folder under the md5 of its parameters as JSON: made once, read afterwards. A table without its success mark,
    as a broken run leaves it, is made again."""
    path = f"{folder}/{hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()}"
    fs, done = _file(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def list_cached(spark: SparkSession, folder: str, path: str, pattern: str) -> DataFrame:
    """list_files(), kept by path and pattern."""
    return cached(spark, folder, {"path": path, "pattern": pattern}, lambda: list_files(spark, path, pattern))


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def copy_bytes(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file under a temporary name, then rename it: a reader sees all of it or nothing."""
    (fs, a), (to, b), (_, part) = _file(spark, source), _file(spark, target), _file(spark, f"{target}.tmp-{uuid.uuid4()}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, part, False, conf):
        raise OSError(f"can't copy {source}")
    if to.exists(b):
        to.delete(b, False)
    if not to.rename(part, b):
        raise OSError(f"can't rename to {target}")


def update_manifest(spark: SparkSession, path: str, change: Callable[[dict], dict]) -> dict:
    """Read, change and rewrite a manifest; one writer at a time, which a lock file beside it sees to."""
    fs, lock = _file(spark, f"{path}.lock")
    if not fs.createNewFile(lock):
        raise RuntimeError(f"{path} is being written")
    try:
        there, at = _file(spark, path)
        new = change(read_manifest(spark, path) if there.exists(at) else {})
        write_manifest(spark, new, path)
        return new
    finally:
        fs.delete(lock, False)
