"""Running counts over a folder that grows, and restartable reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import word_count


def consumption_stream(spark: SparkSession, path: str, schema: StructType, source: str = "source", text: str = "text", glob: str = "*.parquet") -> DataFrame:
    """Documents and tokens by source so far, over a stream of Parquet files. State is one row a source."""
    docs = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    return docs.select(source, word_count(F.col(text)).alias("tok")).groupBy(source).agg(F.count("*").alias("docs"), F.sum("tok").alias("tokens"))


def start_counter(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Write running totals to a memory table; offsets in the checkpoint folder make it go on where it stopped."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_available(spark: SparkSession, path: str, schema: StructType, out: str, checkpoint: str) -> StreamingQuery:
    """Copy files that are new since the last call: the idempotent restart of a sharded job."""
    return spark.readStream.schema(schema).parquet(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
