"""Incremental index scans: new shards are appended to the index by a stream whose checkpoint tells what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from mosaiq.sources.manifest import ID_COLUMNS


def shard_stream(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Id rows of the shards ``root/<subset>/<split>/<shard>.parquet`` as they arrive; only id columns are read."""
    data = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(root)
    path = F.split(F.col("_metadata.file_path"), "/")
    ids = [(F.col(c) if c in schema.names else F.lit(None)).cast("string").alias(c) for c in ID_COLUMNS]
    return data.select(F.element_at(path, -3).alias("subset"), F.element_at(path, -2).alias("split"), F.element_at(path, -1).alias("shard"), *ids)


def append_index(spark: SparkSession, root: str, schema: StructType, out: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of all shards not read before, then stop; running it again reads only newer shards."""
    return shard_stream(spark, root, schema).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Rows of event-time windows; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
