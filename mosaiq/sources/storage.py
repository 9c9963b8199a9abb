"""Tables, shared scratch folders and materialised steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Where it is unset a local folder serves a local master; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mosaiq-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialised(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: later readers share it, and lost executors do not matter."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None, order: list[str] | None = None, max_rows: int | None = None) -> None:
    """Parquet with zstd; ``by`` makes partition folders, ``order`` sorts inside files, ``max_rows`` bounds a file. Existing output is an error unless asked otherwise."""
    if order:
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode(mode).option("compression", "zstd")
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    (writer.partitionBy(*by) if by else writer).parquet(path)
