"""Token ids in ORC: integer run-length coding, row indexes and Bloom filters on the document id.

``write_tokens`` range-partitions documents by id, encodes each partition's whole texts and writes one ORC
file for each; ``read_tokens`` reads the stripes back in parallel and ``lookup`` lets ORC skip files, stripes
and row groups by their statistics and Bloom filters. ``token_positions`` gives each document's place in the
stream of all ids in ascending id order; only one row for each written file meets in one task.

Null ids sort first. Null or empty texts hold the end id alone. Equal ids are ordered by text, and repeated
rows stay repeated. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.textutil import byte_bpe, default_vocabulary, documents, map_batches, shared_path, small_batches, texts

STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 2000
BLOOM_FPP = 0.01


def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``part, id, n_tokens, ids`` in ascending id order: the files in order, and the rows of each."""
    small_batches(df.sparkSession)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    ordered = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    id_type = ordered.schema["id"].dataType.simpleString()

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = byte_bpe(vocabulary)
        coded = [bpe.ids(x) + end for x in texts(batch.column(1))]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
        part = pa.array(np.full(len(coded), TaskContext.get().partitionId(), np.int32))
        return pa.RecordBatch.from_arrays([part, batch.column(0), pa.array(sizes), ids], ["part", "id", "n_tokens", "ids"])

    (
        map_batches(ordered, encode, f"part int, id {id_type}, n_tokens bigint, ids array<int>")
        .write.option("orc.bloom.filter.columns", "id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.write.format", "0.12")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``part, id, n_tokens, ids`` as stored; a file's stripes are dealt to several tasks."""
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The rows of the given ids: the predicate reaches ORC, whose statistics and Bloom filters prune stripes and row groups."""
    return read_tokens(spark, path).where(F.col("id").isin(list(ids)))


def stripe_table(spark: SparkSession, path: str) -> list[tuple[str, int, int, int]]:
    """(file, stripe, rows, bytes) from the files' footers, read on the driver: metadata of few bytes a stripe."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = []
    for status in root.getFileSystem(conf).listStatus(root):
        if status.getPath().getName().endswith(".orc"):
            reader = jvm.org.apache.orc.OrcFile.createReader(status.getPath(), jvm.org.apache.orc.OrcFile.readerOptions(conf))
            found += [(status.getPath().getName(), k, s.getNumberOfRows(), s.getLength()) for k, s in enumerate(reader.getStripes())]
            reader.close()
    return sorted(found)


def token_positions(stored: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` from the stored ids; start counts the ids of all rows before it."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, flat = batch.column(2), np.ascontiguousarray(batch.column(2).values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)
        at, buf = ids.offsets.to_numpy(), memoryview(flat).cast("B")
        n = np.diff(at).astype(np.int64)
        crc = np.fromiter((zlib.crc32(buf[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])), np.int64, len(n))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(crc)], ["part", "id", "n_tokens", "ids_crc32"])

    id_type = stored.schema["id"].dataType.simpleString()
    rows = map_batches(stored.select("part", "id", "ids"), digest, f"part int, id {id_type}, n_tokens bigint, ids_crc32 bigint")
    per_file = stored.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_file.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "part")
        .select("id", (F.col("base") + F.col("inside")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")
    )


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "op9")
    write_tokens(documents(spark, sf_dir), path, default_vocabulary("byte_bpe_50k.json"))
    return token_positions(read_tokens(spark, path)).withColumnRenamed("id", "doc_id")
