"""Length buckets, and shards of samples as tar files of arrays."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.ordering import hash_order
from mosaiq.operators.master import with_row_key


def total_length(groups: list[list[str]], present: list[str]) -> Column:
    """The sum over groups of the size of the group's first column that is there."""
    return sum((F.coalesce(*[F.size(c) for c in g if c in present]) for g in groups if any(c in present for c in g)), F.lit(0))


def bucket(length: Column, edges: list[int]) -> Column:
    """``(lo, hi]`` buckets from 0; the last has no upper end, and lengths up to the first edge have none (null)."""
    under = sum(((length > e).cast("int") for e in edges[:-1]), F.lit(0)) - 1
    return F.when(length > edges[0], F.least(under, F.lit(len(edges) - 2)))


def length_buckets(df: DataFrame, length: Column, edges: list[int], least_rows: int = 0, by: list[str] = ()) -> DataFrame:
    """``df`` with ``bucket``; rows without one go, and so do buckets with fewer rows than ``least_rows``."""
    rows = df.withColumn("bucket", bucket(length, edges)).where("bucket is not null")
    if not least_rows:
        return rows
    enough = rows.groupBy(*by, "bucket").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_rows).drop("_n")
    return rows.join(F.broadcast(enough), [*by, "bucket"], "left_semi")


def bucket_sample(df: DataFrame, by: list[str], k: int, id_col: str, seed: int = 0) -> DataFrame:
    """The first k rows of each bucket in hash order."""
    w = Window.partitionBy(*by).orderBy(hash_order(id_col, seed), F.col(id_col))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def tar_shards(df: DataFrame, order: list[str], columns: list[str], samples: int = 4096, key: str = "__key__") -> DataFrame:
    """``shard, content``: tar files of ``samples`` samples in order, a ``.npy`` member for each column of a sample.

    Samples are numbered past the ones before, then a shard is made where its rows meet; it holds ``samples`` rows at most.
    """
    numbered = with_row_key(df, order, key).withColumn("shard", F.floor(F.col(key) / samples))

    def make(t: pa.Table) -> pa.Table:
        rows, out = sorted(t.to_pylist(), key=lambda r: r[key]), io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for r in rows:
                for c in columns:
                    if r[c] is None:
                        continue
                    data = io.BytesIO()
                    np.save(data, np.asarray(r[c]))
                    info = tarfile.TarInfo(f"{r[key]:09d}.{c}.npy")
                    info.size = data.tell()
                    data.seek(0)
                    tar.addfile(info, data)
        return pa.table({"shard": pa.array([rows[0]["shard"]], pa.int64()), "content": pa.array([out.getvalue()], pa.binary())})

    return numbered.select("shard", key, *columns).groupBy("shard").applyInArrow(make, "shard bigint, content binary")


def read_tar(content: DataFrame, column: str = "content") -> DataFrame:
    """``key, column, values`` of the members of tar files; values as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, name, values = [], [], []
            for raw in batch.column(0).to_pylist():
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    for m in tar.getmembers():
                        k, c = m.name.removesuffix(".npy").split(".", 1)
                        key.append(int(k))
                        name.append(c)
                        values.append(np.atleast_1d(np.load(io.BytesIO(tar.extractfile(m).read()))).astype(np.float64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(name, pa.string()), pa.array(values, pa.list_(pa.float64()))], ["key", "column", "values"])

    return content.select(column).mapInArrow(run, "key bigint, column string, values array<double>")


def shard_stats(df: DataFrame, by: list[str], samples: int = 4096) -> DataFrame:
    """``rows, shards`` of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.ceil(F.count("*") / samples).cast("bigint").alias("shards"))
