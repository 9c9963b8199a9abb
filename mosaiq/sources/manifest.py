"""Subset folders, their manifest, and the index that is built from them.

Layout: ``root/<subset>/<split>/<shard>.parquet``. A subset is named by its modalities joined with ``+``; its
payload columns may carry the prefix ``tok_``, which the logical names drop.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID_COLUMNS = ("genome_feature_id", "uniprot_id")
#: The columns that an index carries from the master table.
LOOKUP_COLUMNS = ("root_id", "protein_cluster_30", "protein_cluster_70", "rna_cluster_30", "rna_cluster_70", "domain", "kingdom", "phylum", "class", "order", "family", "genus", "species", "is_coding", "feature_type", "aa_seq_length", "rna_seq_length")
SPLIT_ORDER = {"train": 0, "val": 1, "test": 2}
STAGES = ("raw", "interim", "processed")
FORMATS = ("parquet", "arrow", "csv", "json")


def _files(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)) if fs.exists(p) else []


def dataset_path(root: str | None, data_type: str, stage: str, name: str, version: str, fmt: str) -> str:
    """``root/data_type/stage/name/version/fmt`` with checked parts; there is no default root."""
    if not root:
        raise ValueError("no root is set")
    if stage not in STAGES:
        raise ValueError(f"stage {stage!r} is not one of {STAGES}")
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {FORMATS}")
    return "/".join((root.rstrip("/"), data_type, stage, name, version, fmt))


def logical_name(column: str) -> str:
    return re.sub("^tok_", "", column)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def describe_subsets(spark: SparkSession, root: str) -> dict:
    """The manifest of a root: modalities, stored columns, key, shards and rows of each subset. Rows come from footers."""
    out = {}
    for name, is_dir in _files(spark, root):
        splits = {s: [f for f, d in _files(spark, f"{root}/{name}/{s}") if f.endswith(".parquet") and not d] for s, d in (_files(spark, f"{root}/{name}") if is_dir else []) if d}
        splits = {s: shards for s, shards in splits.items() if shards}
        if not splits:
            continue
        columns = spark.read.parquet(*[f"{root}/{name}/{s}/{shards[0]}" for s, shards in splits.items()][:1]).columns
        key = next((c for c in ID_COLUMNS if c in columns), None)
        about = {s: {"shards": shards, "rows": spark.read.parquet(*[f"{root}/{name}/{s}/{x}" for x in shards]).count()} for s, shards in splits.items()}
        payload = {logical_name(c): c for c in columns if c not in (*ID_COLUMNS, "__key__")}
        out[name] = {"modalities": sorted(payload), "columns": payload, "key": key, "splits": about, "rows": sum(x["rows"] for x in about.values())}
    return out


def scan_ids(spark: SparkSession, root: str, subsets: dict) -> DataFrame:
    """``subset, split, shard, key_kind`` and the ids of every payload row; only id columns are read. A subset without an id has a null kind."""
    parts = []
    for name, about in subsets.items():
        for split, s in about["splits"].items():
            data = spark.read.parquet(*[f"{root}/{name}/{split}/{x}" for x in s["shards"]])
            ids = [(F.col(c) if c in data.columns else F.lit(None)).cast("string").alias(c) for c in ID_COLUMNS]
            parts.append(data.select(F.lit(name).alias("subset"), F.lit(split).alias("split"), F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("shard"), F.lit(about["key"]).cast("string").alias("key_kind"), *ids))
    return reduce(DataFrame.unionByName, parts)


def attach_lookup(ids: DataFrame, master: DataFrame, keys: tuple[str, ...] = ID_COLUMNS, columns: tuple[str, ...] = LOOKUP_COLUMNS) -> DataFrame:
    """``ids`` with each lookup column from the first key whose master row has it. Master rows are cut to the ids present, then to one row an id."""
    from mosaiq.operators.master import first_per_key

    out, found = ids, []
    columns = tuple(c for c in columns if c in master.columns)
    for k, key in enumerate(keys):
        present = ids.select(key).where(F.col(key).isNotNull()).distinct()
        one = first_per_key(master.where(F.col(key).isNotNull()).join(present, key, "left_semi"), [key], list(columns))
        out = out.join(one.select(key, *[F.col(f"`{c}`").alias(f"_{k}_{c}") for c in columns]), key, "left")
        found.append(k)
    return out.select(*ids.columns, *[F.coalesce(*[F.col(f"_{k}_{c}") for k in found]).alias(c) for c in columns])


def build_index(spark: SparkSession, root: str, master: DataFrame, out: str) -> dict:
    """Write ``out/index.parquet`` and ``out/subsets.json``; existing output is an error."""
    subsets = describe_subsets(spark, root)
    attach_lookup(scan_ids(spark, root, subsets), master).write.option("compression", "zstd").parquet(f"{out}/index.parquet")
    spark.createDataFrame([(json.dumps(subsets),)], "value string").coalesce(1).write.text(f"{out}/subsets.json")
    return subsets


def published_names(shards: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``published``: data_0000.parquet ... for each subset's shards, by split, then by the number that ends the name, then by name."""
    from pyspark.sql import Window

    split = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).when(F.col("split") == "test", 2).otherwise(3)
    number = F.regexp_extract("shard", r"(\d+)(?:\.[A-Za-z0-9]+)?$", 1).try_cast("bigint")
    w = Window.partitionBy(*(by or ["subset"])).orderBy(split, number.asc_nulls_first(), "shard")
    return shards.withColumn("published", F.format_string("data_%04d.parquet", F.row_number().over(w) - 1))


def release_index(index: DataFrame, names: DataFrame) -> DataFrame:
    """An index whose shards have their published names; rows of shards that are not published go."""
    return index.join(F.broadcast(names.select("subset", "split", "shard", "published")), ["subset", "split", "shard"]).withColumn("shard", F.col("published")).drop("published").select(index.columns)
