"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All but the last keep the columns of ``documents``.

1. quality: documents that the rule ensemble (fitted on labels that are not held out) scores under 0.5 go;
2. near_duplicates: of each group linked by word 5-grams at a Jaccard similarity of 0.8 or more one document
   stays, that of the smallest id (a null id counts as the largest);
3. secrets: spans of the scan are replaced by a mark in the text;
4. mixing: the documents' words in the mix of sources by weight, a row for each epoch that takes words of one;
5. packing: pieces of at most 1024 token ids in sequences; ``row`` tells the epochs of a document apart.

Null texts count as empty, repeated rows as near copies, and an empty table passes all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.jaccard_join import jaccard_join
from mosaiq.llm.mixing import mixed_documents
from mosaiq.llm.packing import pack
from mosaiq.llm.rule_ensemble import accepted, train
from mosaiq.llm.secrets import redact
from mosaiq.llm.textutil import default_vocabulary, documents, shared_path

ORACLE_SQL = None  # model scores, token ids and drawn blocks are beyond SQL; tests compare each stage with a brute-force version


def _with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a document is its id and 128 bits of its text; of rows that are equal in these one stays
    text = F.col("_row.text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("_key", F.struct(F.isnull("_row.doc_id").alias("none"), F.col("_row.doc_id").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")))
    found = jaccard_join(rows.select(F.col("_key").alias("id"), text.alias("text")), n=5, percent=80, id_col="id")
    # a document without words is linked with nothing and stays
    kept = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("_key")).distinct()
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_size(redact(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_size(mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
