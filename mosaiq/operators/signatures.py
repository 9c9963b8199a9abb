"""Presence signatures: which columns a row has, how many rows a set of columns covers, and which subsets to make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signature(flags: list[str]) -> Column:
    """A string of 0 and 1, one for each flag; null counts as 0."""
    return F.concat(*[F.when(F.col(f), "1").otherwise("0") for f in flags])


def mask(flags: list[str]) -> Column:
    """The signature as a number, the first flag its highest bit; up to 62 flags."""
    return sum((F.when(F.col(f), F.lit(1 << (len(flags) - 1 - k))).otherwise(F.lit(0)).cast("bigint") for k, f in enumerate(flags)), F.lit(0).cast("bigint"))


def signature_counts(df: DataFrame, flags: list[str], required: list[str] | None = None) -> DataFrame:
    """``signature, mask, n`` of rows with one flag of ``required`` at least."""
    if required:
        df = df.where(F.coalesce(F.greatest(*[F.col(r) for r in required]) if len(required) > 1 else F.col(required[0]), F.lit(False)))
    return df.groupBy(signature(flags).alias("signature"), mask(flags).alias("mask")).agg(F.count("*").alias("n"))


def superset_coverage(counts: DataFrame) -> DataFrame:
    """``coverage``: the rows of all signatures that have at least this one's flags. Signatures are few; rows are not touched."""
    s = counts.select(F.col("mask").alias("s"), F.col("n").alias("m"))
    over = counts.join(F.broadcast(s), F.col("s").bitwiseAND(F.col("mask")) == F.col("mask"))
    return over.groupBy("signature", "mask", "n").agg(F.sum("m").alias("coverage"))


def greedy_assignment(counts: DataFrame, picked: list[int], flags: list[str], priorities: list[str] = ()) -> DataFrame:
    """For every signature that is not picked the picked one it goes to: contained in it, then by each priority flag in turn, then by most flags, then by pick order; null if none is contained."""
    spark, bit = counts.sparkSession, {f: 1 << (len(flags) - 1 - k) for k, f in enumerate(flags)}
    p = spark.createDataFrame([(m, k, bin(m).count("1")) for k, m in enumerate(picked)], "picked bigint, place int, size int")
    fit = counts.where(~F.col("mask").isin(picked)).join(F.broadcast(p), F.col("picked").bitwiseAND(F.col("mask")) == F.col("picked"), "left")
    rank = F.struct(*[F.col("picked").bitwiseAND(F.lit(bit[f])) != 0 for f in priorities], F.col("size"), -F.col("place"))
    return fit.groupBy("signature", "mask", "n").agg(F.max_by("picked", rank).alias("picked"))


def subset_name(names: list[str], exclusive: list[str] = ()) -> str:
    """Modalities joined with ``+``; at most one exclusive modality may be among them."""
    if sum(n in exclusive for n in names) > 1:
        raise ValueError(f"more than one exclusive modality in {names}")
    return "+".join(sorted(names))


def withheld_cost(df: DataFrame, flags: list[str], withheld: str) -> DataFrame:
    """Rows of each signature without ``withheld``, with those that lose their last flag under an all-zero signature."""
    return signature_counts(df, [f for f in flags if f != withheld])


def largest(df: DataFrame, by: str, n: int, order: str) -> DataFrame:
    return df.orderBy(F.desc(by), order).limit(n)


def report(counts: DataFrame) -> DataFrame:
    """Signatures by falling count with the running sum; a row a signature."""
    w = Window.orderBy(F.desc("n"), "signature").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("running", F.sum("n").over(w))
