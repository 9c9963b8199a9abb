"""Splits that keep clusters whole, representatives of clusters, and balanced cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.ordering import hash_order
from mosaiq.operators.index import hash_ranked


def ntile_splits(df: DataFrame, cluster: Column, tiles: int = 10, train: int = 8, val: int = 1, seed: int = 0) -> DataFrame:
    """``df`` with ``split``: distinct clusters in hash order in ``tiles`` equal tiles, the first ``train`` for training, the next ``val`` to validate, the rest to test. Rows without a cluster go.

    Tiles follow from a rank over hash ranges and the number of clusters, so no task orders all of them.
    """
    rows = df.withColumn("_cluster", cluster.cast("string")).where("_cluster is not null")
    groups = rows.select("_cluster").distinct().withColumn("_h", hash_order("_cluster", seed))
    n = groups.count()
    size, longer = divmod(n, tiles)
    rank = F.col("_rank")
    tile = F.when(rank <= longer * (size + 1), F.ceil(rank / (size + 1))).otherwise(longer + F.ceil((rank - longer * (size + 1)) / max(size, 1)))
    placed = hash_ranked(groups, "_cluster").withColumn("_tile", tile)
    split = F.when(F.col("_tile") <= train, "train").when(F.col("_tile") <= train + val, "val").otherwise("test")
    return rows.join(placed.select("_cluster", split.alias("split")), "_cluster").drop("_cluster")


def representative_cluster(p30: str, p70: str, r30: str) -> Column:
    """The finer protein cluster where all three labels are there, else the coarse protein one, else the transcript one."""
    all_three = F.col(p30).isNotNull() & F.col(r30).isNotNull() & F.col(p70).isNotNull()
    return F.when(all_three, F.col(p70)).when(F.col(p30).isNotNull(), F.col(p30)).otherwise(F.col(r30))


def priority(weights: dict[str, int]) -> Column:
    """The sum of the weights of the flags that hold."""
    return sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) * w for c, w in weights.items()), F.lit(0))


def representatives(df: DataFrame, cluster: str, score: Column, id_col: str, seed: int = 0) -> DataFrame:
    """One row of each cluster: the highest score, then hash order, then id. Row numbers over one make Spark keep one row a task and group."""
    w = Window.partitionBy(cluster).orderBy(F.col("_score").desc(), hash_order(id_col, seed), F.col(id_col))
    return df.where(F.col(cluster).isNotNull()).withColumn("_score", score).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_score")


def balanced(df: DataFrame, flag: str, id_col: str, cap: int, seed: int = 0) -> DataFrame:
    """As many rows of each class of ``flag`` as the smaller has, ``cap`` at most, in hash order."""
    counts = df.where(F.col(flag).isNotNull()).groupBy(flag).count().collect()  # two rows
    if len(counts) < 2:
        return df.limit(0)
    n = min([cap, *(r["count"] for r in counts)])
    first = [df.where(F.col(flag) == r[flag]).orderBy(hash_order(id_col, seed), F.col(id_col)).limit(n) for r in counts]  # a top-n of each task, merged
    return reduce(DataFrame.unionByName, first)


def sample(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """The first n rows in hash order: a top-n of each task, merged."""
    return df.orderBy(hash_order(id_col, seed), F.col(id_col)).limit(n)
