"""Leakage between splits: shared clusters in one hop, and through chains of shared keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.sources.storage import materialised

SPLITS = ("train", "val", "test")


def split_flags(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """``key, has_train, has_val, has_test, split_count`` of every key that is not null."""
    flags = [F.bool_or(F.col(split) == s).alias(f"has_{s}") for s in SPLITS]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*flags).withColumn("split_count", sum(F.col(f"has_{s}").cast("int") for s in SPLITS))


def one_hop_report(df: DataFrame, root: str, key: str, cohorts: dict[str, Column], split: str = "split") -> DataFrame:
    """``cohort, split, roots, mixed_train_only, mixed_other_only, mixed_both, pure`` of val and test.

    A root is in a state of a cohort if one of its rows in the split is. Rows are first folded to one for each
    root and split, so many distinct counts need no copies of the rows.
    """
    rows = df.join(split_flags(df, key, split), key, "left")
    states = {}
    for s, other in (("val", "test"), ("test", "val")):
        here = F.col(split) == s
        states[s] = {
            "mixed_train_only": here & F.col("has_train") & ~F.col(f"has_{other}"),
            "mixed_other_only": here & ~F.col("has_train") & F.col(f"has_{other}"),
            "mixed_both": here & F.col("has_train") & F.col(f"has_{other}"),
            "pure": here & (F.col("split_count") == 1),
        }
    folded = []
    for c, condition in cohorts.items():
        for s in states:
            folded.append(F.bool_or(condition & (F.col(split) == s)).alias(f"{c}|{s}|roots"))
            folded += [F.bool_or(condition & x).alias(f"{c}|{s}|{n}") for n, x in states[s].items()]
    by_root = rows.where(F.col(root).isNotNull()).groupBy(root).agg(*folded)
    names = ["roots", *states["val"]]
    one = by_root.agg(*[F.count_if(F.col(f"`{c}|{s}|{n}`")).alias(f"{c}|{s}|{n}") for c in cohorts for s in states for n in names])
    cells = [F.struct(F.lit(c).alias("cohort"), F.lit(s).alias("split"), *[F.col(f"`{c}|{s}|{n}`").alias(n) for n in names]) for c in cohorts for s in states]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def purity(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """``df`` with ``pure_<key>``: the key is there and no training row has it."""
    for k in keys:
        df = df.join(split_flags(df, k, split).select(k, F.col("has_train").alias(f"_t_{k}")), k, "left")
    return df.withColumns({f"pure_{k}": F.col(k).isNotNull() & ~F.coalesce(f"_t_{k}", F.lit(False)) for k in keys}).drop(*[f"_t_{k}" for k in keys])


def venn(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Rows of val and test in each cell of the keys' purity."""
    return purity(df, keys, split).where(F.col(split) != "train").groupBy(*[f"pure_{k}" for k in keys]).agg(F.count("*").alias("n_rows"))


def edges(df: DataFrame, rid: str, keys: list[str]) -> DataFrame:
    """``rid, key``: a row for each key of each row that is not null; keys of different kinds never meet."""
    kinds = F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(n).alias("kind"), F.col(k).cast("string").alias("value"))) for n, k in enumerate(keys)])
    return df.select(F.col(rid).alias("rid"), F.explode(F.array_compact(F.array_distinct(kinds))).alias("key"))


def hops(df: DataFrame, rid: str, keys: list[str], seed: Column, max_hops: int = 60) -> DataFrame:
    """``rid, hop``: 0 for rows where ``seed`` holds, h for rows that first share a key with a row of hop h-1; rows that are never reached have none.

    Each hop joins only the keys that the last hop brought, without the keys used before, and is written
    to the shared folder, so a hop costs what it newly reaches and lost executors cost one hop at most.
    """
    e = materialised(edges(df, rid, keys), "edges")
    front = df.where(seed).select(F.col(rid).alias("rid")).distinct().withColumn("hop", F.lit(0))
    reached = materialised(front, "hop")
    used = None
    newest = reached
    for hop in range(1, max_hops + 1):
        fresh = e.join(newest.select("rid"), "rid", "left_semi").select("key").distinct()
        if used is not None:
            fresh = fresh.join(used, "key", "left_anti")
        fresh = materialised(fresh, "keys")
        found = e.join(fresh, "key", "left_semi").select("rid").distinct().join(reached.select("rid"), "rid", "left_anti")
        newest = materialised(found.withColumn("hop", F.lit(hop)), "hop")
        if newest.isEmpty():
            break
        reached = reached.unionByName(newest)
        used = fresh if used is None else used.unionByName(fresh)
    return reached


def hop_profile(df: DataFrame, rid: str, keys: list[str], split: str = "split", cohorts: dict[str, Column] | None = None, max_hops: int = 60) -> DataFrame:
    """``hop, n_new`` and for each cohort its new rows of a hop, over val and test; hop -1 holds the rows that are never reached."""
    cohorts = cohorts or {}
    found = hops(df, rid, keys, F.col(split) == "train", max_hops)
    rows = df.withColumn("rid", F.col(rid)).join(found, "rid", "left").withColumn("hop", F.coalesce("hop", F.lit(-1)))
    return rows.groupBy("hop").agg(F.count("*").alias("n_new"), *[F.count_if(c & (F.col(split) != "train")).alias(f"new_{n}") for n, c in cohorts.items()])
