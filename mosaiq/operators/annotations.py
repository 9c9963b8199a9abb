"""Hierarchies of annotations and of taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.sources.storage import materialised


def roots(df: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, root, depth``: the ancestor without a parent (or whose parent is not there), by doubling the pointers, so a walk of depth d takes log d steps. Nodes on a cycle have no root."""
    known = df.select(F.col(node).alias("_k"))
    p = df.select(F.col(node).alias("n"), F.col(parent).alias("p")).join(known, F.col("p") == F.col("_k"), "left").select("n", F.col("_k").alias("p"), F.when(F.col("_k").isNotNull(), 1).otherwise(0).alias("d"))
    state = materialised(p.select("n", F.coalesce("p", "n").alias("at"), "d", F.col("p").isNull().alias("top")), "walk")
    for _ in range(32):
        up = state.select(F.col("n").alias("at"), F.col("at").alias("_at"), F.col("d").alias("_d"), F.col("top").alias("_top"))
        nxt = state.join(up, "at").select("n", F.col("_at").alias("at"), (F.col("d") + F.col("_d")).alias("d"), (F.col("top") | F.col("_top")).alias("top"))
        left = state.where(~F.col("top")).count()
        if left == 0:
            break
        nxt = materialised(nxt, "walk")
        if nxt.where(~F.col("top")).count() == left:  # only cycles are left
            break
        state = nxt
    return state.where("top").select(F.col("n").alias(node), F.col("at").alias("root"), F.col("d").cast("int").alias("depth"))


def isoforms(df: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes that have children, one of which has none."""
    parents = df.where(F.col(parent).isNotNull()).select(F.col(parent).alias("_p")).distinct()
    childless = df.join(parents, F.col(node) == F.col("_p"), "left_anti")
    wanted = childless.where(F.col(parent).isNotNull()).select(F.col(parent).alias("_w")).distinct()
    return df.join(wanted, F.col(node) == F.col("_w"), "left_semi")


def children_coordinates(df: DataFrame, parent: str, kind: str, start: str, end: str, kinds: list[str]) -> DataFrame:
    """For each parent the sorted coordinates of its children of each kind, ``<kind>_coordinates``; null where it has none."""
    at = lambda k: F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.struct(F.col(start).alias("start"), F.col(end).alias("end")))))
    out = df.where(F.col(parent).isNotNull()).groupBy(parent).agg(*[at(k).alias(f"{k}_coordinates") for k in kinds])
    return out.withColumns({f"{k}_coordinates": F.when(F.size(f"{k}_coordinates") > 0, F.col(f"{k}_coordinates")) for k in kinds})


def lineage_ranks(nodes: DataFrame, names: DataFrame, ranks: list[str], max_depth: int = 64) -> DataFrame:
    """``taxid`` and a column with the name of its ancestor (or itself) of each rank; pairs of a node and an ancestor grow by a level a step."""
    up = nodes.select(F.col("taxid").alias("a"), "parent", "rank")
    level = up.select(F.col("a").alias("taxid"), "a", "parent", "rank")
    pairs = level
    for _ in range(max_depth):
        level = materialised(level.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("a"))).select("taxid", F.col("parent").alias("a")).join(up, "a").select("taxid", "a", "parent", "rank"), "lineage")
        if level.isEmpty():
            break
        pairs = pairs.unionByName(level)
    named = pairs.where(F.col("rank").isin(ranks)).join(names.select(F.col("taxid").alias("a"), "name"), "a")
    return nodes.select("taxid").join(named.groupBy("taxid").agg(*[F.max(F.when(F.col("rank") == r, F.col("name"))).alias(r) for r in ranks]), "taxid", "left")


def exon_counts(transcripts: DataFrame, gene: str, coords: str) -> DataFrame:
    """``gene, position, n``: how many transcripts of a gene cover each position, from the ends of intervals (1-based inclusive) and a running sum."""
    from pyspark.sql import Window

    steps = transcripts.select(gene, F.explode(coords).alias("x")).select(gene, F.explode(F.array(F.struct(F.col("x.start").alias("position"), F.lit(1).alias("d")), F.struct((F.col("x.end") + 1).alias("position"), F.lit(-1).alias("d")))).alias("e"))
    summed = steps.groupBy(gene, F.col("e.position").alias("position")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(gene).orderBy("position")
    return summed.withColumn("n", F.sum("d").over(w)).withColumn("end", F.lead("position").over(w)).where("n > 0").select(gene, F.explode(F.sequence("position", F.col("end") - 1)).alias("position"), "n")


def transcript_info(df: DataFrame, feature: str, kind: str, cds: str) -> DataFrame:
    """Rows of features with exactly one coding id, transcripts before genes."""
    one = df.groupBy(feature).agg(F.count_distinct(cds).alias("_n")).where("_n = 1")
    rank = F.when(F.col(kind) == "mRNA", 0).when(F.col(kind) == "gene", 1).otherwise(2)
    return df.join(one, feature, "left_semi").groupBy(feature).agg(F.min(F.struct(rank.alias("r"), F.col(kind), F.col(cds))).alias("b")).select(feature, F.col(f"b.{kind}"), F.col(f"b.{cds}"))
