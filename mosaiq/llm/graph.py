"""Connected components of large sparse graphs, with every step written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.textutil import discard, stored

HELD = 200_000  # nodes that a task holds while it shortens paths


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the smallest node that it sees, at most ``HELD`` nodes and a batch at a time."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        pairs = [(x, y) for x in list(parent) if (y := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, label`` of every node of ``edges`` (``u, v`` bigint); the label is the component's smallest node.

    Each task first shortens the paths that it sees, then large-star and small-star steps follow in turn, whatever the size: a step needs one
    aggregation by node, edges never outnumber the input's, and the number of steps grows with the logarithm of a component's size. An empty
    table gives no rows. The result is stored; the steps before it are deleted.
    """
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().mapInArrow(_shortened, "u bigint, v bigint"), name)
    before = None
    while True:
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before or now[0] == 0:
            break
        before = tuple(now)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        step = stored(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            name,
        )
        discard(e)
        e = step
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
