"""Intervals: unions, range joins, track slices, labels by quantiles, masks and flanks. Ends are exclusive."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

MOST_VALUES = 1_000_000  # positions of features that a task gives at a time


def interval_union(df: DataFrame, by: list[str], start: str, end: str, score: str) -> DataFrame:
    """Intervals that overlap or touch become one, with the largest score: a new island begins where no earlier interval reaches."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
    marked = df.withColumn("_reach", reach).withColumn("_island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.max(score).alias(score)).drop("_island")


def clipped(df: DataFrame, sizes: DataFrame, chrom: str, start: str, end: str, size: str = "size") -> DataFrame:
    """Intervals inside their chromosome; empty ones and unknown chromosomes go."""
    return df.join(sizes.select(chrom, F.col(size).alias("_size")), chrom).withColumn(start, F.greatest(F.col(start), F.lit(0))).withColumn(end, F.least(end, "_size")).where(F.col(start) < F.col(end)).drop("_size")


def range_join(left: DataFrame, right: DataFrame, by: list[str], l_start: str, l_end: str, r_start: str, r_end: str, width: int) -> DataFrame:
    """Pairs whose intervals overlap, by an equi-join on bins of ``width``; a pair is made in the first bin that both are in."""
    first, last = (lambda s: F.floor(F.col(s) / width)), (lambda e: F.floor((F.col(e) - 1) / width))
    a = left.where(F.col(l_start) < F.col(l_end)).withColumn("_bin", F.explode(F.sequence(first(l_start), last(l_end))))
    b = right.where(F.col(r_start) < F.col(r_end)).withColumn("_bin", F.explode(F.sequence(first(r_start), last(r_end))))
    pairs = a.join(b, [*by, "_bin"]).where((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)))
    return pairs.where(F.col("_bin") == F.greatest(first(l_start), first(r_start))).drop("_bin")


def _painted(rows: DataFrame, width: int, kept: list[str]) -> DataFrame:
    """``kept`` and ``_v`` of the rows that are features: the largest value at each position from ``_s`` to ``_e`` of their bin, null where no interval is.

    One scan of the rows of each bin, intervals (``_kind`` 0) before features (1), that holds one bin's positions; ``_new`` marks a bin's first row.
    """
    schema = StructType([*(rows.schema[c] for c in kept), StructField("_v", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, there = np.empty(width), np.empty(width, bool)

        def given(batch: pa.RecordBatch, at: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(x) for x, _ in found)]).astype(np.int32)
            values = pa.array(np.concatenate([x for x, _ in found]), mask=~np.concatenate([x for _, x in found]))
            return pa.RecordBatch.from_arrays([*batch.select(kept).take(pa.array(at)).columns, pa.ListArray.from_arrays(pa.array(ends), values)], schema.names)

        for batch in batches:
            at, found, n = [], [], 0
            for k, (new, kind, s, e, v) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_new", "_kind", "_s", "_e", "_value")))):
                if new:
                    held.fill(-np.inf)
                    there.fill(False)
                if kind == 0:
                    np.maximum(held[s:e], v, out=held[s:e])
                    there[s:e] = True
                    continue
                at.append(k)
                found.append((held[s:e].copy(), there[s:e].copy()))
                n += e - s
                if n > MOST_VALUES:
                    yield given(batch, at, found)
                    at, found, n = [], [], 0
            if at:
                yield given(batch, at, found)

    return rows.mapInArrow(run, schema)


def track_slice(features: DataFrame, track: DataFrame, by: list[str], key: str, start: str, end: str, r_start: str, r_end: str, value: str, width: int, reverse: Column | None = None, internal_zero: bool = False, size: str | None = None) -> DataFrame:
    """``key, by, track`` with one value a position of each feature: NaN where the track has none; features with no track at all are NaN throughout.

    ``reverse`` turns minus-strand features round; ``internal_zero`` makes positions without signal 0, but for those at or
    past ``size``, the column of ``features`` with the chromosome's length, and those before 0, which stay NaN. Where intervals overlap the largest value
    holds. Intervals and features meet in bins of ``width`` positions: the intervals are painted on the bin, and the features read from it, so no
    pairs are made and the work is that of the rows and their positions, however many intervals lie on one place.
    """
    first, last = (lambda s: F.floor(F.col(s) / width)), (lambda e: F.floor((F.col(e) - 1) / width))
    turn, length = F.lit(False) if reverse is None else reverse, (F.col(size) if size else F.lit(None)).cast("bigint")
    f = features.select(key, *by, F.col(start).alias("_start"), F.col(end).alias("_end"), turn.alias("_turn"), length.alias("_size"))
    known = lambda names: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    placed = known([*by, "_start", "_end"]) & F.coalesce(F.col("_start") < F.col("_end"), F.lit(False))
    at = lambda p: F.least(F.greatest(F.col(p) - F.col("_bin") * width, F.lit(0)), F.lit(width)).cast("int")
    pieces = f.where(placed).withColumn("_bin", F.explode(F.sequence(first("_start"), last("_end")))).withColumns({"_kind": F.lit(1), "_s": at("_start"), "_e": at("_end")})
    laid = track.select(*by, F.col(r_start).alias("_start"), F.col(r_end).alias("_end"), F.col(value).cast("double").alias("_value"))
    laid = laid.where(known([*by, "_value"]) & (F.col("_start") < F.col("_end")))
    laid = laid.withColumn("_bin", F.explode(F.sequence(first("_start"), last("_end")))).select(*by, "_bin", F.lit(0).alias("_kind"), at("_start").alias("_s"), at("_end").alias("_e"), "_value")
    rows = pieces.unionByName(laid, allowMissingColumns=True)
    rows = rows.withColumn("_new", F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_kind")) == 1)
    cut = _painted(rows, width, [*f.columns, "_bin"])
    # equal rows of features have each bin as often as they are repeated
    parts = cut.groupBy(*f.columns).agg(F.sort_array(F.collect_list(F.struct("_bin", "_v"))).alias("_at"))
    parts = parts.withColumn("_copies", (F.size("_at") / (last("_end") - first("_start") + 1)).cast("int"))
    joined = F.flatten(F.transform(F.filter("_at", lambda x, k: k % F.col("_copies") == 0), lambda x: x["_v"]))
    found = parts.select(*f.columns, joined.alias("_v"), F.explode(F.sequence(F.lit(1), "_copies"))).drop("col")
    empty = F.array_repeat(F.lit(None).cast("double"), F.greatest(F.col("_end") - F.col("_start"), F.lit(0)).cast("int"))
    found = found.unionByName(f.where(~placed).withColumn("_v", F.coalesce(empty, F.array().cast("array<double>"))))
    nan, none = F.lit(float("nan")), F.lit(0.0) if internal_zero else F.lit(float("nan"))
    place = lambda k: F.col("_start") + k
    inside = (lambda k: (place(k) >= 0) & (place(k) < F.col("_size"))) if size else (lambda k: place(k) >= 0)
    found = found.withColumn("_any", F.exists("_v", lambda x: x.isNotNull()))
    values = F.transform("_v", lambda x, k: F.coalesce(x, F.when(F.col("_any") & inside(k), none).otherwise(nan)))
    return found.select(key, *by, F.when(F.col("_turn"), F.reverse(values)).otherwise(values).alias("track"))


def quantile_labels(df: DataFrame, by: list[str], value: str, bins: int = 10, constant: int = 5) -> DataFrame:
    """``label`` from 1 to ``bins``: one more than the inner quantile edges (linear) under the value; groups of one value get ``constant``."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    edges = df.groupBy(*by).agg(F.percentile(value, shares).alias("_edges"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    label = F.least(F.lit(bins), F.size(F.filter("_edges", lambda e: e < F.col(value))) + 1)
    return df.join(edges, by).withColumn("label", F.when(F.col("_lo") == F.col("_hi"), constant).otherwise(label)).drop("_edges", "_lo", "_hi")


def label_string(labels: str) -> Column:
    """One character a position: none or NaN ``U``, 0 ``N``, 10 ``X``, else the digit."""
    one = lambda x: F.when(x.isNull() | F.isnan(x.cast("double")), "U").when(x == 0, "N").when(x == 10, "X").otherwise(x.cast("int").cast("string"))
    return F.array_join(F.transform(labels, one), "")


def minmax_by_context(df: DataFrame, context: str, track: str, tolerance: float = 0.05) -> DataFrame:
    """Tracks scaled to 0..1 by their context's range over values that are there; nulls (masked) stay null, NaN stays NaN.

    Constant contexts become 0.5, and contexts whose range is 0..1 within ``tolerance`` already are left.
    """
    there = F.filter(track, lambda x: x.isNotNull() & ~F.isnan(x))
    ranges = df.groupBy(context).agg(F.min(F.array_min(there)).alias("_lo"), F.max(F.array_max(there)).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    scale = F.transform(track, lambda x: F.when(x.isNull() | F.isnan(x), x).when(hi == lo, F.lit(0.5)).otherwise((x - lo) / (hi - lo)))
    kept = (F.abs(lo) <= tolerance) & (F.abs(hi - 1) <= tolerance)
    return df.join(ranges, context, "left").withColumn(track, F.when(lo.isNull() | kept, F.col(track)).otherwise(scale)).drop("_lo", "_hi")


def nan_ratio(track: str) -> Column:
    return F.size(F.filter(track, lambda x: x.isNull() | F.isnan(x))) / F.size(track)


def flanks(df: DataFrame, by: list[str], ordinal: str, start: str, end: str, upstream: Column, downstream: Column, least: int = 200) -> DataFrame:
    """``flank_start, flank_end`` of each row between its neighbours by ``ordinal``: not past the row before's end or the row after's start, but ``least`` wide all the same, and not under 1."""
    w = Window.partitionBy(*by).orderBy(ordinal)
    before, after = F.lag(end).over(w), F.lead(start).over(w)
    s = F.greatest(F.lit(1), F.coalesce(F.greatest(F.col(start) - upstream, before + 1), F.col(start) - upstream))
    s = F.when(F.col(start) - s < least, F.greatest(F.lit(1), F.col(start) - least)).otherwise(s)
    e = F.coalesce(F.least(F.col(end) + downstream, after), F.col(end) + downstream)
    e = F.when(e - F.col(end) < least, F.col(end) + least).otherwise(e)
    return df.withColumns({"flank_start": s, "flank_end": e})


def flank_sizes(kingdom: str, strand: str) -> tuple[Column, Column]:
    """(upstream, downstream) in coordinates: 200 each for bacteria and archaea, else 1000 and 300, turned round on the minus strand."""
    short = F.col(kingdom).isin("Bacteria", "Archaea")
    minus = F.col(strand) == "-"
    up, down = F.when(short, 200).otherwise(1000), F.when(short, 200).otherwise(300)
    return F.when(minus, down).otherwise(up), F.when(minus, up).otherwise(down)


def liftover(df: DataFrame, chain: DataFrame, chrom: str, start: str, end: str, width: int) -> DataFrame:
    """Intervals that lie inside one block of a chain table (chrom, t_start, t_end, q_chrom, q_start), moved by its offset; others go."""
    hit = range_join(df, chain.withColumnRenamed("chrom", chrom), [chrom], start, end, "t_start", "t_end", width).where((F.col(start) >= F.col("t_start")) & (F.col(end) <= F.col("t_end")))
    shift = F.col("q_start") - F.col("t_start")
    return hit.withColumns({start: F.col(start) + shift, end: F.col(end) + shift, chrom: F.col("q_chrom")}).drop("t_start", "t_end", "q_chrom", "q_start")


def nearest_vertices(atoms: DataFrame, vertices: DataFrame, key: str, residue: str, cutoff: float, features: dict[str, Column]) -> DataFrame:
    """Aggregates over the vertices nearer than ``cutoff`` to an atom of a residue: points meet in cells of the cutoff's size and the 26 around them.

    ``atoms``: key, residue, x, y, z; ``vertices``: key, vid, x, y, z and the columns that ``features`` aggregate.
    Residues without such vertices have a count of 0 and NaN features.
    """
    cell = lambda p: [F.floor(F.col(f"{p}{c}") / cutoff) for c in "xyz"]
    step = F.sequence(F.lit(-1), F.lit(1))
    a = atoms.select(key, residue, *[F.col(c).alias(f"a{c}") for c in "xyz"])
    near = a
    around = lambda v: F.transform(step, lambda d: v + d)
    for c, v in zip("xyz", cell("a")):
        near = near.withColumn(f"_{c}", F.explode(around(v)))
    v = vertices.withColumnsRenamed({c: f"v{c}" for c in "xyz"})
    for c, x in zip("xyz", cell("v")):
        v = v.withColumn(f"_{c}", x)
    gap = sum((F.col(f"a{c}") - F.col(f"v{c}")) * (F.col(f"a{c}") - F.col(f"v{c}")) for c in "xyz")
    touching = near.join(v, [key, "_x", "_y", "_z"]).where(gap < cutoff * cutoff).dropDuplicates([key, residue, "vid"])
    found = touching.groupBy(key, residue).agg(F.count("*").alias("n_vertices"), *[c.alias(n) for n, c in features.items()])
    rows = atoms.select(key, residue).distinct().join(found, [key, residue], "left")
    return rows.select(key, residue, F.coalesce("n_vertices", F.lit(0)).cast("bigint").alias("n_vertices"), *[F.coalesce(n, F.lit(float("nan"))).alias(n) for n in features])
