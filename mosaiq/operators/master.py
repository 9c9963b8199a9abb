"""Master tables: one row for each pairing of ids, with lengths, presence flags and looked-up columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``, nulls last. A total order makes it deterministic."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def transform_column(df: DataFrame, column: str, kind: str | None, name: str) -> Column:
    """``len``: the value's length as ``<name>_length``; ``exists``: ``has_<name>``; none: the value as ``name``."""
    if kind == "len":
        t = dict(df.dtypes)[column]
        return (F.size(column) if t.startswith("array") else F.length(column)).cast("int").alias(f"{name}_length")
    if kind == "exists":
        return F.lit(True).alias(f"has_{name}")
    if kind is None:
        return F.col(column).alias(name)
    raise ValueError(f"unknown transform {kind!r}")


def fold_outer(base: DataFrame, modalities: list[tuple[DataFrame, str, str, str | None, str]]) -> DataFrame:
    """Full outer joins of (table, key, column, transform, name) onto ``base`` by each table's key; absent flags are false."""
    out, flags = base, []
    for df, key, column, kind, name in modalities:
        value = transform_column(df, column, kind, name)
        out = out.join(df.select(key, value), key, "full")
        flags += [f"has_{name}"] * (kind == "exists")
    return out.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}) if flags else out


def exclusive_union(base: DataFrame, assays: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of every exclusive assay with the base's columns, united by name, then the base rows that no assay has, flags false."""
    parts = [base.join(df.withColumn(f"has_{name}", F.lit(True)), key, "right") for name, df in assays.items()]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = null_safe_anti(base, united, base.columns)
    out = united.unionByName(rest, allowMissingColumns=True)
    return out.withColumns({f"has_{n}": F.coalesce(f"has_{n}", F.lit(False)) for n in assays})


def null_safe_anti(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``left`` that no row of ``right`` equals in ``columns``; nulls equal each other."""
    r = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in columns]).distinct()
    return left.join(r, reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"_r_{c}"]) for c in columns]), "left_anti")


def id_map(df: DataFrame, key: str, value: str, keep: str = "first", order: str | None = None) -> DataFrame:
    """One value a key, the first or last by ``order`` (else by value)."""
    order = order or value
    pick = F.min_by if keep == "first" else F.max_by
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick(value, F.struct(order, value)).alias(value))


def fold_rare(df: DataFrame, column: str, least: int, other: str = "other") -> DataFrame:
    """Values with fewer than ``least`` rows become ``other``; counts come from one aggregation, so a frequent value is no hot window."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(F.col(column).alias("_kept"))
    return df.join(counts, F.col(column) == F.col("_kept"), "left").withColumn(column, F.when(F.col("_kept").isNotNull(), F.col(column)).when(F.col(column).isNotNull(), other)).drop("_kept")


def prefer_source(df: DataFrame, key: str, source: str, order: list[str]) -> DataFrame:
    """For each key the rows of its best source only; sources that are not listed come last, by name."""
    rank = reduce(lambda c, x: c.when(F.col(source) == x[1], x[0]), list(enumerate(order))[1:], F.when(F.col(source) == order[0], 0)).otherwise(len(order))
    ranked = df.withColumn("_r", F.struct(rank.alias("r"), F.col(source).alias("s")))
    best = ranked.groupBy(key).agg(F.min("_r").alias("_b"))
    return ranked.join(best, key).where("_r = _b").drop("_r", "_b")


def merge_payload(ids: DataFrame, tables: list[DataFrame], keys: list[str], row_key: str = "__key__") -> DataFrame:
    """Inner joins of ``tables`` on ``keys`` with a 0-based row key in the order of the keys, numbered by range partition."""
    out = ids
    for t in tables:
        out = out.join(t, keys, "inner")
    return with_row_key(out, keys, row_key)


def with_row_key(df: DataFrame, order: list[str], name: str = "__key__") -> DataFrame:
    """Consecutive numbers from 0 in ``order``: rows are sorted by range, counted for each partition, and numbered inside it past the ones before."""
    from mosaiq.sources.storage import materialised

    placed = materialised(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "row-key")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return placed.withColumn("_i", inside).join(F.broadcast(base), "_p").withColumn(name, (F.col("_b") + F.col("_i")).cast("bigint")).drop("_p", "_i", "_b")


def schema_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``column, expected_type, actual_type, state`` (missing, extra, changed, same)."""
    e, a = dict(expected.dtypes), dict(actual.dtypes)
    rows = [(c, e.get(c), a.get(c), "missing" if c not in a else "extra" if c not in e else "same" if e[c] == a[c] else "changed") for c in sorted({*e, *a})]
    return expected.sparkSession.createDataFrame(rows, "column string, expected_type string, actual_type string, state string")
