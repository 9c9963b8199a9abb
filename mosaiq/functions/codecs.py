"""Codecs of per-position values as token ids, their inverses, and votes over predictions.

Each codec is a pair of column functions. In tracks, null is masked and NaN is unmeasured; both encode to the
codec's special ids as its docstring says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


@dataclass(frozen=True)
class CharCodec:
    """Letters in sorted order, then pad, mask and unknown."""

    vocabulary: str
    unknown: str = "X"
    pad: str = "#"
    mask: str = "_"

    @property
    def ids(self) -> dict[str, int]:
        v = sorted(set(self.vocabulary))
        return {x: k for k, x in enumerate(v)} | {self.pad: len(v), self.mask: len(v) + 1, self.unknown: len(v) + 2}

    @property
    def unknown_id(self) -> int:
        return len(set(self.vocabulary)) + 2

    def encode(self, s: Column) -> Column:
        table = _map(self.ids)
        return F.when(F.length(s) > 0, F.transform(F.split(s, ""), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(self.unknown_id)))).when(s.isNotNull(), F.array().cast("array<int>"))

    def decode(self, ids: Column) -> Column:
        table = _map({v: k for k, v in self.ids.items()})
        return F.array_join(F.transform(ids, lambda x: F.coalesce(F.try_element_at(table, x), F.lit(self.unknown))), "")


@dataclass(frozen=True)
class ClassCodec:
    """Labels in the given order; others are unknown, the last id."""

    labels: tuple[str, ...]
    unknown: str = "Other"

    def encode(self, label: Column) -> Column:
        return F.coalesce(F.try_element_at(_map({x: k for k, x in enumerate(self.labels)}), label), F.lit(len(self.labels) + 2))

    def encode_all(self, labels: Column) -> Column:
        return F.transform(labels, self.encode)

    def decode(self, k: Column) -> Column:
        return F.coalesce(F.try_element_at(_map(dict(enumerate(self.labels))), k), F.lit(self.unknown))


@dataclass(frozen=True)
class BoolCodec:
    """0 and 1, the specials 2 and 3, and unknown 4 for all else."""

    def encode(self, x: Column) -> Column:
        return F.when(x.cast("int").between(0, 4), x.cast("int")).otherwise(4)


@dataclass(frozen=True)
class BinCodec:
    """Bins [e_i, e_i+1) of increasing edges, the ends widened by 1e-6; then pad, mask and unknown. Null is masked, NaN and values outside are unknown."""

    edges: tuple[float, ...]
    centres: tuple[float, ...] | None = None

    @property
    def bins(self) -> int:
        return len(self.edges) - 1

    @property
    def middles(self) -> tuple[float, ...]:
        return self.centres or tuple((a + b) / 2 for a, b in zip(self.edges, self.edges[1:]))

    def encode_value(self, x: Column) -> Column:
        wide = [self.edges[0] - 1e-6, *self.edges[1:-1], self.edges[-1] + 1e-6]
        under = sum(((x >= e).cast("int") for e in wide[1:-1]), F.lit(0))
        return F.when(x.isNull(), self.bins + 1).when(F.isnan(x) | (x < wide[0]) | (x >= wide[-1]), self.bins + 2).otherwise(under)

    def encode(self, values: Column) -> Column:
        return F.transform(values, lambda x: self.encode_value(x.cast("double")))

    def decode(self, ids: Column) -> Column:
        """Centres; special ids become NaN, masked ones null."""
        table = F.array(*[F.lit(float(m)) for m in self.middles])
        return F.transform(ids, lambda i: F.when(i == self.bins + 1, F.lit(None).cast("double")).otherwise(F.coalesce(F.when((i >= 0) & (i < self.bins), F.get(table, i)), F.lit(float("nan")))))

    def weighted_mean(self, p: Column) -> Column:
        """The mean of centres under probabilities, without those of special ids."""
        table = F.array(*[F.lit(float(m)) for m in self.middles])
        used = F.slice(p, 1, self.bins)
        return F.aggregate(F.zip_with(used, table, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)


@dataclass(frozen=True)
class SurfaceCodec:
    """Bins as ``BinCodec``; NaN is buried, and like unknown values the last id."""

    bins: BinCodec

    def encode(self, values: Column) -> Column:
        last = self.bins.bins + 2
        return F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x.cast("double")), last).otherwise(self.bins.encode_value(x.cast("double"))))


def soft_vote(df: DataFrame, keys: list[str], probabilities: str) -> DataFrame:
    """``keys, token, probability``: the mean of the passes' probability vectors and its largest entry, the smaller token on ties."""
    each = df.select(*keys, F.posexplode(probabilities).alias("token", "p")).groupBy(*keys, "token").agg(F.avg("p").alias("probability"))
    return each.groupBy(*keys).agg(F.max(F.struct("probability", (-F.col("token")).alias("t"))).alias("b")).select(*keys, (-F.col("b.t")).alias("token"), F.col("b.probability").alias("probability"))


def hard_vote(df: DataFrame, keys: list[str], token: str, pad: int = -1) -> DataFrame:
    """``keys, token, share``: the most frequent token of the passes and its share of them, the smaller on ties; padding does not vote."""
    votes = df.where(F.col(token) != pad).groupBy(*keys, F.col(token).alias("token")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = votes.withColumn("all", F.sum("n").over(w)).groupBy(*keys).agg(F.max(F.struct("n", (-F.col("token")).alias("t"), "all")).alias("b"))
    return ranked.select(*keys, (-F.col("b.t")).alias("token"), (F.col("b.n") / F.col("b.all")).alias("share"))


def log_probability(p: Column) -> Column:
    return F.log(p + F.lit(1e-10))


def padded(df: DataFrame, by: list[str], tokens: str, pad: int, order: str) -> DataFrame:
    """Tokens of a batch padded to its longest row, with a mask of what is real; the longest comes from one aggregation joined back."""
    longest = df.groupBy(*by).agg(F.max(F.size(tokens)).alias("_m"))
    fill = F.col("_m") - F.size(tokens)
    out = df.join(longest, by)
    return out.withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), fill))).withColumn(tokens, F.concat(F.col(tokens), F.array_repeat(F.lit(pad).cast("int"), fill))).drop("_m")
