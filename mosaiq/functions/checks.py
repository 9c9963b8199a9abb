"""A registry of row checks as boolean columns, and reports of how many rows fail.

A check names the columns it needs; it is planned only where they all are. A null outcome (a null input) counts as failed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import sequence as S


@dataclass(frozen=True)
class Check:
    name: str
    needs: tuple[str, ...]
    test: Callable[[list[str]], Column]
    selected: bool = True  # whether the columns' presence alone selects it


CHECKS: dict[str, Check] = {}


def register(name: str, *needs: str, selected: bool = True):
    def add(test: Callable[[list[str]], Column]):
        CHECKS[name] = Check(name, needs, test, selected)
        return test

    return add


def _len(columns: list[str], types: dict[str, str] | None = None):
    return [F.coalesce(F.length(F.col(c).cast("string")), F.lit(None)) for c in columns]


def _ones(mask: str) -> Column:
    return F.length(F.translate(F.col(mask), "0", ""))


def _cds() -> Column:
    return S.masked_letters("rna_seq", "cds")


for _name, _a, _b, _selected in (("aa_dssp_length", "aa_seq", "dssp", True), ("aa_sasa_length", "aa_seq", "sasa", True), ("aa_prot_struct_length", "aa_seq", "prot_struct", False)):
    register(_name, _a, _b, selected=_selected)(lambda columns, a=_a, b=_b: F.length(a) == size_of(b, columns))


def size_of(column: str, columns: list[str] | dict[str, str]) -> Column:
    """Length of a string or size of an array, by the column's type if it is given."""
    kind = columns.get(column, "string") if isinstance(columns, dict) else "string"
    return F.size(column) if kind.startswith("array") else F.length(column)


@register("rna_seq_lengths", "rna_seq", "splice_regions", "cds")
def _(columns):
    return (F.length("rna_seq") == F.length("splice_regions")) & (F.length("splice_regions") == F.length("cds"))


@register("rna_seq_length_relations", "rna_seq", "splice_regions", "cds")
def _(columns):
    return (F.length("rna_seq") >= F.length("splice_regions")) & (F.length("splice_regions") >= F.length("cds"))


@register("phylop_length", "rna_seq")
def _(columns):
    tracks = [x for x in columns if x.startswith("phylop_")]
    out = F.lit(True)
    for t in tracks:
        out = out & (size_of(t, columns) == F.length("rna_seq"))
    return out


@register("cds_multiple_of_three", "cds")
def _(columns):
    return _ones("cds") % 3 == 0


@register("cds_aa_length", "cds", "aa_seq")
def _(columns):
    return _ones("cds") == 3 * (F.length("aa_seq") + 1)


@register("cds_has_stop_codon", "rna_seq", "cds")
def _(columns):
    return F.right(_cds(), F.lit(3)).isin(*S.STOPS)


@register("cds_has_start_codon", "rna_seq", "cds")
def _(columns):
    return F.substring(F.upper(_cds()), 1, 3).isin(*S.STARTS)


@register("cds_translation", "rna_seq", "cds", "aa_seq")
def _(columns):
    return F.rtrim(S.translated(F.upper(_cds())), F.lit("*")) == F.col("aa_seq")


@register("rna_codons_valid", "rna_codons")
def _(columns):
    return F.forall("rna_codons", lambda x: F.upper(x).rlike("^[ACGT]{3}$"))


@register("rna_codons_translation", "rna_codons", "aa_seq")
def _(columns):
    return F.rtrim(S.translated(F.upper(F.array_join("rna_codons", "")), starts=()), F.lit("*")) == F.col("aa_seq")


def planned(df: DataFrame, names: list[str] | None = None) -> list[Check]:
    """The checks whose columns are all there: the named ones, or those that presence selects."""
    chosen = [CHECKS[n] for n in names] if names is not None else [c for c in CHECKS.values() if c.selected]
    return [c for c in chosen if set(c.needs) <= set(df.columns)]


def check_rates(df: DataFrame, names: list[str] | None = None, warn_under: float = 5.0) -> DataFrame:
    """``check, n_rows, n_failed, pct_failed, level`` of all planned checks in one pass; under ``warn_under`` percent is a warning, else an error."""
    checks = planned(df, names)
    types = dict(df.dtypes)
    if not checks:
        return df.sparkSession.createDataFrame([], "check string, n_rows bigint, n_failed bigint, pct_failed double, level string")
    failed = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c.test(types), F.lit(False))).alias(c.name) for c in checks])
    rows = failed.select("n", F.explode(F.array(*[F.struct(F.lit(c.name).alias("check"), F.col(c.name).alias("n_failed")) for c in checks])).alias("x"))
    share = F.when(F.col("n") > 0, 100.0 * F.col("x.n_failed") / F.col("n")).otherwise(0.0)
    level = F.when(F.col("x.n_failed") == 0, "ok").when(share < warn_under, "warning").otherwise("error")
    return rows.select("x.check", F.col("n").alias("n_rows"), "x.n_failed", share.alias("pct_failed"), level.alias("level"))
