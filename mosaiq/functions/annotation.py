"""Small column functions of annotation tables: parts of ids, names of files, residues and classes, and surface features. Null gives null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of modified residues and of protonation states, and the residues that they stand for.
RESIDUE_ALIASES = {"HEM": "HIS", "HSD": "HIS", "HSE": "HIS", "HSP": "HIS", "MSE": "MET", "PTR": "TYR", "NEC": "CYS", "CSO": "CYS"}
#: The standard residues, and the name of an unknown one.
RESIDUES = ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "UNK"]
#: File endings that become the signal file's.
INTERVAL_ENDINGS = [".narrowPeak.gz", ".bed.gz", ".bed"]
CHARGE_LIMIT, LEAST_SPREAD = 3.0, 1e-8


def after_colon(column: str) -> Column:
    """The second part between colons; null where there is none."""
    return F.get(F.split(F.col(column), ":", -1), 1)


def without_first(column: str, n: int = 4) -> Column:
    """The text without its first ``n`` characters."""
    return F.substr(F.col(column), F.lit(n + 1))


def joined_id(left: str, right: str) -> Column:
    """``left_right``; null if either is."""
    return F.concat(F.col(left), F.lit("_"), F.col(right))


def folded_to(column: str, listed: list[str], other: str = "Other") -> Column:
    """The value where it is listed, else ``other``, for null too."""
    return F.when(F.col(column).isin(listed), F.col(column)).otherwise(F.lit(other))


def signal_name(column: str) -> Column:
    """The file name with its interval ending, else its last ending, replaced by ``.bw``; folders before it go where the last ending is replaced."""
    name = F.col(column)
    out = F.concat(F.regexp_replace(F.regexp_extract(name, "[^/]*$", 0), r"(?<=.)\.[^.]+$", ""), F.lit(".bw"))
    for ending in reversed(INTERVAL_ENDINGS):
        out = F.when(name.endswith(ending), F.concat(F.substr(name, F.lit(1), F.length(name) - len(ending)), F.lit(".bw"))).otherwise(out)
    return F.when(name.isNotNull(), out)


def standard_residue(column: str) -> Column:
    """A residue's standard name; null for names that are neither standard nor known aliases."""
    alias = F.create_map(*[F.lit(x) for pair in RESIDUE_ALIASES.items() for x in pair])
    return F.when(F.col(column).isin(RESIDUES), F.col(column)).otherwise(F.try_element_at(alias, F.col(column)))


def scaled_charge(column: str, limit: float = CHARGE_LIMIT) -> Column:
    """A potential cut to ``limit`` on either side and scaled to -1..1; NaN stays."""
    x = F.col(column)
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.least(x, F.lit(limit)), F.lit(-limit)) / limit)


def shape_index(mean: str, gaussian: str) -> Column:
    """The shape index in -1..1 of mean and Gaussian curvature; a negative square of the principal curvatures' half distance counts as ``LEAST_SPREAD``. Equal principal curvatures give the mean's sign, and NaN if they are 0."""
    h = F.col(mean)
    square = h * h - F.col(gaussian)
    half = F.sqrt(F.when(square < 0, LEAST_SPREAD).otherwise(square))
    level = F.when(h == 0, F.lit(float("nan"))).otherwise(F.signum(h))
    return F.when(half == 0, level).otherwise(F.atan(h / half) * (2 / 3.141592653589793))
