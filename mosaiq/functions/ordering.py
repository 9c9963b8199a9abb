"""Deterministic replacements for random order: a hash of an id and a seed, then the id itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(id_col: Column | str, seed: int | str) -> Column:
    """md5 of ``id:seed``; equal in every engine. Null ids have a null hash."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))
