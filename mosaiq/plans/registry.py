"""Every registered query of the engine with the SQL that it is checked against."""

from __future__ import annotations

from mosaiq.plans import index_queries, sequence_queries, set_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (index_queries, set_queries, sequence_queries):
    QUERIES.update(_module.BOOK.queries)
    ORACLES.update(_module.BOOK.oracles)
