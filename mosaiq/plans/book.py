"""A book of queries: name, function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None):
        def put(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if oracle is not None:
                self.oracles[f.__name__] = oracle
            return f

        return put
