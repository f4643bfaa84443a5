"""A family of queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable


class Plans:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None) -> Callable:
        """Register a query (spark, sf_dir) under its own name; sql None: it has no SQL equivalent."""

        def put(query: Callable) -> Callable:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = sql
            return query

        return put
