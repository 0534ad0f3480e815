"""Queries over the driver's tables, each with the SQL it is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            assert f.__name__ not in self.queries, f.__name__
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


REGISTRY = Registry()


def load() -> Registry:
    from cubeloom.queries import aggregates, filters, joins, keyed, motion, vectors  # noqa: F401

    return REGISTRY
