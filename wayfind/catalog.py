"""The registry of queries over the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: make a query known under ``name``, with its SQL where there is one."""

    def keep(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return keep


def queries() -> dict[str, Query]:
    """All registered queries."""
    from wayfind import catalog_queries  # noqa: F401  (registers on import)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of those that have it."""
    queries()
    return dict(_SQL)
