"""The registry of queries: name to query function and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _queries:
            raise ValueError(f"{key} is registered already")
        _queries[key] = f
        if sql:
            _sql[key] = sql
        return f

    return add


def registered(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _sql[name]


def queries() -> dict[str, Query]:
    from . import plans  # noqa: F401  registers its queries on import

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
