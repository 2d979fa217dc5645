"""Registered queries and their SQL: each plan module registers its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL if SQL can express it."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    from sievetrace.plans import cleaning, datasets, parts, ranking, reports, scans, verification  # noqa: F401


def queries() -> dict[str, Query]:
    """Name to query."""
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    _load()
    return dict(_sql)
