"""The queries over the driver's tables, each with SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "n1_exact_dedup"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under name, with its SQL if there is one."""

    def put(fn: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
