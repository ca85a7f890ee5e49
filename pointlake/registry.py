"""Where queries and the SQL that gives the same rows are put."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Register a function under its name, with its SQL."""

    def put(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, sql
        return fn

    return put
