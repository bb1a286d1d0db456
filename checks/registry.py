"""Registry of named queries: a Spark callable and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, ints: str = "") -> Callable[[Query], Query]:
    """Register a query under its operator name together with its oracle SQL.

    `ints` names the columns that Spark counts in 32 bits and SQL in 64.
    """
    if sql is not None and ints:
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints.split())
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql}) q"

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register
