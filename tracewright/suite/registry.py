"""All registered queries with the SQL they are compared with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, longs: str = ""):
    """Register a query; ``longs`` names result columns the SQL has to widen to 64 bits."""
    if sql is not None and longs:
        casts = ", ".join(f"CAST({column} AS BIGINT) AS {column}" for column in longs.split())
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql})"

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def load() -> None:
    from tracewright.suite import chains, columns, evidences, flagship, reads, streams  # noqa: F401
