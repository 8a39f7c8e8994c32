"""Where the query modules put their entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL twin if there is one."""

    def keep(function):
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep
