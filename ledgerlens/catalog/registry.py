"""Named queries over the standard tables, each with the SQL that states the expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            EXPECTED_SQL[name] = sql
        return fn

    return wrap
