"""Queries of this folder with the SQL that checks them; the library itself knows nothing of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(read) -> DataFrame`` where ``read(table)`` gives a whole table."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
