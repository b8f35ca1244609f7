"""Registering named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (read) -> DataFrame, where read(table) loads a table, under its name."""

    def register(build):
        key = name or build.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = key, build.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return build

    return register
