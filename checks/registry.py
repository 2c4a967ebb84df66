"""Collects the queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import Inputs, oracle

BUILDS: dict[str, Callable[[Inputs], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a function of ``Inputs``; without SQL only its rows are checked elsewhere."""

    def register(build: Callable[[Inputs], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Inputs(spark, sf_dir))

        BUILDS[name] = build
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = oracle(sql)
        return build

    return register
