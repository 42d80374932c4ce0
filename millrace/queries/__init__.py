"""Registered queries: each applies an operator to the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(run: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[name] = sql
            return run

        return put


class Tables:
    """``t.orders`` is the table of that name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)
