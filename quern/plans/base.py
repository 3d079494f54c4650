"""How a module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Registry(dict):
    """name: (query, SQL that checks it or None)."""

    def query(self, sql: str | None = None, name: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self[name or f.__name__] = (lambda spark, folder: f(Tables(spark, folder)), sql)
            return f

        return add
