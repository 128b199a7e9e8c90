"""How a family module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one folder; ``t("orders")`` reads one of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Family:
    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def keep(plan: Callable[[Tables], DataFrame]):
            self.QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
            if sql is not None:
                self.ORACLES[name] = sql
            return plan

        return keep
