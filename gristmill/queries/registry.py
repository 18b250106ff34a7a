"""Registered queries: a Spark plan over the given tables and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one directory, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Register a plan under its function name."""
    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        REGISTRY[plan.__name__] = Query(plan, sql)
        return plan

    return register
