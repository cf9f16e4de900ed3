"""Named queries: a Spark plan over a folder of tables, and the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The parquet tables of a folder, opened when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)  # a second use neither lists files nor reads footers again
        return table


@dataclass(frozen=True)
class Query:
    name: str
    survey: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(survey: str, sql: str | None = None, name: str | None = None):
    """Register a plan under its name, with its survey ids and its SQL."""

    def register(plan: Callable[[Tables], DataFrame]):
        key = name or plan.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(key, survey, plan, sql)
        return plan

    return register
