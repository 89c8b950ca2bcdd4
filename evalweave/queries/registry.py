"""Registered queries: a callable on (spark, folder) and, where SQL can say the
same, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one scale folder, read on access."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def uniform(df: DataFrame) -> DataFrame:
    """Comparable output: integers as bigint, doubles rounded to six places."""
    def one(name: str, kind: str):
        if kind in ("int", "smallint", "tinyint"):
            return F.col(name).cast("bigint").alias(name)
        if kind == "double":
            return F.round(name, 6).alias(name)
        return F.col(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: uniform(fn(Tables(spark, folder)))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register
