"""Named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one scale-factor directory, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def widen(key: str, *columns: str) -> None:
    """Return the named integer columns of a query as bigint, as SQL row numbers are."""
    inner = QUERIES[key]
    QUERIES[key] = lambda spark, folder: inner(spark, folder).withColumns(
        {c: F.col(c).cast("bigint") for c in columns}
    )


def query(key: str, sql: str | None = None):
    """Register fn(tables) -> DataFrame under ``key``, with its SQL where there is one."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add
