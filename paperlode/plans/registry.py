"""The registry that pairs a DataFrame query with its reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paperlode.sources.tables import SCHEMAS, load_table


class Tables:
    """The tables below one folder, loaded on first use as attributes."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return load_table(self.spark, self.base, name)


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, base: str) -> DataFrame:
        return self.build(Tables(spark, base))


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Register the decorated function under its name; `sql` is None where SQL cannot express it."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if build.__name__ in QUERIES:
            raise ValueError(f"query {build.__name__} is registered twice")
        QUERIES[build.__name__] = Query(build, sql)
        return build

    return add
