"""The queries that the package offers: each is a function of (spark, sf_dir), with SQL for an independent engine where there is some."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Register the function below as query `name`."""

    def keep(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Modules that register queries.
MODULES = ("operators.catalog", "operators.histograms", "operators.matching", "operators.statistics", "operators.stencils", "operators.tiles", "functions.queries", "functions.tone", "streaming.queries")
