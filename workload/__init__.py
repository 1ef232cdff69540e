"""The library's operators run on the test tables, each with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None = None


def rounded(expression: str, digits: int) -> str:
    """SQL of the library's rounding: ties to even."""
    return f"CAST(printf('%.{digits}f', CAST({expression} AS DOUBLE)) AS DOUBLE)"


def small_total(value: str, condition: str = "") -> str:
    """SQL of the library's total over few doubles: decimal steps plus rest."""
    only = f" FILTER ({condition})" if condition else ""
    steps = f"CAST({value} AS DECIMAL(38,6))"
    return f"(CAST(sum({steps}){only} AS DOUBLE) + sum({value} - CAST({steps} AS DOUBLE)){only})"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def all_queries() -> dict[str, Query]:
    from workload import anomalies, drivers, governance, kpis, metadata, narrative, operations, profiling, quality, reconciling

    merged: dict[str, Query] = {}
    for module in (kpis, drivers, anomalies, profiling, quality, reconciling, narrative, governance, operations, metadata):
        for name, query in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = query
    return merged
