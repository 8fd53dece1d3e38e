"""The catalogue of queries: each name is a plan over the driver's tables and the SQL that it must agree with (none where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratoframe.operators import statistics
from stratoframe.plans import fixtures, gridded_queries, source_queries, store_queries, tabular_queries, trajectory_queries

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per variable of a range of dates."""
    return statistics.statistics(fixtures.cube(spark, sf_dir).between(1996, 1998).select(["q", "p"]))


def _all() -> dict[str, tuple[Query, str | None]]:
    return gridded_queries.QUERIES | tabular_queries.QUERIES | trajectory_queries.QUERIES | store_queries.QUERIES | source_queries.QUERIES


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: fixtures.SQL + sql for name, (_, sql) in _all().items() if sql}
