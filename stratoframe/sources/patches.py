"""Repairs of self-describing tables before they are used: names, coordinates, order, and time from analysis and lead."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratoframe.operators.cube import Cube
from stratoframe.operators.series import rolling_operation


def valid_time(df: DataFrame, analysis: str, lead: str, unit: str = "hours", name: str = "date") -> DataFrame:
    """Analysis time and lead become the valid time; both are dropped."""
    seconds = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[unit]
    at = F.col(analysis) + F.make_dt_interval(secs=(F.col(lead).cast("long") * seconds).cast("decimal(18,6)"))
    return df.withColumn("_valid", at).drop(analysis, lead).withColumnRenamed("_valid", name)


def sort_coordinates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.orderBy(*columns)


def subset(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Rows whose coordinates have given values (or one of a list)."""
    for column, value in values.items():
        df = df.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def rolling(cube: Cube, steps: int, operation: str, variables: Sequence[str]) -> Cube:
    return rolling_operation(cube, steps, operation, variables)


#: Patches apply in this order, whatever the order they are given in.
ORDER: dict[str, Callable] = {
    "rename": rename,
    "subset": subset,
    "analysis_lead_to_valid_time": lambda df, options: valid_time(df, **options),
    "sort_coordinates": sort_coordinates,
}


def patched(df: DataFrame, patches: dict[str, object]) -> DataFrame:
    if unknown := set(patches) - set(ORDER):
        raise ValueError(f"unknown patches: {sorted(unknown)}")
    for name, apply in ORDER.items():
        if name in patches:
            df = apply(df, patches[name])
    return df
