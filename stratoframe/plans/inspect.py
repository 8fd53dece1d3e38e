"""Looking at datasets: a table that describes one, and the rules that every dataset keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratoframe.functions.timegrammar import frequency_text
from stratoframe.operators import statistics
from stratoframe.operators.cube import KEYS, Cube


def describe(cube: Cube) -> DataFrame:
    """One row for each variable: its statistics and whether it is constant in time."""
    return statistics.summary(cube.rows(), cube.variables).join(statistics.constant_variables(cube), "variable")


def header(cube: Cube) -> dict[str, object]:
    """What is known without reading a row."""
    return {
        "shape": cube.shape, "start": str(cube.start), "end": str(cube.end), "frequency": frequency_text(cube.frequency), "variables": list(cube.variables),
        "missing": [str(d) for d in sorted(cube.missing)], "field_shape": cube.field_shape, "tree": cube.tree,
    }


def metadata(cube: Cube) -> dict[str, object]:
    """All that is known of a dataset without reading a row, as plain values (JSON can hold it)."""
    return header(cube) | {
        "tree": tree(cube).split("\n"), "members": cube.members, "cells": cube.cells, "grids": list(cube.grids), "field_shape": list(cube.field_shape) if cube.field_shape else None, "shape": list(cube.shape),
        "variables_metadata": {v: {k: x for k, x in t.to_dict().items() if x is not None and k != "name"} for v, t in cube.typed_variables.items()}, "constant_fields": [v for v, t in cube.typed_variables.items() if t.constant],
        "sources": {v: list(cube.origin(v)) for v in cube.variables}, "statistics": cube.statistics,
    }


def supporting_arrays(cube: Cube) -> DataFrame:
    """name, place, value: the arrays that belong to the grid (latitudes, longitudes, and of several grids which each cell is of, as ``grid``), a row for each element."""
    parts, before = F.lit(0), 0
    for n in cube.grids[:-1]:
        before += n
        parts = parts + F.when(F.col("cell") >= before, 1).otherwise(0)
    names = {"latitudes": F.col("latitude"), "longitudes": F.col("longitude")} | ({"grid": parts} if len(cube.grids) > 1 else {})
    wide = cube.grid.select(F.col("cell").alias("place"), *[c.cast("double").alias(n) for n, c in names.items()])
    return wide.unpivot(["place"], list(names), "name", "value")


def tree(cube: Cube) -> str:
    """The operators that made the dataset, outermost first."""

    def lines(node: tuple, depth: int) -> list[str]:
        return [f"{'  ' * depth}{node[0]}"] + [x for child in node[1:] for x in lines(child, depth + 1)]

    return "\n".join(lines(cube.tree, 0))


def problems(cube: Cube) -> DataFrame:
    """rule, n: how many rows break each rule of a cube; empty for a sound one."""
    on_spine = F.pmod(F.unix_seconds(F.col("date").cast("timestamp")) - F.lit(int((cube.start - cube.start.__class__(1970, 1, 1)).total_seconds())), F.lit(int(cube.frequency.total_seconds()))) == 0
    rules = {
        "date between start and end": F.col("date").between(F.lit(str(cube.start)).cast("timestamp_ntz"), F.lit(str(cube.end)).cast("timestamp_ntz")),
        "date on the frequency": on_spine,
        "member in range": F.col("member").between(0, cube.members - 1),
        "cell in range": F.col("cell").between(0, cube.cells - 1),
    }
    counts = cube.df.agg(*[F.count(F.when(~rule, 1)).alias(name) for name, rule in rules.items()])
    broken = counts.unpivot([], list(rules), "rule", "n")
    repeated = cube.df.groupBy(*KEYS).agg(F.count("*").alias("k")).filter("k > 1").agg(F.count("*").alias("n")).select(F.lit("one row for each key").alias("rule"), "n")
    return broken.unionByName(repeated).filter("n > 0")
