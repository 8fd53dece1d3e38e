"""Stored datasets: immutable pieces of rows, and versioned metadata that says which of them count and all that is known of them.

A folder holds ``rows/<id>`` (Parquet, sorted by time), ``grids/<id>`` and ``versions/<number>``, a table of one row with the
metadata as JSON. A save writes its rows first and its version last, so a version is there whole or not at all; what a
save that was cut off has left is referred to by no version. Opening reads the newest version (or ``path@number``) and no
row: schema, dates, missing dates, grid, statistics, types of variables and provenance are in it. Of each piece it also holds the
first and last date, the number of rows and the moments of each variable, from which statistics of the whole are merged
without reading rows again.

Two saves at one time: the version folder is made by the first; should both have written into it, the row of the least id
counts and the other save raises. Nothing is overwritten, so readers of older versions aren't disturbed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratoframe.functions.timegrammar import spine
from stratoframe.functions.variables import Variable
from stratoframe.operators import statistics
from stratoframe.operators.combine import same_grid, unified_types
from stratoframe.operators.cube import KEYS, Cube, on_dates, skip_nan
from stratoframe.operators.tabular import Observations
from stratoframe.operators.trajectories import TKEYS, Trajectories

Dataset = Cube | Observations | Trajectories
VERSION = "version int, id string, saved timestamp, body string"


class SavedMeanwhileError(RuntimeError):
    """Another save made the same version."""


# -- versions


def metadata(spark: SparkSession, path: str) -> dict | None:
    """The newest version's metadata, or that of ``path@number``; None where no dataset is stored."""
    folder, _, number = path.partition("@")
    try:
        found = spark.read.schema(VERSION).parquet(f"{folder}/versions/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if number:
        found = found.filter(F.col("version") == int(number))
    row = found.orderBy(F.desc("version"), "id").limit(1).collect()
    if not row and number:
        raise FileNotFoundError(f"{folder} has no version {number}")
    return json.loads(row[0]["body"]) | {"path": folder, "version": row[0]["version"]} if row else None


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, saved, pieces, rows: the history."""
    found = spark.read.schema(VERSION).parquet(f"{path}/versions/*")
    pieces = F.from_json(F.get_json_object("body", "$.pieces"), "array<struct<rows:bigint>>")
    rows = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["rows"])
    return found.select("version", "saved", F.size(pieces).alias("pieces"), rows.alias("rows"))


def commit(spark: SparkSession, path: str, body: dict, before: int) -> int:
    """Makes the version after ``before``."""
    name, number = uuid.uuid4().hex, before + 1
    row = spark.createDataFrame([(number, name, json.dumps({k: v for k, v in body.items() if k not in ("path", "version")}))], "version int, id string, body string")
    folder = f"{path}/versions/{number:08d}"
    try:
        row.select("version", "id", F.current_timestamp().alias("saved"), "body").coalesce(1).write.mode("error").parquet(folder)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        raise SavedMeanwhileError(f"{path} has a version {number} already") from e
    if spark.read.schema(VERSION).parquet(folder).agg(F.min("id")).first()[0] != name:
        raise SavedMeanwhileError(f"{path}: another save made version {number}")
    return number


# -- pieces


def moments_by(df: DataFrame, variables: Sequence[str], time: str, group: str | None = None) -> dict:
    """For each value of a column (without one: of None): first, last, rows and of each variable [count, mean, sum of squared deviations, minimum, maximum] (NaN left out). One aggregation."""

    def of(v: str) -> F.Column:
        x = skip_nan(F.col(v).cast("double"))
        return F.array(F.count(x).cast("double"), F.avg(x), F.var_pop(x) * F.count(x), F.min(x), F.max(x)).alias(v)

    numeric = [v for v in variables if df.schema[v].dataType.typeName() not in ("string", "boolean", "binary", "array", "struct", "map")]
    grouped = df.groupBy(F.col(group).alias("of")) if group else df.groupBy(F.lit(None).cast("int").alias("of"))
    rows = grouped.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("rows"), F.struct(F.lit(0), *[of(v) for v in numeric]).alias("all")).collect()
    return {r["of"]: {"first": str(r["first"]), "last": str(r["last"]), "rows": r["rows"], "moments": {v: list(r["all"][v]) for v in numeric}} for r in rows}


def moments(df: DataFrame, variables: Sequence[str], time: str) -> dict:
    """The same of all rows."""
    return moments_by(df, variables, time).get(None, {"first": None, "last": None, "rows": 0, "moments": {}})


def merged(pieces: Iterable[dict]) -> dict[str, dict[str, float]] | None:
    """Statistics of each variable from the pieces' moments."""
    total: dict[str, list] = {}
    for piece in pieces:
        for v, (n, mean, square, low, high) in piece["moments"].items():
            if not n:
                total.setdefault(v, [0.0, 0.0, 0.0, None, None])
                continue
            m, mu, s, lo, hi = total.get(v, (0.0, 0.0, 0.0, None, None))
            apart, both = mean - mu, m + n
            total[v] = [both, mu + apart * n / both, s + square + apart * apart * m * n / both, low if lo is None else min(lo, low), high if hi is None else max(hi, high)]
    return {v: {"mean": mu if n else None, "stdev": (s / n) ** 0.5 if n else None, "minimum": lo, "maximum": hi, "count": int(n)} for v, (n, mu, s, lo, hi) in total.items()} or None


def write_piece(rows: DataFrame, path: str, order: Sequence[str], variables: Sequence[str]) -> dict | None:
    """Writes rows, dealt by ranges of the order and sorted by it; their piece, or None without rows."""
    name = f"rows/{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/{name}")
    found = moments(rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}"), variables, order[0])
    return {"folder": name, **found} if found["rows"] else None


def write_grid(grid: DataFrame | None, path: str) -> str | None:
    if grid is None:
        return None
    name = f"grids/{uuid.uuid4().hex}"
    grid.write.parquet(f"{path}/{name}")
    return name


def read_grid(spark: SparkSession, body: dict) -> DataFrame | None:
    return spark.read.schema(StructType.fromJson(body["grid_schema"])).parquet(f"{body['path']}/{body['grid']}") if body.get("grid") else None


def read_rows(spark: SparkSession, body: dict) -> DataFrame:
    schema = StructType.fromJson(body["schema"])
    folders = [f"{body['path']}/{p['folder']}" for p in body["pieces"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


# -- datasets


def _dates(values: Iterable[datetime]) -> list[str]:
    return [str(d) for d in sorted(values)]


def _at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _tuples(tree: object) -> object:
    return tuple(_tuples(x) for x in tree) if isinstance(tree, list) else tree


def cube_body(c: Cube) -> dict:
    return {
        "layout": "gridded", "variables": list(c.variables), "types": {v: t.to_dict() for v, t in c.typed_variables.items()}, "start": str(c.start), "end": str(c.end), "frequency": c.frequency.total_seconds(),
        "members": c.members, "cells": c.cells, "field_shape": c.field_shape, "parts": c.parts, "missing": _dates(c.missing), "tree": c.tree, "origins": c.origins, "statistics": c.statistics,
    }


def opened_cube(spark: SparkSession, body: dict) -> Cube:
    path = body["path"]
    found = Cube(
        read_rows(spark, body), tuple(body["variables"]), _at(body["start"]), _at(body["end"]), timedelta(seconds=body["frequency"]), body["members"], body["cells"], read_grid(spark, body),
        tuple(body["field_shape"]) if body["field_shape"] else None, frozenset(map(_at, body["missing"])), body["statistics"] or merged(body["pieces"]), tree=("stored", _tuples(body["tree"])),
        parts=tuple(body["parts"]) if body["parts"] else None, types={v: Variable(**t) for v, t in body["types"].items()}, stored_tendencies=body.get("tendencies"),
    )
    return replace(found, origins={v: (path, v) for v in found.variables})


def _tendencies(c: Cube, deltas: Sequence[str]) -> dict[str, dict[str, dict[str, float]]]:
    found: dict[str, dict[str, dict[str, float]]] = {}
    for r in statistics.tendency_statistics(c, deltas).collect():
        found.setdefault(r["delta"], {})[r["variable"]] = {f: r[f] for f in statistics.FIELDS}
    return found


def save_cube(c: Cube, path: str, tendencies: Sequence[str] = ()) -> int:
    """Stores a cube, or adds the dates that aren't stored yet (and the variables' types); the version's number.

    ``tendencies`` are deltas whose statistics are stored too: differences over all stored dates, across the seams of saves.

    Dates between two saves that neither has are missing, and so are flagged ones until a save brings them.
    """
    spark = c.df.sparkSession
    before = metadata(spark, path)
    body, present = cube_body(c), set(c.dates) - c.missing
    if before:
        old = opened_cube(spark, before)
        if (old.variables, old.members, old.cells, old.frequency) != (c.variables, c.members, c.cells, c.frequency):
            raise ValueError("variables, members, cells and frequency must be those that are stored")
        if (c.start - old.start) % c.frequency:
            raise ValueError(f"{c.start} is off the stored dates' frequency {c.frequency}")
        same_grid([old, c])
        stored = set(old.dates) - old.missing
        present -= stored
        start, end = min(old.start, c.start), max(old.end, c.end)
        missing = set(spine(start, end, c.frequency)) - stored - present
        # statistics that were given hold for the dates they were given with
        body |= {"start": str(start), "end": str(end), "missing": _dates(missing), "grid": before["grid"], "grid_schema": before["grid_schema"], "tree": before["tree"], "statistics": before["statistics"] if not present else None}
        body["types"] = {v: t.to_dict() for v, t in unified_types([old, c]).items()}
        rows = on_dates(c.rows(), sorted(present)) if present else None
    else:
        body |= {"grid": write_grid(c.grid, path), "grid_schema": c.grid.schema.jsonValue() if c.grid is not None else None}
        rows = c.rows()
    body |= {"schema": (before["schema"] if before else c.rows().schema.jsonValue()), "pieces": list(before["pieces"]) if before else []}
    piece = write_piece(rows.select(*KEYS, *c.variables), path, ("date", "member", "cell"), c.variables) if rows is not None else None
    body["pieces"] += [piece] if piece else []
    wanted = sorted({*tendencies, *((before or {}).get("tendencies") or {})})
    if wanted and (piece or set(wanted) != set((before or {}).get("tendencies") or {})):
        body["tendencies"] = _tendencies(opened_cube(spark, body | {"path": path}), wanted)
    elif before:
        body["tendencies"] = before.get("tendencies")
    return commit(spark, path, body, before["version"] if before else 0)


def save_trajectories(t: Trajectories, path: str) -> int:
    """Stores trajectories, or adds the base dates that aren't stored yet."""
    spark = t.df.sparkSession
    before = metadata(spark, path)
    rows, start, end, present = t.rows(), t.base_start, t.base_end, set(t.base_dates) - t.missing
    stored: set[datetime] = set()
    if before:
        old = opened_trajectories(spark, before)
        if (old.variables, old.members, old.cells, old.steps, old.base_frequency) != (t.variables, t.members, t.cells, t.steps, t.base_frequency):
            raise ValueError("variables, members, cells, steps and base frequency must be those that are stored")
        if (t.base_start - old.base_start) % t.base_frequency:
            raise ValueError(f"{t.base_start} is off the stored base dates' frequency")
        stored = set(old.base_dates) - old.missing
        start, end, present = min(start, old.base_start), max(end, old.base_end), present - stored
        rows = on_dates(rows, sorted(present), "base_date") if present else None
    missing = set(spine(start, end, t.base_frequency)) - stored - present
    piece = write_piece(rows.select(*TKEYS, *t.variables), path, TKEYS, t.variables) if rows is not None else None
    body = {
        "layout": "trajectories", "variables": list(t.variables), "start": str(start), "end": str(end), "frequency": t.base_frequency.total_seconds(), "steps": [s.total_seconds() for s in t.steps], "members": t.members, "cells": t.cells,
        "missing": _dates(missing), "grid": before["grid"] if before else write_grid(t.grid, path), "grid_schema": before["grid_schema"] if before else t.grid.schema.jsonValue() if t.grid is not None else None,
        "schema": before["schema"] if before else t.rows().schema.jsonValue(), "pieces": (list(before["pieces"]) if before else []) + ([piece] if piece else []),
    }
    return commit(spark, path, body, before["version"] if before else 0)


def opened_trajectories(spark: SparkSession, body: dict) -> Trajectories:
    return Trajectories(
        read_rows(spark, body), tuple(body["variables"]), _at(body["start"]), _at(body["end"]), timedelta(seconds=body["frequency"]), tuple(timedelta(seconds=s) for s in body["steps"]),
        body["members"], body["cells"], read_grid(spark, body), frozenset(map(_at, body["missing"])),
    )


def opened(spark: SparkSession, path: str) -> Dataset | None:
    """The dataset that is stored in a folder (or its version ``path@number``), None where it holds none."""
    body = metadata(spark, path)
    if body is None:
        return None
    if body["layout"] == "tabular":
        from stratoframe.plans.fragments import opened_observations

        return opened_observations(spark, body)
    return {"gridded": opened_cube, "trajectories": opened_trajectories}[body["layout"]](spark, body)


def save(dataset: Dataset, path: str, tendencies: Sequence[str] = ()) -> int:
    """Stores a dataset or adds to it what isn't stored yet; the version's number. A folder holds one layout."""
    spark = dataset.df.sparkSession
    layout = {Cube: "gridded", Trajectories: "trajectories", Observations: "tabular"}[type(dataset)]
    before = metadata(spark, path)
    if before and before["layout"] != layout:
        raise ValueError(f"{path} holds a {before['layout']} dataset")
    if isinstance(dataset, Observations):
        from stratoframe.plans.fragments import Fragments

        w = dataset.window
        return Fragments(spark, path).append(dataset.df, {"frequency": dataset.frequency.total_seconds(), "window": [w.start, w.end, w.start_closed, w.end_closed]})
    return save_cube(dataset, path, tendencies) if isinstance(dataset, Cube) else save_trajectories(dataset, path)

