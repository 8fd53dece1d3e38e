"""Copies of cubes that resume: a manifest of ranges of dates with digests says what the target holds already.

The source's digest of each range is one aggregation; the target's are in its metadata. Only ranges that the target lacks or
holds with another digest are written, some at a time, and each batch is a version of the target: a copy that is cut off has the
batches it committed and goes on with the next. Ranges that the source no longer has leave the manifest. The copy may have another layout of rows: by
date (fields together) or by cell (series together), and may be obfuscated.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stratoframe.functions.timegrammar import groups
from stratoframe.operators import digests
from stratoframe.operators.cube import KEYS, Cube, on_dates
from stratoframe.operators.side import side
from stratoframe.operators.statistics import obfuscated
from stratoframe.plans import stored

#: How rows of a copy lie: what they are sorted by.
LAYOUTS = {"date": ("date", "member", "cell"), "cell": ("cell", "member", "date")}
#: Ranges that are written and committed together.
BATCH = 64


def ranges_of(cube: Cube, by: str) -> list[list[datetime]]:
    """The present dates in ranges ("monthly", "yearly", a number of dates, ...)."""
    return [g for g in groups(cube.dates, by, sorted(cube.missing)) if g]


def _numbered(spark: SparkSession, ranges: dict[int, list[datetime]]) -> DataFrame:
    rows = [(str(d), k) for k, dates in ranges.items() for d in dates]
    return side(spark.createDataFrame(rows, "at string, range int").select(F.col("at").cast("timestamp_ntz").alias("date"), "range"), len(rows))


def range_digests(cube: Cube, ranges: dict[int, list[datetime]]) -> dict[int, str]:
    """Each range's digest: one aggregation of fields where rows are read, one of fields to ranges."""
    table = _numbered(cube.df.sparkSession, ranges)
    fields = digests.field_digests(cube.rows(), cube.variables).join(table, "date")
    return {r["range"]: r["digest"] for r in digests.combined(fields, ("range",), ("date", "member", "variable")).collect()}


def copy(cube: Cube, path: str, by: str | int = "monthly", layout: str = "date", batch: int = BATCH, overwrite: bool = False, obfuscate: bool = False) -> list[str]:
    """Copies a cube to a folder; returns the first dates of the ranges that were written.

    With ``overwrite`` all are written again. A folder with other variables, frequency, cells or layout is an error.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; there are {sorted(LAYOUTS)}")
    if obfuscate:
        cube = obfuscated(cube, cube.statistics or stored.merged([stored.moments(cube.rows(), cube.variables, "date")]))
    spark, ranges = cube.df.sparkSession, dict(enumerate(ranges_of(cube, by)))
    before = stored.metadata(spark, path)
    body = stored.cube_body(cube) | {"statistics": cube.statistics if not obfuscate else None, "copy": {"by": by, "layout": layout}}
    if before:
        same = ("variables", "members", "cells", "frequency", "copy")
        if other := [k for k in same if before.get(k) != body[k]]:
            raise ValueError(f"{path} holds a copy with other {', '.join(other)}")
        body |= {"schema": before["schema"], "grid": before["grid"], "grid_schema": before["grid_schema"]}
    else:
        body |= {"schema": cube.rows().schema.jsonValue(), "grid": stored.write_grid(cube.grid, path), "grid_schema": cube.grid.schema.jsonValue() if cube.grid is not None else None}
    wanted = range_digests(cube, ranges)
    held = {(p["dates"][0], p["dates"][1], p["digest"]): p for p in before["pieces"]} if before and not overwrite else {}
    key = lambda k: (str(ranges[k][0]), str(ranges[k][-1]), wanted.get(k))
    kept = [held[key(k)] for k in ranges if key(k) in held]
    lacking = [k for k in ranges if key(k) not in held]
    version, done = before["version"] if before else 0, []
    gone = bool(before) and len(kept) < len(before["pieces"])
    for at in range(0, len(lacking), batch):
        some = {k: ranges[k] for k in lacking[at : at + batch]}
        kept += _written(cube, path, some, wanted, layout)
        done += [str(ranges[k][0]) for k in some]
        version = _committed(spark, path, body, kept, cube, version)
    if not lacking and (gone or not before):
        _committed(spark, path, body, kept, cube, version)
    return done


def _committed(spark: SparkSession, path: str, body: dict, pieces: Sequence[dict], cube: Cube, version: int) -> int:
    """A version of what is copied so far: dates that aren't yet are missing."""
    there = {d for p in pieces for d in p["present"]}
    missing = [str(d) for d in cube.dates if str(d) not in there]
    return stored.commit(spark, path, body | {"pieces": sorted(pieces, key=lambda p: p["dates"]), "missing": missing}, version)


def _written(cube: Cube, path: str, ranges: dict[int, list[datetime]], wanted: dict[int, str], layout: str) -> list[dict]:
    """Writes ranges in one job, a folder for each; their pieces."""
    spark, name = cube.df.sparkSession, f"rows/{uuid.uuid4().hex}"
    dates = [d for r in ranges.values() for d in r]
    rows = on_dates(cube.rows(), dates).join(_numbered(spark, ranges), "date").select("range", *KEYS, *cube.variables)
    order = ("range", *LAYOUTS[layout])
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("range").parquet(f"{path}/{name}")
    found = []
    schema = StructType([*cube.rows().schema.fields, StructField("range", IntegerType())])
    for k, held in stored.moments_by(spark.read.schema(schema).parquet(f"{path}/{name}"), cube.variables, "date", "range").items():
        found.append({"folder": f"{name}/range={k}", "digest": wanted[k], "dates": [str(ranges[k][0]), str(ranges[k][-1])], "present": [str(d) for d in ranges[k]], **held})
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """first, last, rows, digest of each range that a copy holds."""
    body = stored.metadata(spark, path)
    rows = [(datetime.fromisoformat(p["dates"][0]), datetime.fromisoformat(p["dates"][1]), p["rows"], p["digest"]) for p in body["pieces"]]
    return spark.createDataFrame(rows, "first timestamp_ntz, last timestamp_ntz, rows long, digest string")
