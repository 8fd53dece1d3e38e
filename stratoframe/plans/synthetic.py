"""Generated gridded datasets: constants, seeded normal values and computed forcings on a grid, made on the executors."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.functions import geo, timegrammar
from stratoframe.operators.cube import KEYS, Cube, stamp
from stratoframe.operators.side import side


def points(spark: SparkSession, geography: dict | DataFrame | int) -> tuple[DataFrame, tuple[int, int] | None]:
    """cell, latitude, longitude (row, col) and the field's shape: of a table, a box {area, resolution in degrees}, or so many points spread evenly over the sphere."""
    if isinstance(geography, DataFrame):
        return geography, None
    if isinstance(geography, int):
        k = F.col("id")
        latitude = F.degrees(F.asin(1 - (2 * k + 1) / geography))
        longitude = F.pmod(k * (180 * (3 - math.sqrt(5))), F.lit(360.0))
        nothing = F.lit(None).cast("int")
        return spark.range(geography).select(k.cast("int").alias("cell"), latitude.alias("latitude"), longitude.alias("longitude"), nothing.alias("row"), nothing.alias("col")), None
    north, west, south, east = geography.get("area", (90, 0, -90, 360))
    step = geography["resolution"]
    whole = east - west >= 360  # the meridian at both ends is one
    rows, cols = int((north - south) / step + 1e-9) + 1, int((east - west) / step + 1e-9) + (0 if whole else 1)
    row, col = (F.floor(F.col("id") / cols)).cast("int"), (F.col("id") % cols).cast("int")
    table = spark.range(rows * cols).select(F.col("id").cast("int").alias("cell"), row.alias("row"), col.alias("col"))
    return table.select("cell", (north - F.col("row") * float(step)).alias("latitude"), geo.longitude(west + F.col("col") * float(step)).alias("longitude"), "row", "col"), (rows, cols)


def normal(*key: Column | str, seed: int) -> Column:
    """A standard normal value that the key and the seed decide: the same in each run, whatever the partitions."""
    even = lambda k: (F.pmod(F.xxhash64(*key, F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.log(even(0))) * F.cos(2 * math.pi * even(1))


def value(name: str, how: object, seed: int) -> Column:
    """A number, "random", {"constant": number}, {"random": {mean, stdev, seed}} or the name of a forcing."""
    kind, options = next(iter(how.items())) if isinstance(how, dict) else (how, {})
    if isinstance(kind, (int, float)) or kind == "constant":
        number = options if kind == "constant" else kind
        if not isinstance(number, (int, float)):
            raise ValueError(f"{name}: a constant is a number")
        return F.lit(float(number))
    if kind == "random":
        return normal("date", "member", "cell", F.lit(name), seed=options.get("seed", seed)) * float(options.get("stdev", 1)) + float(options.get("mean", 0))
    return geo.forcing(kind, F.col("date"), F.col("latitude"), F.col("longitude"))


def synthetic(spark: SparkSession, start: object, end: object, variables: dict[str, object] | list[str], geography: dict | DataFrame | int, frequency: object = "6h", members: int = 1, seed: int = 0) -> Cube:
    """A dataset from dates, a geography and variables (name -> value; names alone are random)."""
    how = variables if isinstance(variables, dict) else dict.fromkeys(variables, "random")
    lo, hi, step = datetime.fromisoformat(str(start)), datetime.fromisoformat(str(end)), timegrammar.frequency(frequency)
    grid, shape = points(spark, geography)
    cells, dates = grid.count(), timegrammar.spine(lo, hi, step)
    per_date = cells * members
    place = F.floor(F.col("id") / per_date)
    at = stamp(lo) + F.make_dt_interval(secs=(place * int(step.total_seconds())).cast("decimal(18,6)"))
    keys = spark.range(len(dates) * per_date).select(at.alias("date"), (F.floor(F.col("id") / cells) % members).cast("int").alias("member"), (F.col("id") % cells).cast("int").alias("cell"))
    placed = keys.join(side(grid.select("cell", "latitude", "longitude"), cells), "cell")
    df = placed.select(*KEYS, *[value(n, h, seed).alias(n) for n, h in how.items()])
    return Cube(df, tuple(how), lo, dates[-1], step, members, cells, grid, shape, tree=("synthetic",))

