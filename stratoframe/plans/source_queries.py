"""Queries of sources, requests, recipes in parts, streams and metadata over the fixtures, each beside its SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.functions import geo
from stratoframe.operators import combine
from stratoframe.operators.side import shared_folder
from stratoframe.operators.tabular import Observations
from stratoframe.plans import fixtures, inspect, recipe
from stratoframe.plans.dataset import add_named_dataset, list_dataset_names, open_dataset, save_dataset
from stratoframe.sources import patches
from stratoframe.sources.registry import SOURCES
from stratoframe.streaming import windows

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
RANGE = [datetime(2024, 1, 5), datetime(2024, 1, 20)]
_RANGE = "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"
KV = "date, member, cell, q, p, d, x"


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = (f, sql)
        return f

    return register


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("source_csv", f"SELECT ts, latitude, longitude, value FROM obs WHERE {_RANGE}")
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from CSV files whose columns have other names, in a range of dates."""
    path = folder(spark, "csv")
    obs = fixtures.observations(spark, sf_dir)
    parts = obs.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm:ss").alias("time"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "value", "k")
    parts.write.csv(path, header=True)
    schema = "day string, time string, lat double, lon double, value double, k double"
    return SOURCES["csv"](spark, RANGE, path, schema, columns=["value"], flavour={"latitude": "lat", "longitude": "lon", "date": ["day", "time"]})


@query("source_of_any_format", f"SELECT {KV} FROM cube WHERE date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def source_of_any_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "orc")
    fixtures.cube(spark, sf_dir).rows().write.orc(path)
    return SOURCES["source"](spark, [datetime(1996, 1, 1), datetime(1997, 12, 31)], "orc", path)


@query("source_by_pattern", f"SELECT {KV} FROM cube WHERE year(date) IN (1996, 1998) AND member = 1")
def source_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by year and member, named by a pattern of the dates and of another key."""
    path, cube = folder(spark, "pattern"), fixtures.cube(spark, sf_dir)
    cube.rows().withColumns({"y": F.year("date"), "m": F.col("member")}).write.partitionBy("y", "m").parquet(path)
    wanted = [d for d in cube.dates if d.year in (1996, 1998)]
    return SOURCES["parquet"](spark, wanted, f"{path}/y={{date:%Y}}/m={{number}}", number=[1]).select(KV.split(", "))


@query("source_odb", f"SELECT ts, round(value * 2, 6) AS doubled, k FROM obs WHERE {_RANGE} AND latitude > 0 AND k < 50")
def source_odb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions and a condition over a view."""
    fixtures.observations(spark, sf_dir).createOrReplaceTempView("observed")
    return SOURCES["odb"](spark, RANGE, "observed", ["ts", "round(value * 2, 6) as doubled", "k"], "latitude > 0 and k < 50")


@query("source_cropped", f"SELECT ts, latitude, longitude, value, k FROM obs WHERE {_RANGE} AND latitude BETWEEN -20 AND 50 AND (longitude >= 350 OR longitude <= 40)")
def source_cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source and a filter as a recipe's pipe, over the meridian."""
    fixtures.observations(spark, sf_dir).createOrReplaceTempView("observed")
    return recipe.build(spark, {"pipe": [{"odb": {"table": "observed"}}, {"crop": {"north": 50, "west": -10, "south": -20, "east": 40}}]}, RANGE)


@query(
    "requests_of_an_archive",
    "SELECT 'od' AS class, CASE WHEN hour(base) IN (6, 18) THEN 'scda' ELSE 'oper' END AS stream, strftime(base, '%H%M') AS \"time\", CAST(s AS VARCHAR) AS step, string_agg(DISTINCT strftime(base, '%Y-%m-%d'), '/' ORDER BY strftime(base, '%Y-%m-%d')) AS \"date\" "
    "FROM (SELECT DISTINCT date - to_hours(s) AS base, s FROM cube, (VALUES (0), (6), (12)) v(s)) GROUP BY ALL",
)
def requests_of_an_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = [r[0] for r in fixtures.cube(spark, sf_dir).rows().select("date").distinct().collect()]
    return SOURCES["mars"](spark, dates, "0/to/12/by/6", **{"class": "od", "stream": "oper"})


@query(
    "requests_of_fields",
    "SELECT 'od' AS class, strftime(base, '%Y%m%d') AS \"date\", '0000' AS \"time\", CAST(24 * CAST(date > base AS INTEGER) AS VARCHAR) AS step FROM (SELECT DISTINCT date, date - INTERVAL 1 DAY AS base FROM cube)",
)
def requests_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each date's field from the run of the day before."""
    dates = [r[0] for r in fixtures.cube(spark, sf_dir).rows().select("date").distinct().collect()]
    return SOURCES["fdb"](spark, dates, {"class": "od"}, offset_from_date=True, step_zero_from_previous_date=True)


@query(
    "requests_of_hindcasts",
    "SELECT 'od' AS class, strftime(make_timestamp(year(date) - y, month(date), day(date), 0, 0, 0), '%Y%m%d') AS hdate, strftime(date, '%Y%m%d') AS \"date\", '0000' AS \"time\", '24' AS step FROM (SELECT DISTINCT date FROM cube WHERE year(date) = 1999), (VALUES (1), (2), (3)) v(y)",
)
def requests_of_hindcasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = sorted(r[0] for r in fixtures.cube(spark, sf_dir).rows().filter("year(date) = 1999").select("date").distinct().collect())
    valid = [r.replace(year=r.year - y) + timedelta(days=1) for r in reference for y in (1, 2, 3)]
    return SOURCES["hindcasts"](spark, valid, reference, 3, [24], **{"class": "od"})


@query(
    "recipe_parts",
    f"SELECT {KV}, CAST(dense_rank() OVER (ORDER BY year(date)) - 1 AS INTEGER) AS \"group\" FROM c WHERE i NOT BETWEEN 20 AND 23 AND i <> 50",
)
def recipe_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe with missing dates and ranges, loaded in three parts, one of them twice."""
    cube, path = fixtures.cube(spark, sf_dir), folder(spark, "parts")
    SOURCES["monthly_cube"] = lambda spark, dates: recipe.asked(cube.rows(), dates)
    dates = cube.dates
    missing = [{"start": dates[20], "end": dates[23]}, dates[50]]
    spec = {"dates": {"start": dates[0], "end": dates[-1], "frequency": "30d", "missing": missing}, "group_by": "yearly", "input": {"monthly_cube": {}}}
    for which in ("2/3", "1/3", "2/3", "3/3"):
        recipe.load(spark, spec, path, which)
    return spark.read.parquet(f"{path}/data").select(*KV.split(", "), "group")


@query("calendar_dates", f"SELECT {KV} FROM cube WHERE month(date) IN (1, 7, 12) AND date >= '1996-01-01' AND day(date) > 9")
def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of some months and days of the month."""
    cube = fixtures.cube(spark, sf_dir).between(1996, None)
    dates, _ = recipe.dates_of({"start": cube.start, "end": cube.end, "frequency": "30d", "months": [1, "July", 12], "day_of_month": list(range(10, 32))})
    return recipe.asked(cube.rows(), dates)


@query("automatic_combination", f"SELECT {KV} FROM cube")
def automatic_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of datasets: those of the same dates are joined, those of other dates follow each other."""
    c = fixtures.cube(spark, sf_dir)
    return open_dataset(spark, [open_dataset(spark, [c.between(None, 1997).select(["q", "p"]), c.between(1998, None).select(["q", "p"])]), c.select(["d", "x"])]).rows()


@query("named_datasets", "SELECT date, member, cell, q, d FROM cube WHERE date >= '1997-01-01'")
def named_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored dataset and one under a name, joined by their names."""
    c, path = fixtures.cube(spark, sf_dir), folder(spark, "named")
    save_dataset(c.select(["q"]), path)
    add_named_dataset("other_half", c.select(["d", "x"]))
    spec = {"join": [path, {"dataset": "other_half", "select": "d"}], "start": 1997}
    if list_dataset_names(**spec) != [path]:
        raise ValueError("the specification opens other paths")
    return open_dataset(spark, **spec).rows()


@query("stream_without_repeats", "SELECT ts, latitude, longitude, value, k FROM (SELECT DISTINCT ts, latitude, longitude, value, k FROM obs)")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files that repeats all its rows, without repeats, appended batch by batch."""
    path = folder(spark, "stream")
    obs = fixtures.observations(spark, sf_dir)
    obs.unionByName(obs).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    rows = windows.without_repeats(stream, "60 days").drop("event_time")
    writer = rows.writeStream.foreachBatch(windows.append_once(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


_HAVERSINE = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(latitude - 48.85) / 2), 2) + cos(radians(latitude)) * cos(radians(48.85)) * pow(sin(radians(longitude - 2.35) / 2), 2), 1)))"


@query("great_circles", f"SELECT ts, latitude, longitude, round({_HAVERSINE.replace('6371.0', str(geo.EARTH_KM))}, 3) AS km FROM obs WHERE latitude > 30")
def great_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of observations from a place."""
    obs = fixtures.observations(spark, sf_dir).filter("latitude > 30")
    return obs.select("ts", "latitude", "longitude", F.round(geo.haversine_km(F.lit(48.85), F.lit(2.35), F.col("latitude"), F.col("longitude")), 3).alias("km"))


@query(
    "window_whole_range",
    "SELECT n AS samples, first - INTERVAL 6 HOUR AS first, first + to_hours(6 * (n - 1)) + INTERVAL 3 HOUR AS last FROM (SELECT min(ts) AS first, CAST((epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT) // 21600 + 1 AS BIGINT) AS n FROM obs)",
)
def window_whole_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Observations.of(fixtures.observations(spark, sf_dir), window="(-6h,+3h]", frequency="6h")
    return spark.createDataFrame([(len(o), *o.whole_range())], "samples long, first timestamp_ntz, last timestamp_ntz")


@query("grids_of_parts", "SELECT grid, count(*) AS cells FROM (SELECT CASE WHEN latitude >= 55 THEN 0 ELSE 1 END AS grid FROM grid) GROUP BY grid")
def grids_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each of the grids that a dataset is made of."""
    c = fixtures.cube(spark, sf_dir)
    found = combine.grids([c.area(90, 0, 55, 360), c.area(54, 0, -90, 360)])
    return spark.createDataFrame(list(enumerate(found.grids)), "grid int, cells long")


@query("positions_of_labels", "SELECT i AS date_idx, v AS variable_idx, member FROM (SELECT DISTINCT i, member FROM c WHERE i % 7 = 0), (VALUES (0), (3)) t(v)")
def positions_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions found from dates, names and members of the rows."""
    c = fixtures.cube(spark, sf_dir)
    labels = c.rows().select("date", "member").distinct().collect()
    rows = [c.to_index(r["date"], v, r["member"]) for r in labels for v in ("q", "x")]
    return spark.createDataFrame(rows, "date_idx int, variable_idx int, member int").filter("date_idx % 7 = 0")


@query("provenance_of_variables", "SELECT 'q' AS variable, 'amount' AS name, 1 AS stored UNION ALL SELECT 'd2', 'd', 1 WHERE (SELECT count(*) FROM cube) > 0")
def provenance_of_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the variables of a joined and renamed dataset come from."""
    c, path = fixtures.cube(spark, sf_dir), folder(spark, "origins")
    save_dataset(c.select(["q", "d"]).rename({"q": "amount"}), path)
    found = open_dataset(spark, path, rename={"amount": "q", "d": "d2"})
    return spark.createDataFrame([(v, found.origin(v)[1], int(found.origin(v)[0] == path)) for v in found.variables], "variable string, name string, stored int")


@query("patched_coordinates", "SELECT date, member, cell AS number, q FROM cube WHERE member = 0 AND cell IN (2, 7)")
def patched_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, a subset of coordinates, and their order, as patches of a table."""
    rows = fixtures.cube(spark, sf_dir).select(["q"]).rows()
    return patches.patched(rows, {"sort_coordinates": ["date", "number"], "rename": {"cell": "number"}, "subset": {"number": [2, 7], "member": 0}})


@query(
    "supporting_arrays",
    "SELECT name, CAST(place AS INTEGER) AS place, value FROM (SELECT row_number() OVER (ORDER BY latitude < 55, cell) - 1 AS place, latitude AS latitudes, longitude AS longitudes, CAST(latitude < 55 AS INTEGER)::DOUBLE AS grid FROM grid) UNPIVOT (value FOR name IN (latitudes, longitudes, grid))",
)
def supporting_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrays of a dataset made of two areas."""
    c = fixtures.cube(spark, sf_dir)
    return inspect.supporting_arrays(combine.grids([c.area(90, 0, 55, 360), c.area(54, 0, -90, 360)])).select("name", F.col("place").cast("int").alias("place"), "value")


@query(
    "metadata_of_variables",
    "SELECT 'q' AS variable, 'kg' AS units, 'cube' AS source, n AS dates, 3 AS missing FROM n UNION ALL SELECT 'p', 'degC', 'cube', n, 3 FROM n",
)
def metadata_of_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the metadata of a stored and rescaled dataset say, through JSON."""
    c, path = fixtures.cube(spark, sf_dir).select(["q", "p"]).typed({"q": {"units": "kg"}, "p": {"units": "K"}}), f"{folder(spark, 'described')}/cube"
    save_dataset(c.set_missing(list(fixtures.MISSING)), path)
    known = json.loads(json.dumps(inspect.metadata(open_dataset(spark, path, rescale={"p": "degC"}))))
    rows = [(v, t["units"], known["sources"][v][0].rsplit("/", 1)[1], known["shape"][0], len(known["missing"])) for v, t in known["variables_metadata"].items()]
    return spark.createDataFrame(rows, "variable string, units string, source string, dates int, missing int")
