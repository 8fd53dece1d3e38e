"""Named sources and filters for recipes: functions from dates and options to DataFrames, and from DataFrames to DataFrames."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.functions import geo
from stratoframe.functions.timegrammar import expand, hindcast_requests
from stratoframe.operators import derived, tabular
from stratoframe.operators.cube import on_dates
from stratoframe.operators.side import side

Source = Callable[..., DataFrame]
SOURCES: dict[str, Source] = {}
FILTERS: dict[str, Source] = {}


def source(name: str) -> Callable[[Source], Source]:
    return lambda f: SOURCES.setdefault(name, f)


def filter_(name: str) -> Callable[[Source], Source]:
    return lambda f: FILTERS.setdefault(name, f)


def _dated(df: DataFrame, dates: Sequence[datetime], column: str) -> DataFrame:
    """Rows from the first to the last date: a range, so that it reaches the scan."""
    lo, hi = (F.lit(str(d)).cast("timestamp_ntz") for d in (min(dates), max(dates)))
    return df.filter(F.col(column).between(lo, hi))


def paths_of(pattern: str, dates: Sequence[datetime], **keys: object) -> list[str]:
    """A path pattern with {date} or {date:strftime("%Y%m")} filled in for each date and {key} for each value of other keys, without repeats. Wildcards (*, ?, [a-z], {a,b}) are left to Spark's readers, which list them."""
    named = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in keys.items()}
    used = [k for k in named if f"{{{k}}}" in pattern]
    if idle := sorted(set(named) - set(used)):
        raise ValueError(f"{pattern} has no {idle}")
    patterns = [pattern]
    for k in used:
        patterns = [p.replace(f"{{{k}}}", str(v)) for p in patterns for v in named[k]]

    def fill(at: datetime, text: str) -> str:
        return re.sub(r"\{date(?::strftime\(\"?([^\")]*)\"?\)|:([^}]*))?\}", lambda m: at.strftime(m[1] or m[2] or "%Y-%m-%d"), text)

    return list(dict.fromkeys(fill(at, text) for text in patterns for at in dates))


@source("parquet")
def parquet(spark: SparkSession, dates: Sequence[datetime], path: str, column: str = "date", **keys: object) -> DataFrame:
    """Files of a path pattern for the dates and other keys of the pattern."""
    return _dated(spark.read.parquet(*paths_of(path, dates, **keys)), dates, column)


@source("csv")
def csv(spark: SparkSession, dates: Sequence[datetime], path: str, schema: str, columns: Sequence[str] | None = None, flavour: dict | None = None) -> DataFrame:
    """CSV with a header; flavour names the latitude, longitude and date (one column, or date and time) columns."""
    flavour = {"latitude": "latitude", "longitude": "longitude", "date": "date"} | (flavour or {})
    df = spark.read.schema(schema).csv(paths_of(path, dates), header=True)
    when = flavour["date"] if isinstance(flavour["date"], (list, tuple)) else [flavour["date"]]
    at = F.concat_ws(" ", *[F.col(c).cast("string") for c in when]).cast("timestamp_ntz")
    names = list(columns or [c for c in df.columns if c not in (*when, flavour["latitude"], flavour["longitude"])])
    rows = df.select(at.alias("ts"), F.col(flavour["latitude"]).cast("double").alias("latitude"), F.col(flavour["longitude"]).cast("double").alias("longitude"), *names)
    return _dated(rows, dates, "ts")


@source("source")
def generic(spark: SparkSession, dates: Sequence[datetime], format: str, path: str, column: str = "date", **options: str) -> DataFrame:
    """Any format that Spark reads."""
    return _dated(spark.read.format(format).options(**options).load(paths_of(path, dates)), dates, column)


@source("odb")
def odb(spark: SparkSession, dates: Sequence[datetime], table: str, select: Sequence[str] = ("*",), where: str | None = None, column: str = "ts") -> DataFrame:
    """Expressions and a condition over a table or view, in the range of the dates."""
    rows = _dated(spark.table(table), dates, column)
    return (rows.where(where) if where else rows).selectExpr(*select)


@source("empty")
def empty(spark: SparkSession, dates: Sequence[datetime], schema: str = "date timestamp_ntz, member int, cell int") -> DataFrame:
    return spark.createDataFrame([], schema)


@source("forcings")
def forcings(spark: SparkSession, dates: Sequence[datetime], template: DataFrame, param: Sequence[str]) -> DataFrame:
    """Computed fields on the template's grid (cell, latitude, longitude) for each date: the two small tables meet on a constant."""
    table = spark.createDataFrame([(str(d),) for d in dates], "d string").select(F.col("d").cast("timestamp_ntz").alias("date"), F.lit(0).alias("member"))
    pairs = template.select("cell", "latitude", "longitude", F.lit(0).alias("member")).join(side(table, len(dates)), "member")
    return pairs.select("date", "member", "cell", *[geo.forcing(p, F.col("date"), F.col("latitude"), F.col("longitude")).alias(p) for p in param])


SOURCES["constants"] = forcings


@source("grib-index")
def message_index(spark: SparkSession, dates: Sequence[datetime], indexdb: str | DataFrame, column: str = "valid_datetime", **keys: object) -> DataFrame:
    """Messages (path, offset, length and their keys) that an index holds at the dates, by any of its keys: a value or a list, compared as text. Keys that it lacks are left out with a warning."""
    if isinstance(indexdb, str):
        indexdb = spark.table(indexdb) if "/" not in indexdb and spark.catalog.tableExists(indexdb) else spark.read.parquet(indexdb)
    for key, wanted in keys.items():
        if key not in indexdb.columns:
            warnings.warn(f"the index has no key {key!r}", stacklevel=2)
            continue
        indexdb = indexdb.filter(F.col(key).cast("string").isin([str(w) for w in (wanted if isinstance(wanted, (list, tuple)) else [wanted])]))
    return on_dates(indexdb, dates, column)


#: Columns of an index that say where a message is; the others are its keys.
PLACE = ("path", "offset", "length")


def key_digest(index: DataFrame) -> Column:
    """A digest of a message's keys that are set, in the order of their names: a key that it lacks counts the same as no such column."""
    keys = sorted(c for c in index.columns if c not in PLACE)
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in keys])), 256)


class RepeatedKeysError(ValueError):
    """Two messages with the same keys."""


def add_messages(index: DataFrame, messages: DataFrame, unique: bool = False) -> DataFrame:
    """An index with the messages that it doesn't have yet, by path and offset; keys that a message lacks are null, keys that the index lacks become columns.

    With ``unique`` no two messages may have the same keys, wherever they are: RepeatedKeysError names some places.
    """
    place = ["path", "offset"]
    whole = index.unionByName(messages.dropDuplicates(place).join(index.select(*place), place, "left_anti"), allowMissingColumns=True)
    if unique:
        repeated = whole.groupBy(key_digest(whole).alias("keys")).agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("a"), F.max(F.struct(*place)).alias("b")).filter("n > 1")
        if found := repeated.orderBy("a").limit(3).collect():
            raise RepeatedKeysError("; ".join(f"{r['a']['path']} at {r['a']['offset']} and {r['b']['path']} at {r['b']['offset']}" for r in found))
    return whole


def _requests(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """One row for each request, its values as text, lists joined by slashes: few, and nothing is fetched."""
    text = lambda x: "/".join(map(str, x)) if isinstance(x, (list, tuple)) else str(x)
    found = [{k: text(v) for k, v in r.items()} for r in rows]
    names = list(dict.fromkeys(k for r in found for k in r)) or ["date"]
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in found], ", ".join(f"`{k}` string" for k in names))


@source("mars")
def mars(spark: SparkSession, dates: Sequence[datetime], step: str | Sequence[int] = (0,), **fixed: object) -> DataFrame:
    """The archive requests for the dates."""
    return _requests(spark, derived.requests(dates, expand(step), **fixed))


@source("fdb")
def fdb(spark: SparkSession, dates: Sequence[datetime], fdb_request: dict, offset_from_date: bool = False, step_zero_from_previous_date: bool = False) -> DataFrame:
    """A field request for each date: of a run at that time (step 0 unless the request has one) or, with ``offset_from_date``, of the run at the day's start (at 00 optionally the one before, after 24 hours)."""

    def base_of(at: datetime) -> datetime:
        day = datetime(at.year, at.month, at.day)
        return day - timedelta(days=1) if at == day and step_zero_from_previous_date else day

    def one(at: datetime) -> dict:
        base = base_of(at) if offset_from_date else at
        step = {"step": (at - base) // timedelta(hours=1)} if offset_from_date else {}
        return {"step": 0} | fdb_request | step | {"date": base.strftime("%Y%m%d"), "time": base.strftime("%H%M")}

    return _requests(spark, map(one, dates))


@source("hindcasts")
def hindcasts(spark: SparkSession, dates: Sequence[datetime], reference: Sequence[datetime], years: int, step: str | Sequence[int] = (0,), **fixed: object) -> DataFrame:
    """The request for each of the dates that is a valid time of the reference dates' hindcasts; of several the first counts."""
    of = {}
    for r in hindcast_requests(reference, years, expand(step)):
        of.setdefault(r["valid"], r)
    rows = [(of[d]["base"], of[d]["reference"], of[d]["step"]) for d in dates if d in of]
    return _requests(spark, [fixed | {"hdate": h.strftime("%Y%m%d"), "date": r.strftime("%Y%m%d"), "time": r.strftime("%H%M"), "step": s} for h, r, s in rows])


@source("synthetic")
def synthetic(spark: SparkSession, dates: Sequence[datetime], cells: int, members: int = 1, variables: Sequence[str] = ("a",), seed: int = 0) -> DataFrame:
    """Generated values: seeded and the same in each run, made on the executors."""
    per_date, dates = cells * members, list(dates)
    ids = spark.range(len(dates) * per_date)
    # a table of dates by number: a join, whose plan doesn't grow with them
    table = spark.createDataFrame([(k, str(d)) for k, d in enumerate(dates)], "_at long, d string").select("_at", F.col("d").cast("timestamp_ntz").alias("_date"))
    ids = ids.withColumn("_at", F.floor(F.col("id") / per_date)).join(side(table, len(dates)), "_at")
    at = F.col("_date")
    values = [(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(v)), F.lit(1 << 40)) / float(1 << 40)).alias(v) for v in variables]
    return ids.select(at.alias("date"), F.pmod((F.col("id") / cells).cast("int"), F.lit(members)).alias("member"), F.pmod("id", F.lit(cells)).cast("int").alias("cell"), *values)


#: Templates that have a name of their own.
NAMINGS = {"param": "{param}", "param_levelist": "{param}_{levelist}", "default": "{param}_{levelist}"}


@filter_("variable_names")
def variable_names(df: DataFrame, template: str = "default", column: str = "variable") -> DataFrame:
    """A column with each field's name, made of other columns by a template; a column that is null is left out together with the text before it."""
    *pairs, tail = re.split(r"\{(\w+)\}", NAMINGS.get(template, template))
    parts = [F.coalesce(F.concat(F.lit(text), F.col(key).cast("string")), F.lit("")) for text, key in zip(pairs[::2], pairs[1::2], strict=True)]
    return df.withColumn(column, F.concat(*parts, F.lit(tail)))


@filter_("crop")
def crop(df: DataFrame, north: float = 90, west: float = 0, south: float = -90, east: float = 360) -> DataFrame:
    return df.filter(geo.inside(F.col("latitude"), F.col("longitude"), north, west, south, east))


@filter_("rename")
def rename(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumnsRenamed(names)


@filter_("tabularise")
def tabularise(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return tabular.tabularise(df, names)


@filter_("griddify")
def griddify(df: DataFrame, template: DataFrame, variables: Sequence[str], max_distance_km: float = 200.0) -> DataFrame:
    return tabular.griddify(df, template, variables, max_distance_km)


@filter_("where")
def where(df: DataFrame, condition: str) -> DataFrame:
    return df.where(condition)
