"""The engine's data model over the driver's tables, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.operators.cube import Cube
from stratoframe.operators.trajectories import Trajectories

ORIGIN = "1995-01-01 00:00:00"
MONTH = timedelta(days=30)
VARIABLES = ("q", "p", "d", "x")
MISSING = (5, 6, 40)
STEPS = tuple(timedelta(hours=6 * k) for k in range(1, 8))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket(column: str) -> F.Column:
    """The start of the 30-day period."""
    origin = F.lit(ORIGIN).cast("timestamp_ntz")
    return origin + F.make_dt_interval(days=(30 * F.floor(F.datediff(column, origin) / 30)).cast("int"))


def _sums() -> list[F.Column]:
    return [
        F.sum("l_quantity").alias("q"), F.sum(F.round("l_extendedprice")).alias("p"), F.sum(F.round(F.col("l_discount") * 100)).alias("d"), F.sum(F.round(F.col("l_tax") * 100)).alias("x"),
    ]


def grid(spark: SparkSession, north: float = 60.0, west: float = 0.0) -> DataFrame:
    cells = spark.range(10).select(F.col("id").cast("int").alias("cell"))
    row, col = F.floor(F.col("cell") / 5).cast("int"), F.col("cell") % 5
    return cells.select("cell", (F.lit(north) - 10 * row).cast("double").alias("latitude"), (F.lit(west) + 30 * col).cast("double").alias("longitude"), row.alias("row"), col.alias("col"))


def cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Monthly sums of line items by member (line number) and cell (supplier). Its extent is the range of ship dates."""
    items = read(spark, sf_dir, "lineitem")
    keys = [bucket("l_shipdate").alias("date"), (F.col("l_linenumber") % 2).cast("int").alias("member"), (F.col("l_suppkey") % 10).cast("int").alias("cell")]
    df = items.groupBy(*keys).agg(*_sums())
    first, last = items.agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    origin = datetime.fromisoformat(ORIGIN)
    start, end = (origin + MONTH * ((d - origin).days // 30) for d in (first, last))
    return Cube(df, VARIABLES, start, end, MONTH, 2, 10, grid(spark), (2, 5))


def trajectories(spark: SparkSession, sf_dir: str) -> Trajectories:
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    keys = [
        bucket("o_orderdate").alias("base_date"), (21600 * F.col("l_linenumber")).cast("int").alias("step_s"), (F.col("l_suppkey") % 2).cast("int").alias("member"), (F.col("l_partkey") % 10).cast("int").alias("cell"),
    ]
    df = joined.groupBy(*keys).agg(*_sums())
    first, last = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    origin = datetime.fromisoformat(ORIGIN)
    start, end = (origin + MONTH * ((d - origin).days // 30) for d in (first, last))
    return Trajectories(df, VARIABLES, start, end, MONTH, STEPS, 2, 10, grid(spark))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    at = F.date_trunc("second", F.col("ts") + F.expr("interval '0.5' second")).cast("timestamp_ntz")
    lat = ((F.col("user_id") * 37) % 181 - 90).cast("double")
    lon = ((F.col("user_id") * 53 + F.col("event_id") % 7) % 360).cast("double")
    return e.select(at.alias("ts"), lat.alias("latitude"), lon.alias("longitude"), "value", F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"))


SQL = """
WITH cube AS (
  SELECT TIMESTAMP '1995-01-01' + to_days(CAST(30 * (date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) // 30) AS INTEGER)) AS date,
         CAST(l_linenumber % 2 AS INTEGER) AS member, CAST(l_suppkey % 10 AS INTEGER) AS cell,
         sum(l_quantity) AS q, sum(round(l_extendedprice)) AS p, sum(round(l_discount * 100)) AS d, sum(round(l_tax * 100)) AS x
  FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT *, CAST(date_diff('day', (SELECT min(date) FROM cube), date) // 30 AS INTEGER) AS i FROM cube),
n AS (SELECT max(i) + 1 AS n FROM c),
grid AS (SELECT CAST(g AS INTEGER) AS cell, CAST(g // 5 AS INTEGER) AS row, CAST(g % 5 AS INTEGER) AS col, CAST(60 - 10 * (g // 5) AS DOUBLE) AS latitude, CAST(30 * (g % 5) AS DOUBLE) AS longitude FROM range(10) t(g)),
obs AS (
  SELECT date_trunc('second', ts + INTERVAL 500 MILLISECONDS) AS ts, CAST((user_id * 37) % 181 - 90 AS DOUBLE) AS latitude,
         CAST((user_id * 53 + event_id % 7) % 360 AS DOUBLE) AS longitude, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events),
traj AS (
  SELECT TIMESTAMP '1995-01-01' + to_days(CAST(30 * (date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) // 30) AS INTEGER)) AS base_date,
         CAST(21600 * l_linenumber AS INTEGER) AS step_s, CAST(l_suppkey % 2 AS INTEGER) AS member, CAST(l_partkey % 10 AS INTEGER) AS cell,
         sum(l_quantity) AS q, sum(round(l_extendedprice)) AS p, sum(round(l_discount * 100)) AS d, sum(round(l_tax * 100)) AS x
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4)
"""
