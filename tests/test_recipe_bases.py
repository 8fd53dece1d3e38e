"""Recipes of forecasts: choices on base dates and steps, and groups as one plan."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratoframe.operators.cube import on_dates
from stratoframe.plans import recipe
from stratoframe.sources.registry import SOURCES

T = datetime(2024, 1, 1)
DAY = timedelta(days=1)
BASES = recipe.Bases([T + k * DAY for k in range(6)], (0, 6, 12))


def dates(a, b):
    return {"start": T + a * DAY, "end": T + b * DAY, "frequency": "1d"}


def test_choices_are_rectangles():
    parts = recipe.routed([{"base_dates": dates(0, 2)}, {"base_dates": dates(3, 9), "steps": [0]}, {"base_dates": dates(3, 5), "steps": "6/to/24/by/6"}], BASES)
    assert [(len(p), p.steps) for p in parts] == [(3, (0, 6, 12)), (3, (0,)), (3, (6, 12))]
    assert [p.steps for p in recipe.routed([{"steps": [0, 6]}, {"steps": [12]}], BASES)] == [(0, 6), (12,)]
    assert [len(p) for p in recipe.routed([{"dates": dates(0, 2)}, {"dates": dates(5, 5)}], list(BASES))] == [3, 1]


def test_requests_are_covered_once():
    with pytest.raises(ValueError, match=r"2024-01-03 00:00:00 \+ 6 h is in choices 0 and 1"):
        recipe.routed([{"base_dates": dates(0, 2)}, {"base_dates": dates(2, 5), "steps": [6]}], BASES)
    with pytest.raises(ValueError, match=r"no choice has 2024-01-04 00:00:00 \+ 12 h"):
        recipe.routed([{"base_dates": dates(0, 2)}, {"base_dates": dates(3, 5), "steps": [0, 6]}], BASES)
    with pytest.raises(ValueError, match="a choice has one of"):
        recipe.routed([{"source": {}}], BASES)
    with pytest.raises(ValueError, match="whole hours"):
        recipe.steps_of({"start": "0h", "end": "1h", "frequency": "30m"})


def test_forecasts_are_built_and_loaded(spark, tmp_path):
    rows = [(b, 3600 * h, 0, c, float(h + c)) for b in BASES for h in (0, 6, 12, 18) for c in range(2)]
    table = spark.createDataFrame(rows, "base_date timestamp_ntz, step_s int, member int, cell int, v double")
    SOURCES["all_forecasts"] = lambda spark, dates: on_dates(table, dates, "base_date")
    SOURCES["other_forecasts"] = lambda spark, dates: on_dates(table.withColumn("w", F.col("v") * 2).drop("v"), dates, "base_date")
    choices = [{"steps": [0], "all_forecasts": {}}, {"steps": [6, 12], "pipe": [{"all_forecasts": {}}]}]
    spec = {"dates": {"base_dates": dates(0, 5), "steps": [0, 6, 12]}, "group_by": "daily", "input": {"join": [{"concat": choices}, {"other_forecasts": {}}]}}
    assert recipe.problems(spec) == []
    path = str(tmp_path / "out")
    assert recipe.load(spark, spec, path, "1/2") + recipe.load(spark, spec, path, "2/2") == list(range(6))
    assert recipe.load(spark, spec, path) == []
    found = spark.read.parquet(f"{path}/data")
    wanted = [(b, 3600 * h, 0, c, float(h + c), 2.0 * (h + c), k) for k, b in enumerate(BASES) for h in (0, 6, 12) for c in range(2)]
    assert sorted(tuple(r) for r in found.select("base_date", "step_s", "member", "cell", "v", "w", "group").collect()) == wanted
    assert {r["variable"]: r["count"] for r in recipe.finalise(spark, spec, path).collect()} == {"v": 36, "w": 36}


def test_a_recipe_of_many_groups_is_one_plan(spark):
    """The plan doesn't grow with the groups."""
    table = spark.range(4000).select((F.lit(str(T)).cast("timestamp_ntz") + F.make_dt_interval(days=F.col("id").cast("int"))).alias("date"), F.lit(0).alias("member"), F.lit(0).alias("cell"), F.col("id").cast("double").alias("v"))
    SOURCES["days"] = lambda spark, dates: on_dates(table, dates)
    spec = {"dates": dates(0, 3999), "group_by": "daily", "input": {"days": {}}}
    rows = recipe.run(spark, spec)
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 6000
    assert rows.filter(F.col("group") != F.col("v")).count() == 0 and rows.count() == 4000
