"""Roles of columns, models of time and standard columns of self-describing tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratoframe.sources.coordinates import UnclearCoordinatesError, by_level, detect, standardised

T = datetime(2024, 1, 1)


def table(spark, **columns):
    """One row; name=(value, attributes)."""
    df = spark.createDataFrame([(0,)], "nothing int")
    return df.select(*[F.lit(v).alias(n, metadata=a) for n, (v, a) in columns.items()])


PLACE = {"latitude": (1.0, {}), "longitude": (-10.0, {})}
TIME, BASE, STEP = ({"standard_name": s} for s in ("time", "forecast_reference_time", "forecast_period"))
BASE_AT = T - timedelta(hours=6)


@pytest.mark.parametrize(
    ("columns", "model", "wanted"),
    [
        ({}, "constant", {}),
        ({"a": (T, TIME)}, "analysis", {"date": T}),
        ({"a": (T, TIME), "b": (6, STEP)}, "valid+step", {"date": T, "base_date": BASE_AT, "step_s": 21600}),
        ({"a": (T, TIME), "b": (6, STEP), "c": (BASE_AT, BASE)}, "valid+step", {"date": T, "base_date": BASE_AT, "step_s": 21600}),
        ({"a": (T, TIME), "c": (BASE_AT, BASE)}, "valid+base", {"date": T, "base_date": BASE_AT, "step_s": 21600}),
        ({"c": (BASE_AT, BASE), "b": (360, STEP | {"units": "minutes"})}, "base+step", {"date": T, "base_date": BASE_AT, "step_s": 21600}),
        ({"c": (BASE_AT, BASE), "b": ("6h", STEP)}, "base+step", {"date": T, "base_date": BASE_AT, "step_s": 21600}),
        ({"c": (BASE_AT, BASE), "b": (timedelta(hours=6), STEP)}, "base+step", {"date": T, "base_date": BASE_AT, "step_s": 21600}),
    ],
)
def test_models_of_time(spark, columns, model, wanted):
    df = table(spark, **columns, **PLACE, v=(1.5, {}))
    found = detect(df)
    assert found.time_model == model and found.variables == ("v",)
    assert standardised(df, found).first().asDict() == wanted | {"latitude": 1.0, "longitude": 350.0, "v": 1.5}


def test_roles_without_a_model(spark):
    for columns in ({"b": (6, STEP)}, {"c": (T, BASE)}):
        with pytest.raises(UnclearCoordinatesError, match="model of time"):
            _ = detect(table(spark, **columns)).time_model


@pytest.mark.parametrize(
    ("name", "attributes", "role", "level"),
    [
        ("lon", {"standard_name": "Longitude"}, "longitude", None), ("lon", {"long_name": "longitude", "units": "degrees_east"}, "longitude", None), ("lon", {"long_name": "longitude"}, None, None),
        ("time", {"standard_name": "forecast_reference_time"}, "base", None), ("TIME", {}, "time", None), ("p", {"standard_name": "air_pressure", "units": "hPa"}, "level", "pl"), ("p", {"standard_name": "air_pressure", "units": "Pa"}, None, None),
        ("z", {"long_name": "height", "units": "m"}, "level", "height"), ("k", {"standard_name": "model_level_number"}, "level", "ml"), ("realization", {}, "member", None), ("station", {}, "point", None),
        ("west_east", {"standard_name": "projection_x_coordinate"}, "x", None), ("temperature", {"units": "K"}, None, None),
    ],
)
def test_rules(spark, name, attributes, role, level):
    pair = {"longitude": {"other": (0.0, {"standard_name": "latitude"})}, "x": {"other": (0.0, {"standard_name": "grid_latitude"})}}
    found = detect(table(spark, **{name: (1.0, attributes)}, **pair.get(role, {})))
    assert {v: k for k, v in found.columns.items()}.get(name) == role and found.level_type == level


def test_attributes_beside_the_table_and_flavours(spark):
    df = table(spark, XTIME=(T, {}), XLAT=(1.0, {}), XLONG=(2.0, {}), latitude=(5.0, {}), longitude=(6.0, {}), bottom_top=(3.0, {}), w=(1.0, {}))
    flavour = {"rules": {"time": {"name": "XTIME"}, "latitude": {"name": "XLAT"}, "longitude": {"name": "XLONG"}, "level": {"name": "bottom_top"}}, "levtype": "ml"}
    found = detect(df, flavour=flavour)
    assert found.columns == {"time": "XTIME", "latitude": "XLAT", "longitude": "XLONG", "level": "bottom_top"} and found.level_type == "ml"
    assert found.variables == ("latitude", "longitude", "w")
    with pytest.raises(UnclearCoordinatesError, match="several columns"):
        detect(df, {"XLAT": {"standard_name": "latitude"}})
    with pytest.raises(UnclearCoordinatesError, match="no latitude"):
        detect(df.select("longitude"))
    with pytest.raises(ValueError, match="unknown roles"):
        detect(df, flavour={"rules": {"height": {"name": "h"}}})
    with pytest.raises(ValueError, match="unknown attributes"):
        detect(df, flavour={"rules": {"time": {"title": "h"}}})


def test_levels_become_variables(spark):
    rows = [(T, c, p * 100.0, float(p + c)) for c in range(3) for p in (500, 850)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, cell int, plev double, t double")
    found = detect(df, {"plev": {"long_name": "pressure", "units": "Pa"}})
    wide = by_level(standardised(df, found), found.variables, (500, 850), ("date", "cell"))
    assert sorted(tuple(r) for r in wide.collect()) == [(T, c, 500.0 + c, 850.0 + c) for c in range(3)]
