"""Samples as arrays: by position, in loops, and one range of samples at a time."""

from __future__ import annotations

import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratoframe.operators.cube import MissingDateError
from stratoframe.operators.tabular import Observations
from stratoframe.plans.dataset import open_dataset
from stratoframe.plans.synthetic import synthetic
from stratoframe.plans.tensors import Tensors, digests
from tests.test_cube import analytic, value

START = datetime(2021, 1, 1)


def expected(i, names=2, members=2, cells=6):
    return np.array([[[value(i, v, m, c) for c in range(cells)] for m in range(members)] for v in range(names)], np.float32)


def test_a_cube_by_position(spark):
    t = open_dataset(spark, analytic(spark), tensors="numpy")
    assert len(t) == 10 and t.shape == (10, 2, 2, 6)
    for k in (0, 3, -1):
        assert t[k].dtype == np.float32 and np.array_equal(t[k], expected(k % 10))
    with pytest.raises(IndexError):
        t[10]
    view = open_dataset(spark, analytic(spark), select=["b"], member=1, start="2021-01-04", tensors="numpy")
    assert view.shape == (7, 1, 1, 6) and np.array_equal(view[0], expected(3)[1:, 1:])


def test_a_loop_in_order_of_dates(spark):
    shuffled = analytic(spark)
    shuffled = shuffled.with_("dealt", df=shuffled.df.repartition(7, F.xxhash64("cell", "date")))
    for at_once in (1, 3, 100):
        found = list(Tensors(shuffled, samples_at_once=at_once))
        assert len(found) == 10 and all(np.array_equal(a, expected(k)) for k, a in enumerate(found))


def test_missing_dates(spark):
    t = open_dataset(spark, analytic(spark), set_missing_dates=[2, 5], tensors="numpy")
    with pytest.raises(MissingDateError):
        t[2]
    loop = iter(t)
    assert np.array_equal(next(loop), expected(0)) and np.array_equal(next(loop), expected(1))
    with pytest.raises(MissingDateError):
        next(loop)
    found = dict(t.present())
    assert sorted(found) == [0, 1, 3, 4, 6, 7, 8, 9] and np.array_equal(found[6], expected(6))
    assert digests(t).count() == 8


def test_dates_without_their_rows_are_an_error(spark):
    c = analytic(spark)
    holes = c.with_("holes", df=c.df.filter("not (cell = 3 and member = 1 and day(date) = 5)"))
    assert np.array_equal(Tensors(holes)[3], expected(3))
    with pytest.raises(ValueError, match="2021-01-05"):
        Tensors(holes)[4]
    with pytest.raises(ValueError, match="2021-01-05"):
        list(Tensors(holes))


def test_containers(spark):
    arrow = open_dataset(spark, analytic(spark), tensors="arrow")[1]
    assert isinstance(arrow, pa.Tensor) and arrow.shape == (2, 2, 6)
    with pytest.raises(ValueError, match="unknown container"):
        open_dataset(spark, analytic(spark), tensors="lists")


def test_windows(spark):
    rows = [(START + timedelta(minutes=m), float(m % 90), float(m % 360), float(m), float(-m)) for m in range(0, 600, 7) if not 200 <= m < 330]
    o = Observations.of(spark.createDataFrame(rows[::-1], "ts timestamp_ntz, latitude double, longitude double, a double, b double"), start=START, window="(-1h,0]", frequency="1h")
    t = open_dataset(spark, o, tensors="numpy")
    loop = list(t)
    assert len(loop) == len(o) == 10
    for k, s in enumerate(loop):
        inside = [r for r in rows if 60 * (k - 1) < (r[0] - START).total_seconds() / 60 <= 60 * k]
        assert s.index == k and s.reference == START + k * timedelta(hours=1)
        assert s.values.shape == (len(inside), 2) and s.values[:, 0].tolist() == [r[3] for r in inside]
        assert s.timedeltas.tolist() == [int((r[0] - s.reference).total_seconds()) for r in inside] and s.latitudes.tolist() == [r[1] for r in inside] and s.longitudes.tolist() == [r[2] for r in inside]
        one = t[k]
        assert one.index == k and np.array_equal(one.values, s.values)
    assert any(len(s.values) == 0 for s in loop)
    with pytest.raises(TypeError):
        _ = t.shape


def test_a_loop_holds_one_range_at_a_time(spark):
    dates, cells = 60, 20_000
    made = synthetic(spark, "2021-01-01", str(START + timedelta(hours=6 * (dates - 1))), {"a": 1.0, "b": 2.0}, cells, "6h")
    one = 2 * cells * 8
    tracemalloc.start()
    seen = sum(float(x[1].mean()) for x in Tensors(made, samples_at_once=2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 2.0 * dates and peak < 20 * one < dates * one / 2
