"""Accumulations whose intervals come from an index, and the index's uniqueness."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratoframe.operators import coverings, derived
from stratoframe.plans import recipe
from stratoframe.sources.registry import SOURCES, RepeatedKeysError, add_messages, key_digest

HOUR = timedelta(hours=1)
T = datetime(2024, 1, 2)
FIELD = "start timestamp_ntz, end timestamp_ntz, base timestamp_ntz, cell int, v double"


def planned(spark, intervals, dates, period, **options):
    held = spark.createDataFrame(intervals, "start timestamp_ntz, end timestamp_ntz, base timestamp_ntz")
    found = coverings.plan(coverings.needed(spark, dates, period), held, **options)
    return sorted((r["date"], r["start"], r["end"], r["base"], r["sign"]) for r in found.collect())


def test_hourly_intervals_without_bases(spark):
    hours = [(T + k * HOUR, T + (k + 1) * HOUR, None) for k in range(24)]
    got = planned(spark, hours, [T + 12 * HOUR], "3h")
    assert got == [(T + 12 * HOUR, T + k * HOUR, T + (k + 1) * HOUR, None, 1) for k in (9, 10, 11)]


def test_totals_since_a_base_are_subtracted(spark):
    day = timedelta(days=1)
    totals = [(T + d * day, T + d * day + k * HOUR, T + d * day) for d in range(3) for k in (1, 2, 3, 6, 9, 12, 24)]
    assert planned(spark, totals, [T + 12 * HOUR], "3h") == [(T + 12 * HOUR, T, T + 9 * HOUR, T, -1), (T + 12 * HOUR, T, T + 12 * HOUR, T, 1)]
    assert planned(spark, totals, [T + 36 * HOUR], "36h") == [(T + 36 * HOUR, T, T + day, T, 1), (T + 36 * HOUR, T + day, T + 36 * HOUR, T + day, 1)]


def test_periods_that_nothing_covers(spark):
    hours = [(T + k * HOUR, T + (k + 1) * HOUR, None) for k in range(24) if k != 7]
    assert planned(spark, hours, [T + 9 * HOUR, T + 5 * HOUR], "3h", missing="skip") == [(T + 5 * HOUR, T + k * HOUR, T + (k + 1) * HOUR, None, 1) for k in (2, 3, 4)]
    with pytest.raises(Exception, match="no intervals cover"):
        planned(spark, hours, [T + 9 * HOUR], "3h")
    with pytest.raises(ValueError, match="unknown way"):
        planned(spark, hours, [T + 9 * HOUR], "3h", missing="guess")


def test_plans_are_those_of_the_search(spark):
    """Each period's chain is what the search finds with all intervals at hand."""
    rng = random.Random(6)
    intervals = {(T + b * HOUR + s * HOUR, T + b * HOUR + e * HOUR, T + b * HOUR) for b in range(0, 72, 6) for s, e in [(s, s + rng.choice((1, 2, 3))) for s in range(18)]}
    dates = [T + k * HOUR for k in range(30, 54, 3)]
    ordered = sorted((derived.Interval(*i) for i in intervals), key=lambda i: (datetime.max - i.base, i.start, i.end))
    wanted = {}
    for d in dates:
        near = [i for i in ordered if i.start >= d - 30 * HOUR and i.end <= d + 24 * HOUR]
        wanted[d] = derived.cover(d - 6 * HOUR, d, lambda _, near=near: near, timedelta(days=1))
    got = planned(spark, list(intervals), dates, "6h")
    assert got == sorted((d, i.start, i.end, i.base, i.sign) for d, plan in wanted.items() for i in plan)


def test_sums_agree_with_the_values(spark):
    rows = [(T + k * HOUR, T + (k + 1) * HOUR, None, c, float(k * 10 + c)) for k in range(24) for c in range(3)]
    fields = spark.createDataFrame(rows, FIELD).drop("base")
    got = coverings.accumulate(fields, [T + 6 * HOUR, T + 24 * HOUR], "6h", ["cell"], ["v"])
    assert {(r["date"], r["cell"]): r["v"] for r in got.collect()} == {(T + h * HOUR, c): sum(k * 10 + c for k in range(h - 6, h)) for h in (6, 24) for c in range(3)}
    assert coverings.accumulate(fields.filter("cell > 5"), [T + 6 * HOUR], "6h", ["cell"], ["v"], missing="skip").count() == 0
    short = fields.filter(~((F.col("cell") == 1) & (F.col("start") == F.lit(str(T)).cast("timestamp_ntz"))))
    with pytest.raises(Exception, match="incomplete accumulation"):
        coverings.accumulate(short, [T + 6 * HOUR], "6h", ["cell"], ["v"]).collect()


def test_periods_of_messages(spark):
    messages = spark.createDataFrame([(T + 9 * HOUR, "3", "9"), (T, None, "0")], "valid_datetime timestamp_ntz, startStep string, endStep string")
    got = [(r["base"], r["start"], r["end"]) for r in coverings.periods(messages).collect()]
    assert got == [(T, T + 3 * HOUR, T + 9 * HOUR), (T, None, T)]
    total = coverings.periods(messages.limit(1), first=None).first()
    assert (total["start"], total["end"]) == (T, T + 9 * HOUR)


def test_recipes_read_what_is_there(spark):
    rows = [(T + k * HOUR, T + (k + 1) * HOUR, 0, 0, 1.0 + k) for k in range(24)]
    SOURCES["hours"] = lambda spark, dates: spark.createDataFrame(rows, "start timestamp_ntz, end timestamp_ntz, member int, cell int, tp double")
    spec = {"accumulate": {"source": {"hours": {}}, "period": "6h", "values": ["tp"]}}
    got = recipe.build(spark, spec, [T + 6 * HOUR, T + 12 * HOUR])
    assert sorted((r["date"], r["tp"]) for r in got.collect()) == [(T + 6 * HOUR, 21.0), (T + 12 * HOUR, 57.0)]


def test_the_search_stops_with_an_error(spark):
    dense = [derived.Interval(T + a * HOUR, T + b * HOUR, T + c * HOUR) for a in range(12) for b in range(a + 1, 12) for c in range(5)]
    with pytest.raises(ValueError, match="places"):
        derived.cover(T, T + 11 * HOUR + timedelta(minutes=1), lambda _: dense, limit=10)


def test_messages_with_the_same_keys_are_refused(spark):
    schema = "path string, offset long, length long, valid_datetime timestamp_ntz, param string"
    index = spark.createDataFrame([("a", 0, 10, T, "t"), ("a", 10, 10, T, "q")], schema)
    assert add_messages(index, index, unique=True).count() == 2  # the same places again
    with pytest.raises(RepeatedKeysError, match="a at 0 and b at 5"):
        add_messages(index, spark.createDataFrame([("b", 5, 10, T, "t")], schema), unique=True)
    level = spark.createDataFrame([("b", 5, 10, T, "t", 500), ("b", 15, 10, T, "t", 850)], f"{schema}, level int")
    grown = add_messages(index, level, unique=True)
    assert grown.count() == 4 and grown.filter("level is null").count() == 2
    with pytest.raises(RepeatedKeysError):
        add_messages(grown, spark.createDataFrame([("c", 0, 10, T, "t")], schema), unique=True)  # null keys are equal
    digests = [{r["d"] for r in df.filter("param = 'q'").select(key_digest(df).alias("d")).collect()} for df in (index, grown)]
    assert digests[0] == digests[1]
