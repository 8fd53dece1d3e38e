"""Stored datasets: what a round trip keeps, versions, and appended fragments against one sort."""

from __future__ import annotations

import pathlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratoframe.functions.variables import Variable, VariablesDifferError, unified
from stratoframe.operators import combine, statistics
from stratoframe.operators.cube import Cube
from stratoframe.operators.tabular import Observations, encode
from stratoframe.plans import stored
from stratoframe.plans.dataset import open_dataset, save_dataset
from stratoframe.plans.fragments import Fragments, outside, shared_stretches
from stratoframe.plans.synthetic import synthetic

START = datetime(2021, 1, 1)


def cube(spark, dates=12, missing=(3, 7)):
    made = synthetic(spark, "2021-01-01", str(START + timedelta(hours=6 * (dates - 1))), ["a", "b_500"], {"area": (60, 0, 40, 30), "resolution": 10.0}, "6h", members=2)
    made = made.typed({"a": {"units": "K"}, "b_500": {"units": "m/s"}})
    return made.set_missing(list(missing)) if missing else made


def test_a_round_trip_keeps_every_property(spark, tmp_path):
    c, path = cube(spark), str(tmp_path / "c")
    assert save_dataset(c, path) == 1
    back = open_dataset(spark, path)
    for name in ("variables", "start", "end", "frequency", "members", "cells", "field_shape", "missing", "shape", "dates", "grids", "typed_variables"):
        assert getattr(back, name) == getattr(c, name), name
    assert back.typed_variables["b_500"] == Variable("b_500", "m/s", "b", 500.0, "pl")
    assert back.origin("a") == (path, "a") and back.tree == ("stored", c.tree)
    key = ["latitude", "longitude"]
    assert sorted(back.grid.select("cell", *key, "row", "col").collect()) == sorted(c.grid.select("cell", *key, "row", "col").collect())
    fresh = statistics.collected(statistics.statistics(c))
    for v in c.variables:
        assert back.statistics[v] == pytest.approx(fresh[v])
    assert sorted(back.rows().collect()) == sorted(c.rows().collect())
    assert open_dataset(spark, path, area=(60, 0, 50, 10)).cells == 4


def test_opening_reads_no_row(spark, tmp_path):
    path = tmp_path / "c"
    save_dataset(cube(spark), str(path))
    for f in (path / "rows").rglob("*.parquet"):
        f.write_bytes(b"not parquet")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    view = open_dataset(spark, str(path), start="2021-01-02", select=["a"], area=(60, 0, 40, 10))
    assert view.shape == (8, 1, 2, 6) and view.statistics["a"]["count"] == 10 * 2 * 12


def test_saves_add_dates_and_versions_stay(spark, tmp_path):
    c, path = cube(spark), str(tmp_path / "c")
    dates = c.dates
    save_dataset(c.between(dates[6], None), path)
    save_dataset(c.between(None, dates[2]), path)
    back = open_dataset(spark, path)
    assert back.dates == dates and back.missing == {dates[k] for k in (3, 4, 5, 7)}
    late = cube(spark, missing=(3,))
    save_dataset(late, path)
    back = open_dataset(spark, path)
    assert back.missing == {dates[3]} and sorted(back.rows().collect()) == sorted(late.rows().collect())
    assert back.statistics["a"] == pytest.approx(statistics.collected(statistics.statistics(late))["a"])
    assert open_dataset(spark, f"{path}@1").start == dates[6] and len(open_dataset(spark, f"{path}@2").missing) == 4
    assert [r["pieces"] for r in stored.versions(spark, path).orderBy("version").collect()] == [1, 2, 3]
    assert save_dataset(late, path) == 4 and sorted(open_dataset(spark, path).rows().collect()) == sorted(late.rows().collect())
    with pytest.raises(ValueError, match="variables"):
        save_dataset(late.select(["a"]), path)
    with pytest.raises(VariablesDifferError):
        save_dataset(late.typed({"a": {"units": "degC"}}), path)
    with pytest.raises(FileNotFoundError):
        open_dataset(spark, f"{path}@9")


def test_two_saves_of_one_version(spark, tmp_path):
    path = str(tmp_path / "c")
    save_dataset(cube(spark), path)
    body = stored.metadata(spark, path)
    stored.commit(spark, path, body, 1)
    with pytest.raises(stored.SavedMeanwhileError):
        stored.commit(spark, path, body, 1)


def test_tendencies_are_stored_across_saves(spark, tmp_path):
    c, path = cube(spark, missing=()), str(tmp_path / "c")
    save_dataset(c.between(None, c.dates[5]), path, ["6h", "12h"])
    save_dataset(c, path)
    back = open_dataset(spark, path)
    for delta in ("6h", "12h"):
        fresh = {r["variable"]: {f: r[f] for f in statistics.FIELDS} for r in statistics.tendency_statistics(c, [delta]).collect()}
        known = statistics.stored_tendencies(back, delta)
        assert all(known[v] == pytest.approx(fresh[v]) for v in c.variables)
    twice = statistics.stored_tendencies(back.rename({"a": "z"}).rescale({"z": (2, 7)}).select(["z"]), "12h")["z"]
    assert twice["stdev"] == pytest.approx(2 * known["a"]["stdev"]) and twice["mean"] == pytest.approx(2 * known["a"]["mean"])
    assert set(combine.join([back.select(["a"]), back.select(["b_500"])]).stored_tendencies) == {"6h", "12h"}
    with pytest.raises(ValueError, match="24h|1d"):
        statistics.stored_tendencies(back, "24h")
    with pytest.raises(ValueError, match="no stored"):
        statistics.stored_tendencies(c, "6h")


def test_given_statistics_are_stored(spark, tmp_path):
    c, path = cube(spark), str(tmp_path / "c")
    given = {v: {"mean": 1.0, "stdev": 2.0, "minimum": 0.0, "maximum": 3.0, "count": 4} for v in c.variables}
    save_dataset(open_dataset(spark, c, statistics=given), path)
    assert open_dataset(spark, path).statistics == given


def test_merged_moments(spark):
    rng = random.Random(1)
    values = [rng.gauss(5, 3) if rng.random() < 0.9 else float("nan") for _ in range(300)]
    df = spark.createDataFrame([(START + timedelta(hours=k), v, float("nan")) for k, v in enumerate(values)], "date timestamp_ntz, v double, gone double")
    cuts = [0, 7, 8, 100, 300]
    at = lambda k: F.lit(str(START + timedelta(hours=k))).cast("timestamp_ntz")
    pieces = [stored.moments(df.filter((F.col("date") >= at(a)) & (F.col("date") < at(b))), ["v", "gone"], "date") for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = statistics.collected(statistics.summary(df, ["v", "gone"]))
    merged = stored.merged(pieces)
    assert merged["v"] == pytest.approx(whole["v"]) and merged["gone"] == whole["gone"]


def test_layouts_dont_mix(spark, tmp_path):
    path = str(tmp_path / "c")
    save_dataset(cube(spark), path)
    rows = spark.createDataFrame([(START, 1.0, 2.0, 3.0)], "ts timestamp_ntz, latitude double, longitude double, v double")
    with pytest.raises(ValueError, match="gridded"):
        save_dataset(Observations.of(rows), path)


# -- typed variables


def test_units_are_checked_and_followed(spark):
    c = cube(spark)
    cold = c.rescale({"a": ("K", "degC")})
    assert cold.typed_variables["a"].units == "degC" and c.rescale({"a": "degC"}).typed_variables["a"].units == "degC"
    for combination in (combine.join, combine.merge, combine.ensemble, combine.grids):
        with pytest.raises(VariablesDifferError, match="rescale"):
            combination([c, cold])
    assert combine.ensemble([c, cold.rescale({"a": "K"})]).typed_variables["a"].units == "K"
    assert combine.join([c, cold.rescale({"a": "K"})]).typed_variables["a"].units == "K"
    with pytest.raises(VariablesDifferError):
        c.rescale({"a": ("hPa", "Pa")})
    assert c.rescale({"a": (2, 0)}).typed_variables["a"].units is None
    renamed = c.rename({"a": "z"}).select(["z"])
    assert renamed.typed_variables == {"z": Variable("z", "K", "a")}
    assert combine.join([c.select(["a"]), c.select(["b_500"])]).typed_variables == c.typed_variables


def test_unified_variables():
    a, b = Variable("t", "K", level=500.0, constant=True), Variable("t", None, level_type="pl")
    assert unified([a, b]) == Variable("t", "K", None, 500.0, "pl", False)
    assert unified([Variable("t", "degC"), Variable("t", "C")]).units == "degC"
    with pytest.raises(VariablesDifferError):
        unified([a, Variable("t", "K", level=850.0)])
    with pytest.raises(VariablesDifferError):
        unified([Variable("tp", period=3600), Variable("tp", period=21600)])


def test_constant_variables_become_typed(spark):
    c = cube(spark, 4, ())
    both = Cube(c.df.withColumn("b_500", F.col("cell").cast("double")), c.variables, c.start, c.end, c.frequency, c.members, c.cells, c.grid, c.field_shape)
    assert {v: t.constant for v, t in statistics.with_constants(both).typed_variables.items()} == {"a": False, "b_500": True}


# -- fragments


def observations(spark, seconds):
    rows = [(START + timedelta(seconds=s), float(s % 90), float(s % 360), float(k)) for s, k in seconds]
    return spark.createDataFrame(rows, "ts timestamp_ntz, latitude double, longitude double, v double")


def folders(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("rows/**/*.parquet")}


def test_shared_stretches():
    t = [START + timedelta(seconds=s) for s in range(20)]
    assert shared_stretches([(t[0], t[5]), (t[5], t[9])]) == []
    assert shared_stretches([(t[0], t[5]), (t[3], t[9]), (t[4], t[12]), (t[10], t[11])]) == [(t[3], t[9]), (t[10], t[11])]
    assert shared_stretches([(t[0], t[9]), (t[0], t[9])]) == [(t[0], t[9])]
    assert outside((t[0], t[9]), [(t[2], t[3]), (t[3], t[4]), (t[8], t[12])]) == [(t[0], t[2]), (t[4], t[8])]
    assert outside((t[2], t[3]), [(t[0], t[9])]) == []
    rng = random.Random(2)
    for _ in range(200):
        ranges = [(t[a], t[rng.randrange(a + 1, 20)]) for a in (rng.randrange(19) for _ in range(rng.randrange(1, 6)))]
        stretches = shared_stretches(ranges)
        depth = [sum(a <= x < b for a, b in ranges) for x in t]
        assert [any(a <= x < b for a, b in stretches) for x in t] == [d >= 2 for d in depth]
        left = [r for own in ranges for r in outside(own, stretches)]
        assert [sum(a <= x < b for a, b in left) for x in t] == [int(d == 1) for d in depth]


def test_fragments_equal_one_sort(spark, tmp_path):
    rng = random.Random(4)
    path = str(tmp_path / "obs")
    store, everything = Fragments(spark, path), None
    for low, high in ((0, 100), (300, 400), (80, 150), (149, 160), (600, 700)):
        part = observations(spark, [(rng.randrange(low, high), rng.randrange(3)) for _ in range(300)])
        store.append(part)
        everything = part if everything is None else everything.unionByName(part)
    before = folders(path)
    untouched = [r["folder"] for r in store.pieces().collect() if str(r["first"]) >= str(START + timedelta(seconds=300))]
    version = store.finalise(piece_rows=100)
    assert store.finalise() == version  # nothing left to do
    after = folders(path)
    assert all(after[f] == m for f, m in before.items())  # nothing is rewritten in place
    pieces = store.pieces().collect()
    assert set(untouched) <= {r["folder"] for r in pieces} and len(untouched) == 2
    wanted = sorted(encode(everything).collect())
    assert sorted(store.rows().collect()) == wanted and store.problems().count() == 0
    assert [r["offset"] for r in pieces] == [sum(p["rows"] for p in pieces[:k]) for k in range(len(pieces))] and sum(r["rows"] for r in pieces) == len(wanted)
    assert all(a["last"] < b["first"] for a, b in zip(pieces, pieces[1:], strict=False))
    # more fragments after that, one of them all over the others
    more = observations(spark, [(rng.randrange(0, 700), rng.randrange(3)) for _ in range(200)])
    store.append(more)
    store.append(more.limit(0))
    store.finalise()
    assert sorted(store.rows().collect()) == sorted(encode(everything.unionByName(more)).collect()) and store.problems().count() == 0
    view = open_dataset(spark, path, window="(-1h,0]", frequency="1h")
    assert (view.start, view.end) == tuple(everything.unionByName(more).agg(F.min("ts"), F.max("ts")).first())
    with pytest.raises(ValueError, match="columns"):
        store.append(more.withColumn("w", F.lit(1.0)))


def test_problems_of_fragments_are_found(spark, tmp_path):
    path = str(tmp_path / "obs")
    store = Fragments(spark, path)
    store.append(observations(spark, [(s, 0) for s in range(50)]))
    store.append(observations(spark, [(s, 1) for s in range(40, 90)]))
    assert {r["rule"] for r in store.problems().collect()} == {"pieces don't overlap"}
    body = stored.metadata(spark, path)
    body["pieces"][0]["rows"] += 1
    body["pieces"][1]["last"] = body["pieces"][1]["first"]
    stored.commit(spark, path, body, body["version"])
    assert {r["rule"] for r in store.problems().collect()} == {"pieces don't overlap", "numbers of rows agree", "ranges agree"}


def test_stored_observations_keep_their_view(spark, tmp_path):
    path = str(tmp_path / "obs")
    o = Observations.of(observations(spark, [(s * 60, 0) for s in range(500)]), window="[-2h,0)", frequency="2h")
    save_dataset(o, path)
    back = open_dataset(spark, path)
    assert (back.window, back.frequency, back.start, back.end, back.variables) == (o.window, o.frequency, o.start, o.end, o.variables)
    assert sorted(back.samples().collect()) == sorted(o.samples().collect())
