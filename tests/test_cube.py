"""Operators over an analytic cube whose every value names its own coordinates."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratoframe.operators import combine, derived, series, statistics
from stratoframe.operators.cube import Cube, MissingDateError, on_dates
from stratoframe.operators.tabular import Observations, pivot
from stratoframe.plans import recipe
from stratoframe.plans.dataset import add_dataset_path, add_named_dataset, list_dataset_names, open_dataset, save_dataset
from stratoframe.sources.registry import SOURCES

DAY = timedelta(days=1)


def value(i, v, m, c):
    return i * 100 + v * 10 + m + c / 100


def analytic(spark, days=10, variables=("a", "b"), members=2, cells=6, start=datetime(2021, 1, 1)):
    rows = spark.range(days * members * cells)
    i = F.floor(F.col("id") / (members * cells)).cast("int")
    m = (F.floor(F.col("id") / cells) % members).cast("int")
    c = (F.col("id") % cells).cast("int")
    at = F.lit(str(start)).cast("timestamp_ntz") + F.make_dt_interval(days=i)
    df = rows.select(at.alias("date"), m.alias("member"), c.alias("cell"), *[(i * 100 + k * 10 + m + c / 100).alias(v) for k, v in enumerate(variables)])
    points = spark.range(cells).select(F.col("id").cast("int").alias("cell"), (F.col("id") * 10.0 - 20).alias("latitude"), (F.col("id") * 15.0).alias("longitude"), (F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"))
    return Cube(df, tuple(variables), start, start + (days - 1) * DAY, DAY, members, cells, points, (2, 3))


def table(df, *names):
    return {tuple(r[k] for k in ("date", "member", "cell")): tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("index", [0, -1, slice(2, 5), slice(None, None, 3), ([0, 4], slice(None), 1), (3, 1, 0, slice(2, 4)), (slice(1, 9, 4), [1, 0], slice(None), 5)])
def test_positions_match_an_array(spark, index):
    c = analytic(spark)
    full = index if isinstance(index, tuple) else (index,)
    full += (slice(None),) * (4 - len(full))
    pick = lambda n, i: [range(n)[i]] if isinstance(i, int) else [range(n)[k] for k in i] if isinstance(i, list) else list(range(n)[i])
    days, names, members, cells = (pick(n, i) for n, i in zip(c.shape, full, strict=True))
    expected = {(c.dates[d], m, x): tuple(round(value(d, v, m, x), 6) for v in names) for d in days for m in members for x in cells}
    got = table(c.at(index), *[c.variables[v] for v in names])
    assert {k: tuple(round(x, 6) for x in v) for k, v in got.items()} == expected


def test_listed_positions_keep_order_and_repeats(spark):
    c = analytic(spark)
    got = sorted((r["position"], r["date"], r["cell"]) for r in c.at(([4, 1, 1], 0, 0, slice(0, 2))).collect())
    assert got == [(p, c.dates[k], x) for p, k in enumerate((4, 1, 1)) for x in (0, 1)]
    assert sorted((r["position"], r["member"]) for r in c.at((0, 0, [-1, 0], 3)).collect()) == [(0, 1), (1, 0)]
    with pytest.raises(IndexError):
        c.at((0, [1, 1]))


def test_dates_by_literals_steps_and_tables(spark):
    c = analytic(spark, days=400, members=1, cells=1)
    wanted = {"few": c.dates[3:90:7], "regular": c.dates[10:390:3], "irregular": [d for k, d in enumerate(c.dates) if k % 7 in (0, 3)]}
    for dates in wanted.values():
        assert sorted(r["date"] for r in on_dates(c.df, dates).collect()) == dates
        assert sorted(r["date"] for r in on_dates(c.df, dates, keep=False).collect()) == sorted(set(c.dates) - set(dates))


def test_joins_check_points(spark):
    c = analytic(spark)
    same = c.with_("grid", grid=c.grid.filter("cell >= 0"))
    moved = c.with_("grid", grid=c.grid.withColumn("latitude", F.col("latitude") + 40))
    combine.join([c.select("a"), same.select("b")])
    for f in (combine.join, combine.ensemble, combine.merge):
        with pytest.raises(ValueError, match="grids differ"):
            f([c, moved])


def test_tendency_statistics_of_another_dataset(spark):
    c = analytic(spark)
    other = c.rescale({"a": (3.0, 0.0)})
    got = {r["variable"]: r["mean"] for r in statistics.tendency_statistics(statistics.with_tendency_statistics(c, other), ["1d"]).collect()}
    assert got == pytest.approx({"a": 300.0, "b": 100.0})
    with pytest.raises(ValueError):
        statistics.with_tendency_statistics(c, other.select("a"))


def test_names_and_grid_sizes(spark):
    assert list_dataset_names("x", {"join": ["b", {"dataset": "a", "select": "t"}]}, end=2020) == ["a", "b", "x"]
    c = analytic(spark)
    assert combine.grids([combine.grids([c, c]), c]).grids == (6, 6, 6)
    assert c.grids == (6,)


def _at(lat, lon):
    lat, lon = math.radians(lat), math.radians(lon)
    return np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])


@pytest.mark.parametrize("options", [{}, {"min_distance_km": 0.0}, {"min_distance_km": 150.0, "neighbours": 3}, {"min_distance_km": 0.0, "max_distance_km": 120.0}])
def test_cutout_matches_brute_force(spark, options):
    fine = [(k, 40.0 + 1.5 * (k // 9) + 0.1 * (k % 3), 5.0 + 1.5 * (k % 9)) for k in range(81)]
    coarse = [(k, 36.0 + 2.2 * (k // 11), 1.0 + 2.2 * (k % 11)) for k in range(110)]

    def of(points):
        grid = spark.createDataFrame([(*p, None, None) for p in points], "cell int, latitude double, longitude double, row int, col int")
        return analytic(spark, days=1, members=1, cells=len(points)).with_("grid", grid=grid, field_shape=None)

    n, s, w, e = (f(p[i] for p in fine) for f, i in ((max, 1), (min, 1), (min, 2), (max, 2)))
    near = [p for p in coarse if s - 2 <= p[1] <= n + 2 and w - 2 <= p[2] <= e + 2]
    least = min(np.linalg.norm(_at(*p[1:]) - _at(*q[1:])) for p in near for q in near if p != q)
    if "min_distance_km" in options:
        least = 2 * math.sin(options["min_distance_km"] / 6371.0 / 2)
    gone, many = set(), options.get("neighbours", 5)
    for k, lat, lon in near:
        at = _at(lat, lon)
        best = sorted((np.linalg.norm(at - _at(*q[1:])), q[0]) for q in fine)[:many]
        inside = False
        for j in range(many - 2):
            weights = np.linalg.solve(np.array([_at(*fine[i][1:]) for _, i in best[j : j + 3]]).T, at) if abs(np.linalg.det(np.array([_at(*fine[i][1:]) for _, i in best[j : j + 3]]))) > 1e-15 else [-1]
            inside |= min(weights) >= 0
        if (inside or best[0][0] <= least) and ("max_distance_km" not in options or best[0][0] <= 2 * math.sin(options["max_distance_km"] / 6371.0 / 2)):
            gone.add(k)
    out = combine.cutout([of(fine), of(coarse)], **options)
    assert out.grids == (81, 110 - len(gone))
    kept = [(r["latitude"], r["longitude"]) for r in out.grid.filter("cell >= 81").orderBy("cell").collect()]
    assert kept == [(lat, lon) for k, lat, lon in coarse if k not in gone]
    assert gone


def test_bad_positions(spark):
    c = analytic(spark)
    for bad in (99, ([0], [1]), (0, 0, 0, 0, 0)):
        with pytest.raises(IndexError):
            c.at(bad)
    with pytest.raises(MissingDateError):
        c.set_missing([3]).at(3)


def test_errors(spark):
    c = analytic(spark)
    with pytest.raises(ValueError):
        c.select("nothing")
    with pytest.raises(ValueError):
        c.rescale({"a": (-1, 0)})
    with pytest.raises(ValueError):
        c.every("36h")
    with pytest.raises(ValueError):
        c.number(3)
    with pytest.raises(ValueError):
        combine.concat([c, c])
    with pytest.raises(ValueError):
        combine.concat([c.between(None, c.dates[2]), c.between(c.dates[5], None)])
    with pytest.raises(ValueError):
        combine.merge([c, c])
    with pytest.raises(NotImplementedError):
        open_dataset(spark, c, unheard_of=1)


def test_select_orders(spark):
    c = analytic(spark, variables=("a", "b", "d"))
    assert c.select(["d", "a"]).variables == ("d", "a")
    assert c.select({"d", "a"}).variables == ("a", "d")
    assert c.drop("b").variables == ("a", "d")
    assert c.reorder({"a": 2, "b": 0, "d": 1}).variables == ("b", "d", "a")


def test_missing_follows_views(spark):
    c = analytic(spark).set_missing([2, 4])
    assert c.between(c.dates[1], None).missing_indices == [1, 3]
    assert c.every("2d").missing_indices == [1, 2]
    assert combine.join([c, c.rename({"a": "z"})]).missing_indices == [2, 4]
    fine = series.interpolate_frequency(c, "12h")
    assert fine.missing_indices == [3, 4, 5, 7, 8, 9]
    assert series.rolling_average(c, -1, 1).missing == frozenset(c.dates[k] for k in (1, 2, 3, 4, 5))


def test_fill_interpolates_linearly(spark):
    c = analytic(spark, members=1, cells=2).set_missing([3, 4])
    got = table(series.fill_missing(c, "interpolate").rows(), "a")
    assert got[(c.dates[4], 0, 1)][0] == pytest.approx(value(4, 0, 0, 1))
    with pytest.raises(MissingDateError):
        series.fill_missing(c.set_missing([9]), "interpolate")


def test_statistics_follow_rescaling_and_overlay(spark):
    c = analytic(spark)
    known = c.with_("statistics", statistics=statistics.collected(statistics.statistics(c)))
    again = statistics.collected(statistics.statistics(known.rescale({"a": (2, 5)})))["a"]
    assert known.rescale({"a": (2, 5)}).statistics["a"]["stdev"] == pytest.approx(again["stdev"])
    assert known.rescale({"a": (2, 5)}).statistics["a"]["mean"] == pytest.approx(again["mean"])


def test_trees_name_what_was_applied(spark):
    c = analytic(spark).between(2021, 2021).select("a")
    assert c.tree == ("select", ("between", ("store",)))


def test_save_appends_new_dates_only(spark, tmp_path):
    c = analytic(spark)
    path = str(tmp_path / "store")
    save_dataset(c.between(None, c.dates[4]), path)
    save_dataset(c, path)
    save_dataset(c, path)
    stored = open_dataset(spark, path).rows()
    assert stored.count() == 10 * 2 * 6 and stored.select("date").distinct().count() == 10


def test_filters_reach_the_scan(spark, tmp_path):
    c = analytic(spark)
    path = str(tmp_path / "plain")
    c.rows().write.parquet(path)
    view = open_dataset(spark, path, start="2021-01-03", end="2021-01-05", select=["a"])
    plan = view.rows()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date)" in plan and "a:double>" in plan and "b:double" not in plan
    assert view.rows().count() == 3 * 12


def test_greedy_thinning_matches_brute_force(spark):
    import math

    points = [(k, -60 + (k * 37 % 120), (k * 71) % 360) for k in range(60)]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, a, b in points], "cell int, latitude double, longitude double")
    from stratoframe.functions.geo import chord_of_km
    from stratoframe.operators.cube import thinned

    def xyz(a, b):
        a, b = math.radians(a), math.radians(b)
        return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)

    kept = []
    for k, a, b in points:
        if all(math.dist(xyz(a, b), xyz(*points[j][1:])) > chord_of_km(1500) for j in kept):
            kept.append(k)
    assert sorted(r["cell"] for r in thinned(df, 1500.0, "distance-based", "cell").collect()) == kept


def test_nearest_matches_brute_force(spark):
    import math

    a = [(k, -80 + (k * 53 % 160), (k * 97) % 360) for k in range(40)]
    b = [(k, -85 + (k * 29 % 170), (k * 61) % 360) for k in range(70)]
    make = lambda rows: spark.createDataFrame([(k, float(x), float(y)) for k, x, y in rows], "cell int, latitude double, longitude double")

    def xyz(x, y):
        x, y = math.radians(x), math.radians(y)
        return math.cos(x) * math.cos(y), math.cos(x) * math.sin(y), math.sin(x)

    got = {(r["target"], r["rank"]): r["distance"] for r in series.nearest(make(a), make(b), 3).collect()}
    for k, x, y in a:
        best = sorted(math.dist(xyz(x, y), xyz(*p[1:])) for p in b)[:3]
        assert [got[(k, r)] for r in (1, 2, 3)] == pytest.approx(best)


@pytest.mark.parametrize("limit", [None, 9000.0])
def test_nearest_of_a_limited_area(spark, limit):
    """Targets all over the globe, far from all sources; the distance to all of them would be many pairs."""
    a = [(k, -85 + (k * 53 % 170), (k * 97) % 360) for k in range(60)]
    b = [(k, 45 + (k % 30) * 0.1, 10 + (k // 30) * 0.1) for k in range(900)]
    make = lambda rows: spark.createDataFrame([(k, float(x), float(y)) for k, x, y in rows], "cell int, latitude double, longitude double")
    got = {(r["target"], r["rank"]): r["distance"] for r in series.nearest(make(a), make(b), 3, limit).collect()}
    expected = {}
    for k, x, y in a:
        for r, far in enumerate(sorted(np.linalg.norm(_at(x, y) - _at(*p[1:])) for p in b)[:3], 1):
            if limit is None or far <= 2 * math.sin(limit / 6371.0 / 2):
                expected[k, r] = far
    assert got == pytest.approx(expected)


def test_covers():
    base = datetime(2021, 1, 1)
    hourly = [derived.Interval(base + timedelta(hours=h), base + timedelta(hours=h + 1), base) for h in range(12)]
    found = derived.cover(base + timedelta(hours=2), base + timedelta(hours=5), lambda _: hourly)
    assert [i.sign for i in found] == [1, 1, 1]
    from_zero = [derived.Interval(base, base + timedelta(hours=h), base) for h in range(1, 13)]
    found = derived.cover(base + timedelta(hours=6), base + timedelta(hours=12), lambda _: from_zero)
    assert [(i.sign, i.end.hour) for i in found] == [(-1, 6), (1, 12)]
    with pytest.raises(ValueError):
        derived.cover(base, base + timedelta(hours=30), lambda _: hourly)
    other = [derived.Interval(base + timedelta(hours=3), base + timedelta(hours=9), base - DAY)]
    found = derived.cover(base + timedelta(hours=3), base + timedelta(hours=9), lambda _: [*hourly, *other])
    assert len({i.base for i in found}) == 1 and sum(((i.end - i.start) * i.sign for i in found), timedelta(0)) == timedelta(hours=6)
    found = derived.cover(base + timedelta(hours=3), base + timedelta(hours=13), lambda _: [*hourly, *other, derived.Interval(base + timedelta(hours=9), base + timedelta(hours=13), base - DAY)])
    assert [i.base for i in found] == [base - DAY] * 2  # one base is cheaper than a change
    assert len(derived.available([(0, [(0, 6)]), (12, [(0, 6)])], base)) == 6
    assert list(derived.requests([base, base + DAY], [6], stream="oper", **{"class": "od"}))[0]["stream"] == "scda"


def test_archived_covers_reach_the_target():
    target = datetime(2021, 1, 2, 6)
    for key, period in ((("ea", "oper"), 6), (("ea", "enda"), 12), (("od", "oper"), 6), (("od", "elda"), 3), (("l5", "oper"), 5), (("rr", "se-al-ec"), 3), (("rr", "fr-ms-ec"), 3)):
        target = datetime(2021, 1, 2, 7 if key[1] == "fr-ms-ec" else 6)
        found = derived.archived(target, timedelta(hours=period), key)
        assert sum(((i.end - i.start) * i.sign for i in found), timedelta(0)) == timedelta(hours=period)
        assert len({i.base for i in found}) == 1


def test_accumulations_must_be_complete(spark):
    base = datetime(2021, 1, 1)
    fields = spark.createDataFrame([(base, base + timedelta(hours=6), base, 1.0)], "start timestamp_ntz, end timestamp_ntz, base timestamp_ntz, v double").withColumn("cell", F.lit(0))
    plan = [(base + timedelta(hours=12), derived.forecast_cover(base, base + timedelta(hours=6), base + timedelta(hours=12)))]
    with pytest.raises(Exception, match="incomplete accumulation"):
        derived.accumulate(fields, plan, ["cell"], ["v"]).collect()


@pytest.mark.parametrize("window", ["(-3h,0h]", "[-3h,0h)", "[-2h,+2h]", "(-5h,+1h)"])
def test_windows_conserve_rows(spark, window):
    from stratoframe.functions.timegrammar import Window

    rows = [(datetime(2021, 1, 1) + timedelta(seconds=600 * k), 0.0, 0.0, float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, latitude double, longitude double, v double")
    obs = Observations.of(df, window=window, frequency="3h")
    w = Window.parse(window)
    expected = set()
    for i in range(len(obs)):
        ref = obs.start + i * timedelta(hours=3)
        lo, hi = ref + timedelta(seconds=w.start), ref + timedelta(seconds=w.end)
        expected |= {(i, t) for t, *_ in rows if (lo <= t if w.start_closed else lo < t) and (t <= hi if w.end_closed else t < hi)}
    assert {(r["sample"], r["ts"]) for r in obs.samples().collect()} == expected
    assert {r["sample"]: r["n"] for r in obs.counts().collect()} == {i: sum(1 for s, _ in expected if s == i) for i in range(len(obs))}
    plan = obs.samples()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_pivot_refuses_repeats(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "k int, c string, v double")
    with pytest.raises(Exception, match="repeated v"):
        pivot(df, ["c"], ["v"], ["a"]).collect()


def test_inspection(spark):
    from stratoframe.plans import inspect

    c = analytic(spark)
    assert inspect.problems(c).count() == 0
    assert inspect.tree(combine.join([c.select("a"), c.select("b")])).split() == ["join", "select", "store", "select", "store"]
    assert inspect.header(c)["shape"] == (10, 2, 2, 6)
    assert c.to_index(c.dates[3], "b", 1) == (3, 1, 1)


def test_stream_reads_a_folder(spark, tmp_path):
    from stratoframe.streaming import windows

    base = datetime(2021, 1, 1)
    rows = [(base + timedelta(minutes=20 * k), float(k)) for k in range(40)]
    spark.createDataFrame(rows + rows[:5], "ts timestamp_ntz, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, v double").parquet(str(tmp_path / "in"))
    found = windows.window_counts(windows.without_repeats(stream, "1 day"), "3 hours", "3 hours", "1 day", values=("v",))
    q = found.writeStream.outputMode("append").format("memory").queryName("stream_counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stream_counts").columns == ["start", "end", "n", "v"]
    out = str(tmp_path / "out")
    write = windows.append_once(out)
    batch = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(out).count() == 40
    write(spark.createDataFrame([(base, -1.0)], "ts timestamp_ntz, v double"), 1)  # a late row of a stored time
    assert spark.read.parquet(out).count() == 41 and spark.read.parquet(out).filter("v = -1").first()["ts"] == base


def test_positional_combinations(spark):
    c = analytic(spark)
    got = open_dataset(spark, x={"dataset": c, "select": "a"}, y={"dataset": c, "select": ["b"]}, start="2021-01-03", end="2021-01-05")
    assert got.columns == ["date_idx", "member", "cell", "x", "y"] and got.count() == 3 * 2 * 6
    assert {(r["x"]["a"], r["y"]["b"]) for r in got.filter("date_idx = 0 and member = 1 and cell = 0").collect()} == {(201.0, 211.0)}
    with pytest.raises(ValueError):
        open_dataset(spark, zip=[c, c.every("2d")])
    assert open_dataset(spark, zip=[c, c.every("2d")], check_compatibility=False).count() == 5 * 2 * 6


def test_synthetic_datasets(spark):
    spec = {"start": "2021-01-01", "end": "2021-01-02", "frequency": "6h", "geography": {"area": (10, 0, 0, 20), "resolution": 5}, "members": 2, "variables": {"one": 1, "two": {"constant": 2}, "noise": {"random": {"mean": 5, "stdev": 2}}, "cos_latitude": "cos_latitude"}}
    c = open_dataset(spark, synthetic=spec, select=["noise", "two", "cos_latitude"])
    assert c.shape == (5, 3, 2, 15) and c.field_shape == (3, 5) and c.df.count() == 5 * 2 * 15
    assert c.rows().orderBy("date", "member", "cell").collect() == open_dataset(spark, synthetic=spec).select(["noise", "two", "cos_latitude"]).rows().repartition(7).orderBy("date", "member", "cell").collect()
    found = statistics.collected(statistics.statistics(open_dataset(spark, synthetic=spec | {"geography": 2000, "variables": ["noise"]})))
    assert abs(found["noise"]["mean"]) < 0.05 and abs(found["noise"]["stdev"] - 1) < 0.05


def test_layouts_of_stored_tables(spark, tmp_path):
    hour = "timestamp_ntz'2021-01-01' + make_dt_interval(0, cast({} as int))"
    spark.range(48).selectExpr(f"{hour.format('id')} AS ts", "double(id) AS latitude", "0D AS longitude", "double(id) AS v", "1D AS w").write.parquet(str(tmp_path / "obs"))
    spark.range(4 * 3).selectExpr(f"{hour.format('floor(id / 3) * 6')} AS base_date", "int(id % 3 + 1) * 21600 AS step_s", "0 AS member", "0 AS cell", "double(id) AS v", "1D AS w").write.parquet(str(tmp_path / "forecast"))
    add_dataset_path(str(tmp_path))
    o = open_dataset(spark, "obs", window="(-6,0]", frequency="6h", start="2021-01-01T06:00:00", end="2021-01-01", drop="w", area=(20, 0, 0, 10))
    assert o.variables == ("v",) and {(r["sample"], r["n"]) for r in o.counts().collect()} == {(0, 6), (1, 6), (2, 6)}
    t = open_dataset(spark, "forecast", base_start="2021-01-01T06:00:00", drop="w")
    assert len(t.base_dates) == 3 and len(t.steps) == 3
    c = open_dataset(spark, "forecast", steps=[6, 12], step=12, select="v")
    assert isinstance(c, Cube) and c.start == datetime(2021, 1, 1, 12) and [r["v"] for r in c.rows().orderBy("date").collect()] == [1.0, 4.0, 7.0, 10.0]
    with pytest.raises(ValueError):
        open_dataset(spark, "forecast", frequency="12h")
    with pytest.raises(NotImplementedError):
        open_dataset(spark, "obs", rolling_average=(-1, 1, "freq"))
    with pytest.raises(FileNotFoundError):
        open_dataset(spark, "nothing")


def test_recipes_resume(spark, tmp_path):
    c = analytic(spark, days=60)
    add_named_dataset("days", c)
    path = str(tmp_path / "built")
    spec = {"dates": {"start": "2021-01-01", "end": "2021-02-28", "frequency": "1d", "missing": ["2021-01-05"]}, "input": {"join": [{"dataset": {"dataset": "days", "select": "a"}}, {"dataset": {"dataset": "days", "select": "b"}}]}}
    assert recipe.load(spark, spec, path, "2/2") == [1]
    with pytest.raises(ValueError):
        recipe.finalise(spark, spec, path)
    assert recipe.load(spark, spec, path) == [0] and recipe.load(spark, spec, path) == []
    assert spark.read.parquet(f"{path}/data").count() == 58 * 2 * 6
    assert {r["variable"]: r["count"] for r in recipe.finalise(spark, spec, path).collect()} == {"a": 58 * 12, "b": 58 * 12}
    assert recipe.problems({"dates": {}, "input": {"pipe": [{"concat": [{"nosuch": {}}]}, {"nofilter": {}}]}}) == ["input/pipe[0]/concat[0]: no dates", "input/pipe[0]/concat[0]: unknown source 'nosuch'", "input/pipe: unknown filter 'nofilter'"]


def test_recipe_nodes(spark):
    c = analytic(spark, days=40)
    add_named_dataset("days", c)
    days = {"dataset": {"dataset": "days", "select": "a"}}
    at = [datetime(2021, 3, 1), datetime(2021, 3, 2)]
    near = recipe.build(spark, {"repeated_dates": {"mode": "closest", "source": days, "dates": {"start": "2021-01-01", "end": "2021-02-09", "frequency": "1d"}}}, at)
    assert {(r["date"], r["a"]) for r in near.filter("member = 0 and cell = 0").collect()} == {(d, 3900.0) for d in at}
    same = recipe.build(spark, {"repeated_dates": {"mode": "climatology", "source": days, "year": 2021, "day": 3}}, [datetime(2030, 2, 17)])
    assert same.filter("member = 0 and cell = 0").first()["a"] == 3300.0
    moved = recipe.build(spark, {"recentre": {"members": days, "centre": days, "alpha": 2.0}}, c.dates[:2])
    assert {r["a"] for r in moved.filter("cell = 0").collect()} == {-1.0, 1.0, 99.0, 101.0}
    assert [str(d.date()) for d in recipe.dates_of({"start": "2021-01-01", "end": "2021-03-31", "frequency": "1d", "pattern": "????-??-01"})[0]] == ["2021-01-01", "2021-02-01", "2021-03-01"]
    assert recipe.dates_of({"hindcasts": {"reference": ["2024-03-01"], "years": 2, "steps": "0/to/24/by/24"}})[0] == [datetime(y, 3, d) for y in (2022, 2023) for d in (1, 2)]


def test_recipes_accumulate(spark):
    """Hourly pieces of an archive's forecasts, each of one unit, sum to the period's hours."""

    def pieces(spark, dates):
        rows = [(str(b + s * timedelta(hours=1)), str(b + (s + 1) * timedelta(hours=1)), str(b)) for b in dates for s in range(18)]
        df = spark.createDataFrame(rows, "s string, e string, b string")
        return df.select(*[F.col(x).cast("timestamp_ntz").alias(n) for x, n in (("s", "start"), ("e", "end"), ("b", "base"))], F.lit(0).alias("member"), F.lit(3).alias("cell"), F.lit(1.0).alias("tp"))

    SOURCES["pieces"] = pieces
    spec = {"accumulate": {"source": {"pieces": {}}, "period": "12h", "archive": ("ea", "oper"), "values": ["tp"]}}
    at = [datetime(2021, 1, 1), datetime(2021, 1, 1, 12)]
    assert {(r["date"], r["tp"]) for r in recipe.build(spark, spec, at).collect()} == {(d, 12.0) for d in at}


def test_origins_of_variables(spark, tmp_path):
    c = analytic(spark).with_("plain", grid=None, field_shape=None)
    path = str(tmp_path / "kept")
    c.rows().write.parquet(path)
    opened = open_dataset(spark, join=[{"dataset": path, "select": "a", "rename": {"a": "x"}}, {"dataset": c, "select": "b"}], rename={"b": "y"})
    assert opened.origin("x") == (path, "a") and opened.origin("y") == ("store", "b")
    overlaid = combine.join([c.select("a"), open_dataset(spark, path)])
    assert overlaid.origin("a") == (path, "a")
    with pytest.raises(ValueError):
        opened.origin("a")


def test_samples_of_a_slice(spark):
    rows = [(datetime(2021, 1, 1) + timedelta(hours=k), 0.0, 0.0, float(k)) for k in range(40)]
    obs = Observations.of(spark.createDataFrame(rows, "ts timestamp_ntz, latitude double, longitude double, v double"), window="(-3h,0h]", frequency="3h")
    part = obs.samples_of(slice(-3, None))
    assert len(part) == 3 and part.start == obs.start + (len(obs) - 3) * timedelta(hours=3)
    ordered = [r["v"] for r in part.samples().orderBy("sample", "ts").collect()]
    for r in part.boundaries().collect():
        assert ordered[r["first"] : r["last"]] == [x["v"] for x in obs.sample(len(obs) - 3 + r["sample"]).collect()]
    for bad in (slice(0, 9, 2), slice(5, 5)):
        with pytest.raises(IndexError):
            obs.samples_of(bad)


def test_overlaps_are_compared(spark):
    c = analytic(spark)
    got = {(r["variable"], r["statistic"]): (r["whole"], r["area"], r["percent"]) for r in statistics.overlap_differences(c, c.between(c.dates[0], c.dates[1]).area(0, 0, -20, 45).rescale({"a": (2, 0)})).collect()}
    assert got["a", "maximum"][2] == 50.0 and got["b", "mean"][2] == 0.0 and got["a", "minimum"] == (0.0, 0.0, None)
    assert statistics.spacing_km(c) == pytest.approx(math.sqrt(6371.0**2 * (math.sin(math.radians(30)) + math.sin(math.radians(20))) * math.radians(75) / 6))


def test_small_changes_of_large_values_are_different(spark):
    c = analytic(spark).select("a").rescale({"a": (1, 546000)})
    changed = c.with_("changed", df=c.df.withColumn("a", F.col("a") + F.when(F.col("cell") == 1, 1.0).otherwise(0.0)))
    assert [tuple(r) for r in statistics.compare(c, changed).collect()] == [("a", 120, 20, 1.0)]
    assert [tuple(r) for r in statistics.compare(c, c).collect()] == [("a", 120, 0, 0.0)]
    assert statistics.compare(c, changed, relative=1e-5).first()["different"] == 0
    assert statistics.compare(c, changed, absolute=0.5).first()["different"] == 20


@pytest.mark.parametrize("tolerances", [{}, {"absolute": 1e-6, "relative": 1e-5}])
@pytest.mark.parametrize(
    ("x", "y", "different", "largest"),
    [("inf", "inf", 0, 0.0), ("-inf", "inf", 1, math.inf), ("1", "inf", 1, math.inf), ("inf", "1", 1, math.inf), ("nan", "nan", 0, None), ("nan", "inf", 1, None), ("2", "nan", 1, None), ("0", "-0", 0, 0.0)],
)
def test_values_that_are_not_numbers_are_compared(spark, x, y, different, largest, tolerances):
    c = analytic(spark, 1, ("a",), 1, 1)
    one, other = (c.with_("value", df=c.df.withColumn("a", F.lit(float(v)))) for v in (x, y))
    assert [tuple(r) for r in statistics.compare(one, other, **tolerances).collect()] == [("a", 1, different, largest)]


def test_requests_are_tables(spark):
    at = [datetime(2024, 3, 1), datetime(2024, 3, 1, 6)]
    rows = lambda df: [r.asDict() for r in df.collect()]
    assert rows(SOURCES["fdb"](spark, at, {"param": ["2t", "tp"]})) == [{"step": "0", "param": "2t/tp", "date": "20240301", "time": t} for t in ("0000", "0600")]
    assert [(r["date"], r["time"], r["step"]) for r in rows(SOURCES["fdb"](spark, at, {"param": "2t"}, offset_from_date=True))] == [("20240301", "0000", "0"), ("20240301", "0000", "6")]
    assert [(r["date"], r["time"], r["step"]) for r in rows(SOURCES["fdb"](spark, at, {"param": "2t"}, True, True))] == [("20240229", "0000", "24"), ("20240301", "0000", "6")]
    found = rows(SOURCES["hindcasts"](spark, [datetime(2023, 3, 2), datetime(2022, 3, 1), datetime(2000, 1, 1)], [datetime(2024, 3, 1)], 2, "0/to/24/by/24", param="2t"))
    assert [(r["hdate"], r["date"], r["step"], r["param"]) for r in found] == [("20230301", "20240301", "24", "2t"), ("20220301", "20240301", "0", "2t")]
    assert rows(SOURCES["mars"](spark, at, "0/6", stream="enfo"))[0]["stream"] == "enfo"
    assert SOURCES["fdb"](spark, [], {}).count() == 0


def test_message_indices(spark):
    from stratoframe.sources.registry import FILTERS, add_messages

    at = datetime(2021, 1, 1)
    first = spark.createDataFrame([(at, "f", 0, 10, "a")], "valid_datetime timestamp_ntz, path string, offset long, length int, param string")
    more = spark.createDataFrame([(at, "f", 0, 10, "a", 5), (at, "f", 10, 10, "b", 5), (at, "f", 10, 10, "b", 5)], "valid_datetime timestamp_ntz, path string, offset long, length int, param string, level int")
    index = add_messages(first, more)
    assert sorted((r["offset"], r["level"]) for r in index.collect()) == [(0, None), (10, 5)]
    assert [r["param"] for r in SOURCES["grib-index"](spark, [at], index, level="5").collect()] == ["b"]
    with pytest.warns(UserWarning, match="no key"):
        assert SOURCES["grib-index"](spark, [at], index, nothing=1).count() == 2
    assert {r["variable"] for r in FILTERS["variable_names"](index, "{param}-{level}m").collect()} == {"am", "b-5m"}


def test_trajectories_by_position(spark):
    from stratoframe.operators.trajectories import Trajectories

    start = datetime(2021, 1, 1)
    rows = [(start + k * DAY, 3600 * s, 0, c, float(k * 100 + s * 10 + c)) for k in range(5) for s in (6, 12) for c in range(2)]
    df = spark.createDataFrame(rows, "base_date timestamp_ntz, step_s int, member int, cell int, v double")
    t = Trajectories(df, ("v",), start, start + 4 * DAY, DAY, (timedelta(hours=6), timedelta(hours=12)), 1, 2).set_missing([2])
    assert sorted(r["v"] for r in t.at(-1).collect()) == [460.0, 461.0, 520.0, 521.0] and t.at(slice(3, None)).count() == 8
    for bad in (2, slice(1, 4)):
        with pytest.raises(MissingDateError):
            t.at(bad)
    with pytest.raises(IndexError):
        t.at(5)
    assert t.rows().count() == 16


def test_path_patterns():
    from stratoframe.sources.registry import paths_of

    days = [datetime(2021, 1, k) for k in (1, 2)]
    assert paths_of("a/{date:%Y%m}/{param}-{level}.parquet", days, param=["t", "q"], level=500) == ["a/202101/t-500.parquet", "a/202101/q-500.parquet"]
    assert paths_of("a/{date}/*.parquet", days) == ["a/2021-01-01/*.parquet", "a/2021-01-02/*.parquet"]
    with pytest.raises(ValueError, match="param"):
        paths_of("a/{date}", days, param="t")


def test_variables_with_holes_of_their_own(spark):
    """Variables that lack other cells are filled from other neighbours; those that lack the same share a search."""
    c = analytic(spark, days=3, variables=("a", "b", "c"))
    gone = lambda v, cells: F.when(F.col("cell").isin(cells), float("nan")).otherwise(F.col(v))
    holes = c.with_("holes", df=c.df.withColumns({"a": gone("a", [0, 1]), "b": gone("b", [0, 1]), "c": gone("c", [5])}))
    got = table(series.interpolate_nearest_cells(holes, ["a", "b", "c"]).rows(), "a", "b", "c")
    whole = table(c.rows(), "a", "b", "c")
    for (d, m, x), (a, b, z) in got.items():
        assert (a, b) == whole[d, m, max(x, 2)][:2] and z == whole[d, m, min(x, 4)][2]


def test_boundaries_over_buckets(spark):
    rows = [(datetime(2021, 1, 1) + timedelta(seconds=s), 0.0, 0.0, 1.0) for s in (0, 1, 1, 99_999, 100_000, 100_001, 150_000)]
    o = Observations.of(spark.createDataFrame(rows, "ts timestamp_ntz, latitude double, longitude double, v double"), window="(-1s,0]", frequency=timedelta(seconds=1))
    got = {r["sample"]: (r["first"], r["last"]) for r in o.boundaries().filter("last > first").collect()}
    assert got == {0: (0, 1), 1: (1, 3), 99_999: (3, 4), 100_000: (4, 5), 100_001: (5, 6), 150_000: (6, 7)}
