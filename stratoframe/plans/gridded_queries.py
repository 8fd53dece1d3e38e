"""Queries over the gridded fixture, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.operators import combine, series, statistics
from stratoframe.operators.cube import Cube, thinned
from stratoframe.plans import inspect, recipe
from stratoframe.plans.dataset import new_dates, open_dataset
from stratoframe.plans.fixtures import MISSING, cube, grid
from stratoframe.sources.registry import SOURCES

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
V = "q, p, d, x"
KV = "date, member, cell, q, p, d, x"
STATS = "round(avg({v}), 4) AS mean, round(stddev_pop({v}), 4) AS stdev, min({v}) AS minimum, max({v}) AS maximum, count({v}) AS count"


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = (f, sql)
        return f

    return register


def on_cube(name: str, sql: str | None, f: Callable[[Cube], Cube | DataFrame]) -> None:
    """A query of the cube alone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(cube(spark, sf_dir))
        return out.rows() if isinstance(out, Cube) else out

    QUERIES[name] = (run, sql)


def rounded(df: DataFrame, digits: int = 6, names: tuple[str, ...] = ("q", "p", "d", "x")) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names if n in df.columns})


def stats(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.round(k, 4) for k in ("mean", "stdev")})


def stats_sql(table: str, names: tuple[str, ...] = ("q", "p", "d", "x"), more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS variable, {STATS.format(v=v)}{more} FROM {table}" for v in names)


on_cube("scan_cube_wide", f"SELECT {KV} FROM cube", lambda c: c)
on_cube("scan_cube_long", "SELECT date, member, cell, variable, value FROM cube UNPIVOT (value FOR variable IN (q, p, d, x))", lambda c: c.long())
on_cube("packed_fields", None, lambda c: c.packed())
on_cube("subset_start_end", f"SELECT {KV} FROM cube WHERE date >= '1996-01-01' AND date < '1999-01-01'", lambda c: c.between(1996, 1998))
on_cube("subset_year_string", f"SELECT {KV} FROM cube WHERE date >= '1997-03-01' AND date < '1999-06-16'", lambda c: c.between("1997-03", "1999-06-15"))
on_cube("subset_percent", f"SELECT {KV} FROM c, n WHERE i >= floor(n * 0.25 - pow(2, -30)) AND i <= floor(n * 0.75 + pow(2, -30)) - 1", lambda c: c.between("25%", "75%"))
on_cube("subset_frequency", f"SELECT {KV} FROM c WHERE i % 2 = 0", lambda c: c.every("60d"))
on_cube("subset_then_frequency", f"SELECT {KV} FROM (SELECT *, dense_rank() OVER (ORDER BY date) - 1 AS j FROM cube WHERE date >= '1996-01-01') WHERE j % 3 = 0", lambda c: c.between(1996, None).every("90d"))
on_cube("positional_index", "SELECT date, member, cell, p, x FROM c WHERE i IN (3, 7) AND member = 1 AND cell < 4", lambda c: c.at(([3, 7], slice(1, None, 2), 1, slice(0, 4))).drop("position"))
on_cube("positional_repeats", "SELECT t.k AS position, date, member, cell, q, p, d, x FROM c JOIN (VALUES (0, 7), (1, 3), (2, 3)) t(k, i) USING (i) WHERE cell >= 2", lambda c: c.at(([7, 3, 3], slice(None), slice(None), slice(2, None))))
on_cube("select_variables", "SELECT date, member, cell, x, q FROM cube", lambda c: c.select(["x", "q"]))
on_cube("drop_variables", "SELECT date, member, cell, q, x FROM cube", lambda c: c.drop(["p", "d"]))
on_cube("reorder_sort", "SELECT date, member, cell, d, p, q, x FROM cube", lambda c: c.reorder("sort"))
on_cube("rename_variables", "SELECT date, member, cell, q AS quantity, p, d, x AS tax FROM cube", lambda c: c.rename({"q": "quantity", "x": "tax"}))
on_cube("rescale_linear", "SELECT date, member, cell, q * 2.0 + 1.0 AS q, p * 0.5 + 0.0 AS p, d, x FROM cube", lambda c: c.rescale({"q": (2.0, 1.0), "p": {"scale": 0.5, "offset": 0.0}}))
on_cube("rescale_units", "SELECT date, member, cell, round(q + 273.15, 6) AS q, round(p * 0.01, 6) AS p, d, x FROM cube", lambda c: rounded(c.rescale({"q": ("degC", "K"), "p": ("Pa", "hPa")}).rows()))
on_cube(
    "shuffle_dates",
    "SELECT date, member, cell, q, p, d, x, CAST(position AS INTEGER) AS position FROM cube JOIN (SELECT date, row_number() OVER (ORDER BY md5(i || ':3'), date) - 1 AS position FROM (SELECT DISTINCT date, i FROM c)) USING (date)",
    lambda c: c.shuffled(3),
)
on_cube("member_select", "SELECT date, 0 AS member, cell, q, p, d, x FROM cube WHERE member = 1", lambda c: c.number(2, 1))
_RANKED = "SELECT date, member, CAST(dense_rank() OVER (ORDER BY cell) - 1 AS INTEGER) AS cell, q, p, d, x FROM cube JOIN (SELECT cell FROM grid WHERE {0}) USING (cell)"
on_cube("mask_cells", _RANKED.format("cell % 2 = 0"), lambda c: c.mask(c.grid.select("cell", (F.col("cell") % 2 == 0).alias("keep"))))
on_cube("area_crop", _RANKED.format("latitude BETWEEN 50 AND 60 AND longitude BETWEEN 0 AND 60"), lambda c: c.area(60, 0, 50, 60))
on_cube("area_crop_wrap", _RANKED.format("longitude >= 100 OR longitude <= 20"), lambda c: c.area(90, 100, -90, 20))
on_cube("trim_edge", _RANKED.format("col BETWEEN 1 AND 3"), lambda c: c.trim_edge(0, 0, 1, 1))
on_cube("thinning_every_nth", _RANKED.format("row % 2 = 0 AND col % 2 = 0"), lambda c: c.thin(2))
_XYZ = "cos(radians({0}latitude)) * cos(radians({0}longitude)) AS {1}x, cos(radians({0}latitude)) * sin(radians({0}longitude)) AS {1}y, sin(radians({0}latitude)) AS {1}z"
_XYZ_ROUND = "round(cos(radians(latitude)) * cos(radians(longitude)) / (2500 / 6371.0)), round(cos(radians(latitude)) * sin(radians(longitude)) / (2500 / 6371.0)), round(sin(radians(latitude)) / (2500 / 6371.0))"
on_cube("thinning_grid", _RANKED.format(f"cell IN (SELECT min(cell) FROM grid GROUP BY {_XYZ_ROUND})"), lambda c: c.thin(2500.0, "grid"))
_GREEDY = f"""(WITH RECURSIVE near AS (SELECT a.cell AS a, list(b.cell) AS before FROM (SELECT cell, {_XYZ.format("", "t")} FROM grid) a, (SELECT cell, {_XYZ.format("", "s")} FROM grid) b
    WHERE b.cell < a.cell AND sqrt(pow(tx - sx, 2) + pow(ty - sy, 2) + pow(tz - sz, 2)) <= 2 * sin(2000 / 6371.0 / 2) GROUP BY 1),
    greedy AS (SELECT 0 AS upto, [0] AS kept UNION ALL SELECT upto + 1, CASE WHEN list_has_any(kept, coalesce(before, [])) THEN kept ELSE list_append(kept, upto + 1) END FROM greedy LEFT JOIN near ON a = upto + 1 WHERE upto < 9)
    SELECT unnest(kept) FROM greedy WHERE upto = 9)"""
on_cube("thinning_distance", _RANKED.format(f"cell IN {_GREEDY}"), lambda c: c.thin(2000.0, "distance-based"))
on_cube("thinning_random", "SELECT cell, latitude, longitude, row, col FROM grid WHERE CAST('0x' || substr(md5(cell || ':1'), 1, 10) AS BIGINT) / 1099511627776 < 0.5", lambda c: thinned(c.grid, 0.5, "random", "cell", 1))

on_cube("join_variables", f"SELECT {KV} FROM cube", lambda c: combine.join([c.select(["q", "p"]), c.select(["d", "x"])]))
on_cube("join_overlay", "SELECT date, member, cell, q, p * 2.0 + 0.0 AS p, x FROM cube", lambda c: combine.join([c.select(["q", "p"]), c.select(["p", "x"]).rescale({"p": (2, 0)})]))
on_cube("concat_dates", f"SELECT {KV} FROM cube", lambda c: combine.concat([c.between(None, 1997), c.between(1998, None)]))


def gap_table(c: Cube) -> DataFrame:
    joined = combine.concat([c.between(None, 1996), c.between(1998, None)], fill_missing_gaps=True)
    rows = joined.df.groupBy("date").agg(F.count("*").alias("rows"))
    return series.date_table(joined).join(rows, "date", "left").select("i", "date", "missing", F.coalesce("rows", F.lit(0)).alias("rows"))


on_cube(
    "concat_fill_gaps",
    """SELECT i, date, date >= '1997-01-01' AND date < '1998-01-01' AS missing, CASE WHEN date >= '1997-01-01' AND date < '1998-01-01' THEN 0 ELSE coalesce(rows, 0) END AS rows
    FROM (SELECT CAST(g AS INTEGER) AS i, (SELECT min(date) FROM cube) + to_days(CAST(30 * g AS INTEGER)) AS date FROM n, range(n.n) t(g)) LEFT JOIN (SELECT date, count(*) AS rows FROM cube GROUP BY 1) USING (date)""",
    gap_table,
)
on_cube("merge_interleaved", f"SELECT {KV} FROM cube", lambda c: combine.merge([c.between(c.dates[0], c.dates[-2 if len(c.dates) % 2 == 0 else -1]).every("60d"), c.between(c.dates[1], None).every("60d")]))
on_cube(
    "merge_missing_priority",
    f"SELECT date, member, cell, CASE WHEN i IN (5, 6) THEN q * 1.0 + 1000.0 ELSE q END AS q, p, d, x FROM c WHERE i <> {MISSING[2]}",
    lambda c: combine.merge([c.set_missing(MISSING), c.between(c.dates[5], c.dates[6]).rescale({"q": (1, 1000)})]),
)
on_cube("ensemble_concat", f"SELECT {KV} FROM cube UNION ALL SELECT date, member + 2, cell, q * 2.0 + 0.0, p, d, x FROM cube", lambda c: combine.ensemble([c, c.rescale({"q": (2, 0)})]))
on_cube("grids_concat", f"SELECT {KV} FROM cube UNION ALL SELECT date, member, cell + 10, q * 2.0 + 0.0, p, d, x FROM cube", lambda c: combine.grids([c, c.rescale({"q": (2, 0)})]))
on_cube(
    "cutout_global",
    """SELECT date, member, CAST(list_position([0, 1, 2, 5, 6, 7], cell) - 1 AS INTEGER) AS cell, q * 3.0 + 0.0 AS q, p, d, x FROM cube WHERE cell IN (0, 1, 2, 5, 6, 7)
    UNION ALL SELECT date, member, CAST(6 + list_position([3, 4, 8, 9], cell) - 1 AS INTEGER), q, p, d, x FROM cube WHERE cell IN (3, 4, 8, 9)""",
    lambda c: combine.cutout([c.area(60, 0, 50, 60).rescale({"q": (3, 0)}), c]),
)
on_cube(
    "cutout_triangles",
    f"""SELECT date, member, cell, q, p, d, x FROM cube
    UNION ALL SELECT date, member, CAST(10 + dense_rank() OVER (ORDER BY cell) - 1 AS INTEGER), q * 2.0 + 0.0, p, d, x FROM cube WHERE cell NOT IN (0, 1, 2, 3)""",
    lambda c: combine.cutout([c, c.with_("grid", grid=grid(c.df.sparkSession, 58.0, 3.0)).rescale({"q": (2, 0)})], min_distance_km=10.0),
)
on_cube("complement_none", "SELECT date, member, cell, d, p, q FROM cube", lambda c: combine.complement(c.select(["q", "p"]), c.select(["p", "d"])))


def near_complement(k: int) -> Callable[[Cube], DataFrame]:
    def f(c: Cube) -> DataFrame:
        target = c.select(["q"]).with_("grid", grid=grid(c.df.sparkSession, 58.0, 3.0))
        return rounded(combine.complement(target, c.select(["d"]), "nearest", k).rows())

    return f


_NEAR = f"""SELECT cube.date, cube.member, cube.cell, q, round(s.d, 6) AS d FROM cube JOIN (
    SELECT date, member, target AS cell, sum(d * w) AS d FROM cube JOIN (
      SELECT target, cell, (1 / (dist + 1e-8)) / sum(1 / (dist + 1e-8)) OVER (PARTITION BY target) AS w FROM (
        SELECT target, cell, dist, row_number() OVER (PARTITION BY target ORDER BY dist, cell) AS r FROM (
          SELECT a.cell AS target, b.cell, sqrt(pow(a.tx - b.sx, 2) + pow(a.ty - b.sy, 2) + pow(a.tz - b.sz, 2)) AS dist
          FROM (SELECT cell, {_XYZ.format("", "t")} FROM (SELECT cell, latitude - 2 AS latitude, longitude + 3 AS longitude FROM grid)) a CROSS JOIN (SELECT cell, {_XYZ.format("", "s")} FROM grid) b)) WHERE r <= {{0}}) USING (cell)
    GROUP BY 1, 2, 3) s ON cube.date = s.date AND cube.member = s.member AND cube.cell = s.cell"""
on_cube("complement_nearest_k1", _NEAR.format(1), near_complement(1))
on_cube("complement_nearest_k3", _NEAR.format(3), near_complement(3))
on_cube(
    "zip_xy",
    "SELECT a.i AS date_idx, a.member, a.cell, a.q AS x_q, b.d AS y_d FROM c a JOIN c b ON a.i = b.i AND a.member = b.member AND a.cell = b.cell",
    lambda c: combine.zipped([c.select("q"), c.select("d")]).select("date_idx", "member", "cell", F.col("x0.q").alias("x_q"), F.col("x1.d").alias("y_d")),
)
on_cube("chain_rows", "SELECT 0 AS dataset, i AS position, date, member, cell, q FROM c UNION ALL SELECT 1, i + n.n, date, member, cell, q FROM c, n", lambda c: combine.chain([c.select("q"), c.select("q")]))
on_cube(
    "adjust_all",
    "SELECT date, member, cell, d, p FROM c WHERE i BETWEEN 12 AND 48 AND i % 2 = 0",
    lambda c: combine.join(combine.adjusted([c.between(c.dates[12], c.dates[48]).every("60d").select(["q", "p", "d"]), c.select(["d", "p", "x"])], "all")).reorder("sort"),
)
on_cube("missing_flagged", f"SELECT {KV} FROM c WHERE i NOT IN {MISSING}", lambda c: c.set_missing(MISSING))
on_cube(
    "missing_skip_pairs",
    f'SELECT s.i AS sample, CAST(o AS INTEGER) AS "offset", c.date, c.member, c.cell, q, p, d, x FROM (SELECT CAST(g AS INTEGER) AS i FROM n, range(n.n - 1) t(g)) s, range(2) t(o), c WHERE c.i = s.i + o AND s.i NOT IN {MISSING} AND s.i + 1 NOT IN {MISSING}',
    lambda c: c.set_missing(MISSING).skip_missing(2),
)
_FILL = "SELECT date, member, cell, q, p, d, x FROM c WHERE i NOT IN (5, 6, 40) UNION ALL SELECT (SELECT min(date) FROM cube) + to_days(30 * t), member, cell, q, p, d, x FROM c JOIN (VALUES {0}) v(t, s) ON i = s"
on_cube("fill_missing_closest_up", _FILL.format("(5, 4), (6, 7), (40, 41)"), lambda c: series.fill_missing(c.set_missing(MISSING)))
on_cube("fill_missing_closest_down", _FILL.format("(5, 4), (6, 7), (40, 39)"), lambda c: series.fill_missing(c.set_missing(MISSING), "closest", "down"))
on_cube(
    "fill_missing_interpolate",
    """SELECT date, member, cell, q, p, d, x FROM c WHERE i NOT IN (5, 6, 40) UNION ALL
    SELECT (SELECT min(date) FROM cube) + to_days(30 * t), member, cell, round(sum(q * w), 6), round(sum(p * w), 6), round(sum(d * w), 6), round(sum(x * w), 6)
    FROM c JOIN (VALUES (5, 4, 2.0::DOUBLE / 3), (5, 7, 1.0::DOUBLE / 3), (6, 4, 1.0::DOUBLE / 3), (6, 7, 2.0::DOUBLE / 3), (40, 39, 0.5::DOUBLE), (40, 41, 0.5::DOUBLE)) v(t, s, w) ON i = s GROUP BY 1, 2, 3""",
    lambda c: rounded(series.fill_missing(c.set_missing(MISSING), "interpolate").rows()),
)
on_cube(
    "interpolate_frequency",
    """SELECT date, member, cell, q, p FROM c UNION ALL
    SELECT date + INTERVAL 15 DAY, member, cell, (q + q2) / 2, (p + p2) / 2 FROM (SELECT *, lead(q) OVER w AS q2, lead(p) OVER w AS p2, lead(date) OVER w AS until FROM c WINDOW w AS (PARTITION BY member, cell ORDER BY date)) WHERE until = date + INTERVAL 30 DAY""",
    lambda c: series.interpolate_frequency(c.select(["q", "p"]), "15d"),
)


def holes(c: Cube) -> Cube:
    """q has no value in cells 3 and 7 on the first date."""
    return c.select(["q"]).with_("holes", df=c.df.select("date", "member", "cell", F.when(F.col("cell").isin(3, 7) & (F.col("date") == F.lit(str(c.start)).cast("timestamp_ntz")), float("nan")).otherwise(F.col("q")).alias("q")))


on_cube(
    "interpolate_nearest_cells",
    f"""SELECT k.date, k.member, k.cell, v.q FROM cube k LEFT JOIN (SELECT c.date, c.member, near.cell, CASE WHEN i = 0 AND c.cell IN (3, 7) THEN 'nan'::DOUBLE ELSE q END AS q FROM c JOIN (
      SELECT a.cell, b.cell AS source, row_number() OVER (PARTITION BY a.cell ORDER BY sqrt(pow(a.tx - b.sx, 2) + pow(a.ty - b.sy, 2) + pow(a.tz - b.sz, 2)), b.cell) AS r
      FROM (SELECT cell, {_XYZ.format("", "t")} FROM grid) a, (SELECT cell, {_XYZ.format("", "s")} FROM grid WHERE cell IN (SELECT cell FROM c WHERE i = 0 AND cell NOT IN (3, 7))) b) near ON near.source = c.cell AND r = 1) v ON k.date = v.date AND k.member = v.member AND k.cell = v.cell""",
    lambda c: series.interpolate_nearest_cells(holes(c), ["q"]),
)
_ROLL = "SELECT date, member, cell, round(avg(q) OVER w, 6) AS q, round(avg(p) OVER w, 6) AS p, i FROM c WINDOW w AS (PARTITION BY member, cell ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
on_cube("rolling_average", f"SELECT r.* EXCLUDE (i) FROM ({_ROLL}) r, n WHERE i BETWEEN 1 AND n.n - 2", lambda c: rounded(series.rolling_average(c.select(["q", "p"]), -1, 1).rows()))
on_cube(
    "rolling_trailing_max",
    "SELECT date, member, cell, CASE WHEN count(q) OVER w = 3 THEN max(q) OVER w END AS q, p FROM c WINDOW w AS (PARTITION BY member, cell ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)",
    lambda c: series.rolling_operation(c.select(["q", "p"]), 3, "max", ["q"]),
)
on_cube("tendencies_lag", "SELECT a.date, a.member, a.cell, a.q - b.q AS q FROM c a JOIN c b ON a.member = b.member AND a.cell = b.cell AND a.i = b.i + 2", lambda c: series.tendencies(c.select("q"), "60d"))
_HOLED = "(SELECT * FROM c WHERE i NOT IN (5, 6, 40))"


def holed(c: Cube) -> Cube:
    """No rows on three dates, which aren't declared missing."""
    return c.with_("hole", df=c.df.filter(~c.date_idx.isin(*MISSING)))


on_cube("tendencies_with_gap", f"SELECT a.date, a.member, a.cell, a.q - b.q AS q FROM {_HOLED} a JOIN {_HOLED} b ON a.member = b.member AND a.cell = b.cell AND a.i = b.i + 2", lambda c: series.tendencies(holed(c).select("q"), "60d"))
on_cube(
    "rolling_with_gap",
    f"SELECT a.date, a.member, a.cell, CASE WHEN count(b.q) = 3 THEN max(b.q) END AS q, a.p FROM {_HOLED} a JOIN {_HOLED} b ON a.member = b.member AND a.cell = b.cell AND b.i BETWEEN a.i - 2 AND a.i GROUP BY a.date, a.member, a.cell, a.p",
    lambda c: series.rolling_operation(holed(c).select(["q", "p"]), 3, "max", ["q"]),
)
on_cube("statistics", stats_sql("cube"), lambda c: stats(statistics.statistics(c)))
on_cube("statistics_default_range", stats_sql("(SELECT c.* FROM c, n WHERE i <= floor(0.8 * n.n) - 1)"), lambda c: stats(statistics.statistics(c, default_range=True)))


def with_nan(c: Cube) -> Cube:
    return c.with_("nan", df=c.df.withColumn("q", F.when(F.pmod(c.date_idx, F.lit(11)) == 3, float("nan")).otherwise(F.col("q"))))


on_cube("statistics_with_nan", stats_sql("(SELECT CASE WHEN i % 11 <> 3 THEN q END AS q, p, d, x FROM c)"), lambda c: stats(statistics.statistics(with_nan(c))))
_DIFF = "(SELECT a.q - b.q AS q, a.p - b.p AS p, a.d - b.d AS d, a.x - b.x AS x FROM c a JOIN c b ON a.member = b.member AND a.cell = b.cell AND a.i = b.i + {0})"
on_cube(
    "statistics_tendencies",
    " UNION ALL ".join(stats_sql(_DIFF.format(k), more=f", '{30 * k}d' AS delta") for k in (1, 2)),
    lambda c: stats(statistics.tendency_statistics(c, ["30d", "60d", "7d"])),
)
on_cube(
    "statistics_tendencies_override",
    stats_sql("(SELECT 2.0 * (a.q - b.q) AS q, a.p - b.p AS p FROM c a JOIN c b ON a.member = b.member AND a.cell = b.cell AND a.i = b.i + 1)", ("q", "p"), more=", '30d' AS delta"),
    lambda c: stats(statistics.tendency_statistics(open_dataset(c.df.sparkSession, c, select=["q", "p"], statistics_tendencies=c.rescale({"q": (2.0, 0.0)})), ["30d"])),
)
_GAP_DIFF = f"(SELECT a.q - b.q AS q, a.p - b.p AS p, a.d - b.d AS d, a.x - b.x AS x FROM {_HOLED} a JOIN {_HOLED} b ON a.member = b.member AND a.cell = b.cell AND a.i = b.i + {{0}})"
on_cube(
    "statistics_tendencies_with_gap",
    " UNION ALL ".join(stats_sql(_GAP_DIFF.format(k), more=f", '{30 * k}d' AS delta") for k in (1, 2)),
    lambda c: stats(statistics.tendency_statistics(holed(c), ["30d", "60d"])),
)
on_cube(
    "statistics_constant_variables",
    "SELECT 'q' AS variable, bool_and(a) AS constant FROM (SELECT count(DISTINCT q) = 1 AS a FROM cube GROUP BY member, cell) UNION ALL SELECT 'land', true",
    lambda c: statistics.constant_variables(c.with_("land", df=c.df.select("date", "member", "cell", "q", (F.col("cell") * 1.5).alias("land")), variables=("q", "land"))),
)


def rescaled_statistics(c: Cube) -> DataFrame:
    known = c.with_("statistics", statistics=statistics.collected(statistics.statistics(c))).rescale({"q": (2.0, 10.0)})
    rows = [(v, s["mean"], s["stdev"], s["minimum"], s["maximum"], s["count"]) for v, s in known.statistics.items()]
    return stats(c.df.sparkSession.createDataFrame(rows, "variable string, mean double, stdev double, minimum double, maximum double, count long"))


on_cube("statistics_rescaled", stats_sql("(SELECT q * 2.0 + 10.0 AS q, p, d, x FROM cube)"), rescaled_statistics)
_EVEN = "(CAST('0x' || substr(md5(CAST(date AS VARCHAR) || '|' || member || '|' || cell || '|0 {k} {salt}'), 1, 12) AS BIGINT) + 0.5) / 281474976710656"
_NOISE = "round(sqrt(-2 * ln(" + _EVEN.format(k="{k}", salt="radius") + ")) * cos(2 * pi() * " + _EVEN.format(k="{k}", salt="angle") + ") * (SELECT stddev_pop({v}) FROM cube) + (SELECT avg({v}) FROM cube), 3) AS {v}"
on_cube(
    "obfuscate_values",
    "SELECT date, member, cell, " + ", ".join(_NOISE.format(k=k, v=v) for k, v in enumerate("qpdx")) + " FROM cube",
    lambda c: rounded(statistics.obfuscated(c, statistics.collected(statistics.statistics(c))).rows(), 3),
)
on_cube(
    "climatology_monthly",
    f"SELECT {KV} FROM cube WHERE date IN (SELECT min(date) FROM cube GROUP BY month(date))",
    lambda c: statistics.climatology(c),
)
on_cube("constants_extract", "SELECT member, cell, q FROM c WHERE i = 0", lambda c: c.select("q").at(0).drop("date"))
on_cube("incremental_new_dates", f"SELECT {KV} FROM cube WHERE date >= '1999-01-01'", lambda c: new_dates(c, c.between(None, 1998).rows()))
on_cube(
    "compare_datasets",
    "SELECT 'q' AS variable, count(*) AS compared, count(*) FILTER (WHERE i % 5 = 0) AS different, max(CASE WHEN i % 5 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS largest FROM c",
    lambda c: statistics.compare(c.select("q"), c.select("q").with_("changed", df=c.df.select("date", "member", "cell", (F.col("q") + F.when(F.pmod(c.date_idx, F.lit(5)) == 0, 1.0).otherwise(0.0)).alias("q")))),
)
_BOX = "(SELECT q, p, q * 2.0 + 10.0 AS q2, p AS p2 FROM cube JOIN grid USING (cell) WHERE date >= '1996-01-01' AND date < '1998-01-01' AND latitude BETWEEN 50 AND 60 AND longitude BETWEEN 0 AND 60)"
_AGGREGATES = {"mean": "avg", "stdev": "stddev_pop", "minimum": "min", "maximum": "max"}
on_cube(
    "compare_overlap",
    "SELECT variable, statistic, round(whole, 4) AS whole, round(area, 4) AS area, round((area - whole) * 100 / nullif(area, 0), 3) AS percent FROM ("
    + " UNION ALL ".join(f"SELECT '{v}' AS variable, '{s}' AS statistic, {f}({v}) AS whole, {f}({v}2) AS area FROM {_BOX}" for v in ("q", "p") for s, f in _AGGREGATES.items())
    + ")",
    lambda c: rounded(statistics.overlap_differences(c.select(["q", "p"]), c.between(1996, 1997).area(60, 0, 50, 60).rescale({"q": (2, 10)}), 3), 4, ("whole", "area")),
)
on_cube(
    "recentre_members",
    "SELECT m.date, m.member, m.cell, round(c2.q + 0.5 * (m.q - avg(m.q) OVER (PARTITION BY m.date, m.cell)), 6) AS q FROM cube m JOIN (SELECT date, cell, q FROM cube WHERE member = 0) c2 ON m.date = c2.date AND m.cell = c2.cell",
    lambda c: rounded(combine.recentred(c.select("q"), c.select("q"), 0.5, ()).rows()),
)


@query(
    "open_dataset_nested",
    "SELECT date, 0 AS member, cell, q * 2.0 + 0.0 AS twice, x FROM (SELECT *, dense_rank() OVER (ORDER BY date) - 1 AS j FROM cube WHERE date >= '1996-01-01' AND date < '2000-01-01' AND member = 1) WHERE j % 2 = 0",
)
def open_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    spec = {"join": [{"dataset": c, "select": ["q"], "rescale": {"q": (2, 0)}}, {"dataset": c, "select": ["x"]}], "rename": {"q": "twice"}, "start": 1996, "end": 1999, "frequency": "60d", "number": 2}
    return open_dataset(spark, **spec).rows()


@query(
    "open_dataset_xy",
    "SELECT CAST(date_diff('day', TIMESTAMP '1996-01-26', a.date) // 30 AS INTEGER) AS date_idx, a.member, a.cell, a.q AS x_q, b.d AS y_d FROM cube a JOIN cube b USING (date, member, cell) WHERE date >= '1996-01-01' AND date < '1998-01-01'",
)
def open_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    found = open_dataset(spark, x={"dataset": c, "select": "q"}, y={"dataset": c, "select": "d"}, start=1996, end=1997)
    return found.select("date_idx", "member", "cell", F.col("x.q").alias("x_q"), F.col("y.d").alias("y_d"))


@query(
    "recipe_nodes",
    """SELECT TIMESTAMP '2003-03-01' + to_days(CAST(k AS INTEGER)) AS date, member, cell, round(e.q + 0.5 * (m.q - e.mean), 6) AS q
    FROM (SELECT *, q AS q0 FROM cube) m JOIN (SELECT date, cell, avg(q) AS mean, max(CASE WHEN member = 0 THEN q END) AS q FROM cube GROUP BY date, cell HAVING count(CASE WHEN member = 0 THEN 1 END) > 0) e USING (date, cell), range(3) t(k)
    WHERE date = TIMESTAMP '1996-02-25'""",
)
def recipe_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members around their first one, under other dates."""
    days = {"dataset": {"dataset": cube(spark, sf_dir), "select": "q"}}
    spec = {
        "dates": {"start": "2003-03-01", "end": "2003-03-03", "frequency": "1d"},
        "input": {"repeated_dates": {"mode": "constant", "date": "1996-02-25", "source": {"recentre": {"members": days, "centre": days, "alpha": 0.5}}}},
    }
    found = recipe.run(spark, spec)
    return found.select("date", "member", "cell", F.round("q", 6).alias("q"))


on_cube("inspect_problems", "SELECT 'cell in range' AS rule, count(*) AS n FROM cube WHERE cell > 7 UNION ALL SELECT 'one row for each key', count(*) FROM cube WHERE cell = 2", lambda c: inspect.problems(c.with_("odd", df=c.df.unionByName(c.df.filter("cell = 2")), cells=8)))
on_cube(
    "inspect_describe",
    "SELECT s.*, false AS constant FROM (" + stats_sql("cube", ("q", "p")) + ") s",
    lambda c: stats(inspect.describe(c.select(["q", "p"]))),
)


@query("synthetic_dataset")
def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SOURCES["synthetic"](spark, cube(spark, sf_dir).dates, cells=100, members=2, variables=("a", "b"), seed=5)


_FORCED = {
    "cos_latitude": "cos(radians(latitude))", "sin_longitude": "sin(radians(longitude))", "cos_julian_day": "cos((dayofyear(date) - 1) / 365.25 * 2 * pi())",
    "sin_local_time": "sin(((longitude / 360 * 24) % 24) / 24 * 2 * pi())", "ecef_x": "cos(radians(latitude)) * cos(radians(longitude))",
}


@query("forcings_calendar_geo", "SELECT date, 0 AS member, cell, " + ", ".join(f"round({s}, 6) AS {n}" for n, s in _FORCED.items()) + " FROM (SELECT DISTINCT date FROM cube), grid")
def forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    present = [d for d in c.dates]
    out = SOURCES["forcings"](spark, present, template=c.grid, param=list(_FORCED))
    return rounded(out.join(c.df.select("date").distinct(), "date", "left_semi"), 6, tuple(_FORCED))


_SUN = "sin(radians(latitude)) * sin(tilt) + cos(radians(latitude)) * cos(tilt) * cos((longitude / 15 % 24 - 12) / 24 * 2 * pi())"


@query(
    "forcings_solar",
    f"""SELECT date, 0 AS member, cell, round(sun, 6) AS insolation, round(1361.0::DOUBLE * (1 + 0.033::DOUBLE * cos(2 * pi() * dayofyear(date) / 365)) * sun * 3600, 3) AS toa_incident_solar_radiation
    FROM (SELECT date, cell, greatest({_SUN}, 0) AS sun FROM (SELECT *, radians(23.45) * sin(2 * pi() * (284 + dayofyear(date)) / 365) AS tilt FROM (SELECT (SELECT min(date) FROM cube) + to_days(CAST(30 * g AS INTEGER)) AS date FROM n, range(n.n) t(g)), grid))""",
)
def solar(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    found = SOURCES["forcings"](spark, c.dates, template=c.grid, param=["insolation", "toa_incident_solar_radiation"])
    return rounded(rounded(found, 6, ("insolation",)), 3, ("toa_incident_solar_radiation",))


@query("recipe_build", "SELECT date, member, cell, q, x FROM cube WHERE date BETWEEN '1996-01-01' AND '1998-12-31' AND date NOT IN (SELECT date FROM c WHERE i = 20) AND cell < 5")
def recipe_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir).between(1996, 1998)
    SOURCES["fixture"] = lambda spark, dates, names: c.df.select("date", "member", "cell", *names).filter(F.col("date").isin([str(d) for d in dates]))
    whole = cube(spark, sf_dir)
    spec = {
        "dates": {"start": c.start, "end": c.end, "frequency": "30d", "missing": [whole.dates[20]]},
        "group_by": "yearly",
        "input": {"pipe": [{"join": [{"fixture": {"names": ["q"]}}, {"fixture": {"names": ["x"]}}]}, {"where": {"condition": "cell < 5"}}]},
    }
    return recipe.run(spark, spec).drop("group")


@query(
    "cube_completeness",
    """SELECT 'cell' AS key, CAST(cell AS VARCHAR) AS value, count(*) AS n FROM c WHERE NOT (i = 3 AND cell = 4) GROUP BY cell
    HAVING count(*) <> (SELECT count(DISTINCT date) * count(DISTINCT member) FROM c WHERE NOT (i = 3 AND cell = 4))""",
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    return recipe.incomplete(c.df.filter(~((c.date_idx == 3) & (F.col("cell") == 4)))).filter("key = 'cell'")
