"""Queries of stored datasets, typed variables and appended fragments over the fixtures, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratoframe.functions import naming
from stratoframe.operators import combine, digests, statistics
from stratoframe.operators.cube import Cube
from stratoframe.operators.side import shared_folder
from stratoframe.plans import copying, fixtures, stored, tensors
from stratoframe.plans.dataset import open_dataset, save_dataset
from stratoframe.plans.fragments import Fragments
from stratoframe.sources import coordinates

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = (f, sql)
        return f

    return register


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_MISSING = ", ".join(map(str, fixtures.MISSING))


def _each(select: str, names: str = "qpdx") -> str:
    return " UNION ALL ".join(select.format(v=v) for v in names)


@query(
    "reopened_dataset",
    "SELECT variable, units, 30 * 86400 AS frequency, dates, missing, cells, north, kept, mean, stdev, minimum, maximum, count FROM ("
    + _each(
        "SELECT '{v}' AS variable, CASE '{v}' WHEN 'q' THEN 'kg' WHEN 'p' THEN 'K' END AS units, round(avg({v}), 4) AS mean, round(stddev_pop({v}), 4) AS stdev, min({v}) AS minimum, max({v}) AS maximum, count({v}) AS count "
        + f"FROM c WHERE i NOT IN ({_MISSING})"
    )
    + f"), (SELECT max(i) + 1 AS dates, count(DISTINCT CASE WHEN i IN ({_MISSING}) THEN i END) AS missing FROM c), (SELECT count(*) AS cells, max(latitude) AS north FROM grid WHERE longitude BETWEEN 0 AND 60),"
    + f" (SELECT count(*) AS kept FROM c JOIN grid USING (cell) WHERE i NOT IN ({_MISSING}) AND longitude BETWEEN 0 AND 60)",
)
def reopened_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube stored in two saves with missing dates and units, opened by its path, and an area of it."""
    cube, path = fixtures.cube(spark, sf_dir).set_missing(list(fixtures.MISSING)).typed({"q": {"units": "kg"}, "p": {"units": "K"}}), folder(spark, "reopened")
    save_dataset(cube.between(None, 1998), path)
    save_dataset(cube, path)
    found = open_dataset(spark, path)
    view = found.area(90, 0, -90, 60)
    kept, north = view.rows().count(), view.grid.agg(F.max("latitude")).first()[0]
    rows = [
        (v, found.typed_variables[v].units, int(found.frequency.total_seconds()), len(found.dates), len(found.missing), view.cells, north, kept, *[found.statistics[v][k] for k in statistics.FIELDS])
        for v in found.variables
    ]
    table = spark.createDataFrame(rows, "variable string, units string, frequency long, dates long, missing long, cells long, north double, kept long, mean double, stdev double, minimum double, maximum double, count long")
    return table.withColumns({k: F.round(k, 4) for k in ("mean", "stdev")})


@query("stored_rows", f"SELECT date, member, cell, q, p, d, x FROM c WHERE i NOT IN ({_MISSING})")
def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a cube stored in three saves, one of which brings dates between the others'."""
    cube, path = fixtures.cube(spark, sf_dir).set_missing(list(fixtures.MISSING)), folder(spark, "rows")
    for part in (cube.between(1999, None), cube.between(None, 1996), cube):
        save_dataset(part, path)
    return open_dataset(spark, path).rows()


@query(
    "stored_versions",
    "SELECT 1 AS version, 1 AS pieces, count(*) FILTER (WHERE date < '1997-01-01') AS rows FROM cube UNION ALL SELECT 2, 2, count(*) FROM cube",
)
def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube, path = fixtures.cube(spark, sf_dir), folder(spark, "versions")
    save_dataset(cube.between(None, 1996), path)
    save_dataset(cube, path)
    return stored.versions(spark, path).drop("saved")


@query(
    "stored_trajectories",
    "SELECT base_date, step_s, member, cell, q, p, d, x FROM traj WHERE step_s <= 43200 AND base_date >= '1997-01-01'",
)
def stored_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, path = fixtures.trajectories(spark, sf_dir), folder(spark, "trajectories")
    save_dataset(t.base_range(None, 1998), path)
    save_dataset(t, path)
    return open_dataset(spark, path, base_start=1997, step_start="6h", step_end="12h").rows()


@query("fragments_finalised", "SELECT DISTINCT ts, latitude, longitude, value, k FROM obs")
def fragments_finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations appended in three fragments that overlap and repeat rows, made disjoint, opened again."""
    rows, path = fixtures.observations(spark, sf_dir), folder(spark, "fragments")
    store = Fragments(spark, path)
    for low, high in (("2024-01-14", "2024-02-01"), ("2024-01-01", "2024-01-12"), ("2024-01-11", "2024-01-15")):
        store.append(rows.filter(F.col("ts").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))))
    store.finalise()
    return open_dataset(spark, path).df


@query(
    "fragments_chained",
    "SELECT count(*) AS rows, min(ts) AS first, max(ts) AS last, 0 AS problems, 0 AS gaps FROM (SELECT DISTINCT ts, latitude, longitude, value, k FROM obs)",
)
def fragments_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of a finalised store: in order, without overlaps, each after the rows of those before."""
    rows, path = fixtures.observations(spark, sf_dir), folder(spark, "chained")
    store = Fragments(spark, path)
    for low, high in (("2024-01-01", "2024-01-20"), ("2024-01-05", "2024-01-10"), ("2024-01-15", "2024-02-01")):
        store.append(rows.filter(F.col("ts").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))))
    store.finalise(piece_rows=2_000)
    pieces = store.pieces()  # one row for each piece, so one task orders them
    before = F.coalesce(F.lag(F.col("offset") + F.col("rows")).over(Window.orderBy("first")), F.lit(0))
    marked = pieces.withColumn("gap", (F.col("offset") != before).cast("int"))
    return marked.agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"), F.lit(store.problems().count()).alias("problems"), F.sum("gap").alias("gaps"))



_TYPED = "SELECT '{v}' AS variable, {units} AS units, {level} AS level, (SELECT bool_and(n = 1) FROM (SELECT count(DISTINCT {x}) AS n FROM cube GROUP BY member, cell)) AS constant, round(avg({x}), 4) AS mean FROM cube"


@query(
    "typed_variables",
    " UNION ALL ".join(
        _TYPED.format(v=v, units=units, level=level, x=x)
        for v, units, level, x in (("q", "'kg'", "CAST(NULL AS DOUBLE)", "q"), ("p_850", "'K'", "850.0", "p"), ("d", "'hPa'", "CAST(NULL AS DOUBLE)", "(d / 100)"), ("c", "NULL", "CAST(NULL AS DOUBLE)", "cell"))
    ),
)
def typed_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, levels and constancy after renaming, rescaling by units, a concatenation of parts in other units, and a join."""
    cube = fixtures.cube(spark, sf_dir).select(["q", "p", "d"]).rename({"p": "p_850"}).typed({"q": {"units": "kg"}, "p_850": {"units": "K"}, "d": {"units": "Pa"}})
    early, late = cube.between(None, 1997), cube.between(1998, None).rescale({"p_850": "degC"})
    whole = combine.concat([early, late.rescale({"p_850": "K"})]).rescale({"d": "hPa"})
    cells = Cube(cube.df.select("date", "member", "cell", F.col("cell").cast("double").alias("c")), ("c",), cube.start, cube.end, cube.frequency, cube.members, cube.cells, cube.grid, cube.field_shape)
    joined = statistics.with_constants(combine.join([whole, cells]))
    table = [(v.name, v.units, v.level, v.constant) for v in joined.typed_variables.values()]
    means = statistics.summary(joined.rows(), joined.variables).select("variable", F.round("mean", 4).alias("mean"))
    return spark.createDataFrame(table, "variable string, units string, level double, constant boolean").join(means, "variable")


def described(df: DataFrame, names: dict[str, tuple[str, dict[str, str]]]) -> DataFrame:
    """Columns under other names and with attributes."""
    return df.select(*[F.col(c).alias(names[c][0], metadata=names[c][1]) if c in names else F.col(c) for c in df.columns])


_STANDARD = "SELECT '{copy}' AS copy, '{model}' AS model, count(*) AS n, min(date) AS first, max(date) AS last, {base} AS base, CAST(sum({step}) AS BIGINT) AS steps, round(sum(latitude), 3) AS latitudes, round(sum(longitude), 3) AS longitudes, sum(q) AS q FROM {rows}"
_FORECASTS = "(SELECT base_date, step_s, base_date + to_seconds(step_s) AS date, latitude, longitude, q FROM traj JOIN grid USING (cell))"


@query(
    "detected_coordinates",
    " UNION ALL ".join(
        _STANDARD.format(copy=copy, model=model, base=base, step=step, rows=rows)
        for copy, model, base, step, rows in (
            ("names", "analysis", "CAST(NULL AS TIMESTAMP)", "CAST(NULL AS BIGINT)", "(SELECT date, latitude, longitude, q FROM cube JOIN grid USING (cell))"),
            ("attributes", "base+step", "min(base_date)", "step_s", _FORECASTS),
            ("flavour", "valid+step", "min(base_date)", "step_s", _FORECASTS),
            ("bases", "valid+base", "min(base_date)", "step_s", _FORECASTS),
        )
    ),
)
def detected_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differently named copies of the fixtures, read by the roles of their columns."""
    cube, t = fixtures.cube(spark, sf_dir), fixtures.trajectories(spark, sf_dir)
    fields = cube.df.join(F.broadcast(cube.grid), "cell").select("date", "member", "latitude", "longitude", "q")
    forecasts = t.df.join(F.broadcast(t.grid), "cell").select("base_date", "step_s", "member", "latitude", (F.col("longitude") - 360).alias("longitude"), "q")
    valid = forecasts.withColumn("valid", F.col("base_date") + F.make_dt_interval(secs=F.col("step_s").cast("decimal(18,6)")))
    hours = (F.col("step_s") / 3600).cast("int")
    copies = {
        "names": (described(fields, {"date": ("time", {}), "member": ("number", {})}), None),
        "attributes": (
            described(
                forecasts,
                {
                    "base_date": ("reference", {"standard_name": "forecast_reference_time"}), "step_s": ("lead", {"standard_name": "forecast_period", "units": "seconds"}), "member": ("realization", {}),
                    "latitude": ("nlat", {"long_name": "latitude", "units": "degrees_north"}), "longitude": ("nlon", {"standard_name": "longitude"}),
                },
            ),
            None,
        ),
        "flavour": (
            described(valid.withColumn("step_s", hours).drop("base_date"), {"valid": ("XTIME", {}), "step_s": ("hour", {}), "latitude": ("XLAT", {}), "longitude": ("XLONG", {})}),
            {"rules": {"time": {"name": "XTIME"}, "step": {"name": "hour"}, "latitude": {"name": "XLAT"}, "longitude": {"name": ["XLON", "XLONG"]}}},
        ),
        "bases": (described(valid.drop("step_s"), {"valid": ("time", {}), "base_date": ("forecast_reference_time", {})}), None),
    }
    out = None
    for name, (copy, flavour) in copies.items():
        found = coordinates.detect(copy, flavour=flavour)
        rows = coordinates.standardised(copy, found)
        base = F.min("base_date") if "base_date" in rows.columns else F.lit(None).cast("timestamp_ntz")
        steps = F.sum("step_s") if "step_s" in rows.columns else F.lit(None).cast("long")
        one = rows.agg(
            F.lit(name).alias("copy"), F.lit(found.time_model).alias("model"), F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), base.alias("base"), steps.alias("steps"),
            F.round(F.sum("latitude"), 3).alias("latitudes"), F.round(F.sum("longitude"), 3).alias("longitudes"), F.sum("q").alias("q"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "packed_samples",
    f"SELECT CAST(i AS BIGINT) AS date_idx, count(*) AS n, sum(q) AS total, max_by(x, member * 1000 + cell) AS last FROM c WHERE i NOT IN ({_MISSING}) GROUP BY i",
)
def packed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each date's array, as a loop over tensors gets it: its size, the sum of its first variable and its last value."""
    cube = fixtures.cube(spark, sf_dir).set_missing(list(fixtures.MISSING))
    return tensors.digests(open_dataset(spark, cube, tensors="numpy"))


@query(
    "field_digests",
    " UNION ALL ".join(
        f"SELECT '{v}' AS variable, count(*) AS fields, count(DISTINCT f) AS different, max(n) AS cells, count(DISTINCT (member, f)) = count(DISTINCT member) AS constant FROM (SELECT date, member, list(struct_pack(c := cell, v := {x}) ORDER BY cell) AS f, count(*) AS n FROM cube GROUP BY date, member)"
        for v, x in (("q", "q % 2"), ("d", "d"), ("k", "cell * 2.5 + member"))
    ),
)
def field_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different fields each variable has, and which are constant, from digests alone."""
    cube = fixtures.cube(spark, sf_dir)
    rows = cube.df.select("date", "member", "cell", (F.col("q") % 2).alias("q"), "d", (F.col("cell") * 2.5 + F.col("member")).alias("k"))
    found = digests.field_digests(rows, ("q", "d", "k"))
    counts = found.groupBy("variable").agg(F.count("*").alias("fields"), F.count_distinct("digest").alias("different"), F.max("n").alias("cells"))
    return counts.join(digests.constant_by_digest(found), "variable")


@query(
    "copied_ranges",
    "SELECT date_trunc('year', date) AS year, count(*) AS rows, min(date) AS first, max(date) AS last, bool_or(year(date) IN (1996, 1999)) AS written FROM cube GROUP BY 1",
)
def copied_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy that lacked a year and held a changed one, resumed: its ranges, and which of them the second call wrote."""
    cube, path = fixtures.cube(spark, sf_dir), folder(spark, "copy")
    old = cube.df.filter("year(date) <> 1996").withColumn("x", F.when(F.year("date") == 1999, F.col("x") + 1).otherwise(F.col("x")))
    copying.copy(cube.with_("old", df=old).set_missing([d for d in cube.dates if d.year == 1996]), path, "yearly")
    again = copying.copy(cube, path, "yearly")
    written = F.date_format("first", "yyyy").isin([d[:4] for d in again])
    return copying.manifest(spark, path).select(F.date_trunc("year", "first").cast("timestamp_ntz").alias("year"), "rows", "first", "last", written.alias("written"))


@query("copied_rows", f"SELECT date, member, cell, q, p, d, x FROM c WHERE i NOT IN ({_MISSING})")
def copied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy by series, in batches, opened again."""
    cube, path = fixtures.cube(spark, sf_dir).set_missing(list(fixtures.MISSING)), folder(spark, "series")
    copying.copy(cube, path, "yearly", layout="cell", batch=3)
    return open_dataset(spark, path).rows()


_NAMED = "(SELECT *, CASE n_nationkey % 5 WHEN 0 THEN 'aifs-od-an-' || lower(n_name) || '-' || res || '-1979-2022-6h-v1' WHEN 1 THEN 'fc-' || n_name || '-mars-o96-1995-2001-6h-1h-v2-extra' WHEN 2 THEN 'obs-' || lower(n_name) || '-synop-1995-2001-v3' WHEN 3 THEN 'obs_' || lower(n_name) || '-1995' ELSE 'aifs-x-an-n320-1995-2001-12h-v1' END AS name FROM (SELECT *, CASE n_regionkey % 2 WHEN 0 THEN 'o96' ELSE '0p25' END AS res FROM nation))"


def _named_sql() -> str:
    shape = {k: f"regexp_matches(name, '{naming.pattern(k)}')" for k in naming.LAYOUTS}
    part = lambda k, p: f"nullif(regexp_extract(name, '{naming.pattern(k)}', {naming.LAYOUTS[k].index(p) + 1}), '')"
    layout = "CASE WHEN {0} AND NOT {1} AND NOT {2} THEN 'gridded' WHEN {1} AND NOT {0} AND NOT {2} THEN 'trajectories' WHEN {2} AND NOT {0} AND NOT {1} THEN 'tabular' END".format(*shape.values())
    wrong = ["CASE WHEN name <> lower(name) THEN 'upper case' END", "CASE WHEN contains(name, '_') THEN 'underscore' END", r"CASE WHEN regexp_matches(name, '[^\pL\pN_-]') THEN 'characters' END", f"CASE WHEN NOT ({' OR '.join(shape.values())}) THEN 'no layout fits' END"]
    for p, value in (("resolution", "res"), ("frequency", "'6h'"), ("start", "'1995'")):
        wrong += [f"CASE WHEN layout = '{k}' AND {part(k, p)} <> {value} THEN '{p}' END" for k in naming.LAYOUTS if p in naming.LAYOUTS[k]]
    listed = ", ".join(wrong)
    return f"SELECT n_nationkey, name, layout, array_to_string(list_sort(list_filter([{listed}], lambda p: p IS NOT NULL)), ',') AS problems FROM (SELECT *, {layout} AS layout FROM {_NAMED})"


@query("dataset_names", _named_sql())
def dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made from the nations, their layouts, and what is wrong with each for a six-hourly dataset from 1995 of the row's resolution."""
    nation = fixtures.read(spark, sf_dir, "nation").withColumn("res", F.when(F.col("n_regionkey") % 2 == 0, "o96").otherwise("0.25"))
    low, res = F.lower("n_name"), F.replace("res", F.lit("."), F.lit("p"))
    k = F.col("n_nationkey") % 5
    name = (
        F.when(k == 0, F.concat(F.lit("aifs-od-an-"), low, F.lit("-"), res, F.lit("-1979-2022-6h-v1")))
        .when(k == 1, F.concat(F.lit("fc-"), "n_name", F.lit("-mars-o96-1995-2001-6h-1h-v2-extra")))
        .when(k == 2, F.concat(F.lit("obs-"), low, F.lit("-synop-1995-2001-v3")))
        .when(k == 3, F.concat(F.lit("obs_"), low, F.lit("-1995")))
        .otherwise("aifs-x-an-n320-1995-2001-12h-v1")
    )
    named = nation.select("n_nationkey", "res", name.alias("name"))
    wrong = naming.problems(F.col("name"), actual=naming.Actual(resolution=F.col("res"), frequency="6h", start="1995-03-01"))
    return named.select("n_nationkey", "name", naming.layout_of(F.col("name")).alias("layout"), F.array_join(F.array_sort(wrong), ",").alias("problems"))


@query(
    "stored_tendencies",
    _each("SELECT '{v}' AS variable, round(avg(y), 4) AS mean, round(stddev_pop(y), 4) AS stdev, min(y) AS minimum, max(y) AS maximum, count(y) AS count FROM (SELECT 2 * (a.{v} - b.{v}) AS y FROM c a JOIN c b ON a.i = b.i + 2 AND a.member = b.member AND a.cell = b.cell)", "qd"),
)
def stored_tendencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of differences over two steps, stored by two saves and opened with the dataset, of variables rescaled since."""
    cube, path = fixtures.cube(spark, sf_dir).select(["q", "d"]), folder(spark, "tendencies")
    save_dataset(cube.between(None, 1997), path, ["60d"])
    save_dataset(cube, path)
    found = statistics.stored_tendencies(open_dataset(spark, path, rescale={"q": (2, 5), "d": (2, 0)}), "60d")
    rows = [(v, *[s[f] for f in statistics.FIELDS]) for v, s in found.items()]
    table = spark.createDataFrame(rows, "variable string, mean double, stdev double, minimum double, maximum double, count long")
    return table.withColumns({k: F.round(k, 4) for k in ("mean", "stdev")})
