"""Queries over the observations fixture, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.operators import coverings, tabular
from stratoframe.operators.side import side
from stratoframe.operators.tabular import Observations
from stratoframe.plans.dataset import open_dataset
from stratoframe.plans.fixtures import cube, grid, observations, read
from stratoframe.sources.registry import FILTERS, SOURCES, add_messages
from stratoframe.streaming import windows

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = (f, sql)
        return f

    return register


#: The reference dates of samples, from the first observation's second on or from a given time.
_REFS = ", refs AS (SELECT CAST(g AS INTEGER) AS sample, {start} + to_seconds(g * {step}) AS reference FROM range((epoch({end})::BIGINT - epoch({start})::BIGINT) // {step} + 1) t(g))"
_FIRST, _LAST = "(SELECT min(ts) FROM obs)", "(SELECT max(ts) FROM obs)"


def sampled_sql(select: str, step: int, low: str, high: str, start: str = _FIRST, end: str = _LAST, tail: str = "") -> str:
    return f"{_REFS.format(start=start, end=end, step=step)} SELECT {select} FROM refs JOIN obs ON ts {low} AND ts {high} {tail}"


_AGG = "sample, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS latest"


def samples(name: str, window: str, step: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Observations.of(observations(spark, sf_dir), window=window, frequency=step).samples()
        return rows.groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("latest"))

    QUERIES[name] = (run, sql)


samples("window_tumbling", "(-3h,0h]", "3h", sampled_sql(_AGG, 10800, "> reference - INTERVAL 3 HOUR", "<= reference", tail="GROUP BY sample"))
samples("window_hopping_gap", "(-5h,+1h]", "12h", sampled_sql(_AGG, 43200, "> reference - INTERVAL 5 HOUR", "<= reference + INTERVAL 1 HOUR", tail="GROUP BY sample"))
samples("window_sliding", "[-5h,+3h)", "6h", sampled_sql(_AGG, 21600, ">= reference - INTERVAL 5 HOUR", "< reference + INTERVAL 3 HOUR", tail="GROUP BY sample"))
samples("window_closed_closed", "[-3h,+0h]", "3h", sampled_sql(_AGG, 10800, ">= reference - INTERVAL 3 HOUR", "<= reference", tail="GROUP BY sample"))
samples("window_open_open", "(-3h,+3h)", "3h", sampled_sql(_AGG, 10800, "> reference - INTERVAL 3 HOUR", "< reference + INTERVAL 3 HOUR", tail="GROUP BY sample"))


@query("window_timedelta", sampled_sql("sample, reference, epoch(ts)::BIGINT - epoch(reference)::BIGINT AS timedelta, ts, latitude, longitude, value, k", 21600, "> reference - INTERVAL 6 HOUR", "<= reference"))
def window_timedelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Observations.of(observations(spark, sf_dir), window="(-6h,0]", frequency="6h").samples()


_SPAN = ("TIMESTAMP '2023-12-30'", "TIMESTAMP '2024-02-02'")


@query("window_empty_samples", _REFS.format(start=_SPAN[0], end=_SPAN[1], step=10800) + " SELECT sample, count(ts) AS n FROM refs LEFT JOIN obs ON ts > reference - INTERVAL 3 HOUR AND ts <= reference GROUP BY sample")
def window_empty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Observations.of(observations(spark, sf_dir), datetime(2023, 12, 30), datetime(2024, 2, 2)).counts()


@query("window_out_of_range", sampled_sql("sample, ts, value", 86400, "> reference - INTERVAL 1 DAY", "<= reference", "TIMESTAMP '2024-01-25'", "TIMESTAMP '2024-03-01'"))
def window_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = Observations.of(observations(spark, sf_dir)).view(start=datetime(2024, 1, 25), end=datetime(2024, 3, 1), frequency="1d", window="(-1d,0]")
    return view.samples().select("sample", "ts", "value")


@query("window_single_sample", "SELECT ts, latitude, longitude, value, k FROM obs WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-10 03:00:00'")
def window_single_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = Observations.of(observations(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 20))
    return view.sample(int((datetime(2024, 1, 10, 3) - datetime(2024, 1, 5)) / timedelta(hours=3))).select("ts", "latitude", "longitude", "value", "k")


@query("tabular_select_area", "SELECT ts, latitude, longitude, value FROM obs WHERE latitude BETWEEN -30 AND 50 AND (longitude >= 300 OR longitude <= 40)")
def tabular_select_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Observations.of(observations(spark, sf_dir)).select("value").area(50, -60, -30, 40).df


@query(
    "tabular_thin_grid",
    _REFS.format(start=_FIRST, end=_LAST, step=86400)
    + """ SELECT * EXCLUDE (r) FROM (SELECT sample, reference, epoch(ts)::BIGINT - epoch(reference)::BIGINT AS timedelta, ts, latitude, longitude, value, k, row_number() OVER (
        PARTITION BY sample, round(cos(radians(latitude)) * cos(radians(longitude)) / (3000 / 6371.0)), round(cos(radians(latitude)) * sin(radians(longitude)) / (3000 / 6371.0)), round(sin(radians(latitude)) / (3000 / 6371.0))
        ORDER BY ts, latitude, longitude, value NULLS FIRST, k NULLS FIRST) AS r
      FROM refs JOIN obs ON ts > reference - INTERVAL 1 DAY AND ts <= reference) WHERE r = 1""",
)
def tabular_thin_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Observations.of(observations(spark, sf_dir), frequency="1d", window="(-1d,0]").thin_grid(3000.0)


@query("tabular_encode", "SELECT DISTINCT ts, latitude, longitude, value, k FROM obs WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'")
def tabular_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.encode(observations(spark, sf_dir), datetime(2024, 1, 3), datetime(2024, 1, 20))


@query("tabular_sort_dedup", "SELECT DISTINCT ts, latitude, longitude, value, k FROM obs ORDER BY ALL")
def tabular_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    return tabular.sorted_rows(tabular.encode(rows.unionByName(rows.filter("k > 50"))))


@query("tabular_export", "SELECT CAST(epoch(ts)::BIGINT // 86400 AS FLOAT) AS __date, CAST(epoch(ts)::BIGINT % 86400 AS FLOAT) AS __time, CAST(latitude AS FLOAT) AS __latitude, CAST(longitude AS FLOAT) AS __longitude, CAST(value AS FLOAT) AS value, CAST(k AS FLOAT) AS k FROM obs")
def tabular_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.exported(observations(spark, sf_dir))


@query("tabular_index_runs", "SELECT epoch(ts)::BIGINT AS epoch, CAST(sum(count(*)) OVER (ORDER BY epoch(ts)::BIGINT) - count(*) AS BIGINT) AS \"offset\", count(*) AS count FROM obs GROUP BY epoch(ts)::BIGINT")
def tabular_index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.index_runs(observations(spark, sf_dir))


_STAT = "SELECT '{v}' AS variable, round(avg({v}), 4) AS mean, round(stddev_pop({v}), 4) AS stdev, min({v}) AS minimum, max({v}) AS maximum, count({v}) AS count FROM obs"


@query("tabular_statistics", " UNION ALL ".join(_STAT.format(v=v) for v in ("value", "k")))
def tabular_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Observations.of(observations(spark, sf_dir)).statistics().withColumns({c: F.round(c, 4) for c in ("mean", "stdev")})



@query("tabularise_fields", "SELECT date, latitude, longitude, max(v) FILTER (WHERE variable = 'q') AS q, max(v) FILTER (WHERE variable = 'd') AS d FROM (SELECT date, latitude, longitude, 'q' AS variable, q AS v FROM cube JOIN grid USING (cell) WHERE member = 0 UNION ALL SELECT date, latitude, longitude, 'd', d FROM cube JOIN grid USING (cell) WHERE member = 0) GROUP BY ALL")
def tabularise_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cube(spark, sf_dir)
    fields = c.select(["q", "d"]).long().filter("member = 0").join(side(c.grid, c.cells), "cell").select("date", "latitude", "longitude", "variable", "value")
    return FILTERS["tabularise"](fields, names=["q", "d"])


@query("pivot_observations", "SELECT l_orderkey, l_linenumber % 2 AS half, max(v) FILTER (WHERE f = 'A') AS v_A, max(v) FILTER (WHERE f = 'N') AS v_N, max(v) FILTER (WHERE f = 'R') AS v_R FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS f, sum(l_quantity) AS v FROM (SELECT l_orderkey, l_linenumber % 2 AS l_linenumber, l_returnflag, l_quantity FROM lineitem) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def pivot_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("half"), F.col("l_returnflag").alias("f")).agg(F.sum("l_quantity").alias("v"))
    return tabular.pivot(rows, ["f"], ["v"], ["A", "N", "R"])


_D = "sqrt(pow(ox - gx, 2) + pow(oy - gy, 2) + pow(oz - gz, 2))"
_P = "cos(radians(latitude)) * cos(radians(longitude)) AS {0}x, cos(radians(latitude)) * sin(radians(longitude)) AS {0}y, sin(radians(latitude)) AS {0}z"


@query(
    "griddify_nearest",
    f"""SELECT cell, max_by(value, (ts, value)) AS value FROM (SELECT DISTINCT ON (latitude, longitude) latitude, longitude, cell, dist FROM (
      SELECT latitude, longitude, cell, {_D} AS dist FROM (SELECT DISTINCT latitude, longitude, {_P.format("o")} FROM obs) o, (SELECT cell, {_P.format("g")} FROM grid) g) ORDER BY latitude, longitude, dist, cell) near
      JOIN obs USING (latitude, longitude) WHERE dist <= 2 * sin(1500 / 6371.0 / 2) GROUP BY cell""",
)
def griddify_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.griddify(observations(spark, sf_dir), grid(spark), ["value"], 1500.0)


@query("message_filter", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND value > 20 AND user_id <> 5")
def message_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"event_type": ("in", ["click", "view"]), "value": (">", 20.0), "user_id": ("!=", 5)}
    return read(spark, sf_dir, "events").filter(tabular.message_filter(rules)).select("event_id", "event_type", "value")


@query("long_rows", "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS place, unnest(embedding) AS embedding FROM embeddings")
def long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.long_rows(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["embedding"])


@query("wide_rows", "SELECT vec_id, label, embedding[1] AS embedding_1, embedding[4] AS embedding_2 FROM embeddings")
def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.wide_rows(read(spark, sf_dir, "embeddings"), "embedding", [0, 3])


@query("stream_window_counts", 'SELECT time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 1 SECOND) AS "start", count(*) AS n FROM obs GROUP BY 1')
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming plan on a bounded input: (start, end] windows of six hours."""
    found = windows.window_counts(observations(spark, sf_dir), "6 hours", "6 hours", "1 hour")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")




@query(
    "open_dataset_tabular",
    sampled_sql("sample, count(*) AS n, round(sum(value), 4) AS total", 43200, "> reference - INTERVAL 6 HOUR", "<= reference + INTERVAL 3 HOUR", "TIMESTAMP '2024-01-05'", "TIMESTAMP '2024-01-20 23:59:59'", "WHERE latitude BETWEEN -30 AND 60 AND longitude BETWEEN 20 AND 300 GROUP BY sample"),
)
def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = open_dataset(spark, Observations.of(observations(spark, sf_dir)), start="2024-01-05", end="2024-01-20", frequency="12h", window="(-6,+3]", area=(60, 20, -30, 300), drop="k")
    return found.samples().groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "window_slice_boundaries",
    _REFS.format(start=_FIRST, end=_LAST, step=10800)
    + """ SELECT CAST(sample - 2 AS INTEGER) AS sample, reference, last - n AS first, last FROM (
      SELECT *, CAST(sum(n) OVER (ORDER BY sample) AS BIGINT) AS last FROM (
        SELECT sample, reference, count(ts) AS n FROM refs LEFT JOIN obs ON ts > reference - INTERVAL 3 HOUR AND ts <= reference WHERE sample BETWEEN 2 AND 8 GROUP BY ALL))""",
)
def slice_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Observations.of(observations(spark, sf_dir), window="(-3h,0h]", frequency="3h").samples_of(slice(2, 9)).boundaries()


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages of files, one for each priority."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp_ntz").alias("valid_datetime"), F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("offset"), F.lit(100).alias("length"), F.col("o_orderstatus").alias("param"), (F.col("o_custkey") % 5).alias("number")
    )


_MESSAGES = "SELECT o_orderdate AS valid_datetime, o_orderpriority AS path, o_orderkey AS \"offset\", 100 AS length, o_orderstatus AS param, o_custkey % 5 AS number FROM orders"


@query("message_index", f"SELECT * FROM ({_MESSAGES}) WHERE day(valid_datetime) IN (1, 15) AND valid_datetime < '1997-01-01' AND valid_datetime >= '1995-01-01' AND number IN (1, 3)")
def message_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made in two steps, the second of which repeats rows of the first."""
    found = messages(spark, sf_dir)
    index = add_messages(found.filter("number < 2"), found.filter("number > 0"))
    dates = [datetime(y, m, d) for y in (1995, 1996) for m in range(1, 13) for d in (1, 15)]
    return SOURCES["grib-index"](spark, dates, index, number=[1, "3"])


@query(
    "accumulate_without_bases",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS date, count(*) AS n FROM obs GROUP BY time_bucket(INTERVAL 6 HOUR, ts) HAVING count(DISTINCT date_trunc('hour', ts)) = 6",
)
def accumulate_without_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hourly sums of hourly counts that have no bases; periods that lack an hour are left out."""
    hourly = observations(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))
    fields = hourly.select("start", (F.col("start") + F.expr("interval 1 hour")).alias("end"), "n")
    dates = fields.select((F.window("start", "6 hours")["end"]).cast("timestamp_ntz").alias("date")).distinct()
    return coverings.accumulate(fields, dates, "6h", [], ["n"], missing="skip")


@query(
    "message_index_evolved",
    "SELECT \"path\", count(*) AS messages, count(level) AS levels, count(DISTINCT o_orderkey) AS keys FROM (SELECT o_orderpriority AS path, o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey % 3 END AS level FROM (SELECT DISTINCT o_orderkey, o_orderpriority, o_custkey FROM orders)) GROUP BY path",
)
def message_index_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index whose later messages have a key more; no two messages have the same keys."""
    all_ = messages(spark, sf_dir).withColumn("number", F.col("offset"))
    late = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("offset"), (F.col("o_custkey") % 3).alias("level")).join(all_, "offset").filter("offset % 2 = 1")
    index = add_messages(all_.filter("offset % 2 = 0"), late, unique=True)
    return index.groupBy("path").agg(F.count("*").alias("messages"), F.count("level").alias("levels"), F.count_distinct("number").alias("keys"))


@query("variable_names", "SELECT n_name AS param, CASE WHEN n_nationkey % 3 > 0 THEN n_name || '_' || n_regionkey ELSE n_name END AS variable FROM nation")
def variable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read(spark, sf_dir, "nation").select(F.col("n_name").alias("param"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).alias("levelist"))
    return FILTERS["variable_names"](fields).select("param", "variable")
