"""Queries over the trajectories fixture and derived sources, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratoframe.operators import coverings, derived, statistics
from stratoframe.operators.cube import Cube
from stratoframe.operators.trajectories import Trajectories
from stratoframe.plans import recipe
from stratoframe.plans.dataset import open_dataset
from stratoframe.plans.fixtures import cube, trajectories
from stratoframe.plans.gridded_queries import stats, stats_sql
from stratoframe.sources import patches
from stratoframe.sources.registry import SOURCES

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
TV = "base_date, step_s, member, cell, q, p, d, x"
HOUR = timedelta(hours=1)


def on_traj(name: str, sql: str | None, f: Callable[[Trajectories], Trajectories | Cube | DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(trajectories(spark, sf_dir))
        return out if isinstance(out, DataFrame) else out.rows()

    QUERIES[name] = (run, sql)


on_traj("traj_scan", f"SELECT {TV} FROM traj", lambda t: t)
on_traj("traj_envelope", f"SELECT {TV} FROM traj WHERE base_date + INTERVAL 6 HOUR >= '1996-01-01' AND base_date + INTERVAL 42 HOUR < '1999-01-01'", lambda t: t.envelope(1996, 1998))
on_traj("traj_step", "SELECT base_date + INTERVAL 12 HOUR AS date, member, cell, q, p, d, x FROM traj WHERE step_s = 43200", lambda t: t.step(12))
on_traj("traj_steps", f"SELECT {TV} FROM traj WHERE step_s IN (21600, 64800)", lambda t: t.only_steps([6, 18]))
on_traj("traj_step_range", f"SELECT {TV} FROM traj WHERE step_s BETWEEN 43200 AND 129600 AND (step_s - 21600) % 43200 = 0", lambda t: t.step_range(12, 36, 12))
on_traj("traj_base_range", f"SELECT {TV} FROM traj WHERE base_date >= '1996-06-01' AND base_date < '1998-01-01'", lambda t: t.base_range("1996-06", 1997))
on_traj("traj_base_frequency", f"SELECT {TV} FROM traj WHERE (date_diff('day', (SELECT min(base_date) FROM traj), base_date) // 30) % 4 = 0", lambda t: t.base_every("120d"))
on_traj("traj_select", "SELECT base_date, step_s, member, cell, x, q FROM traj", lambda t: t.select(["x", "q"]))
on_traj("traj_missing", f"SELECT {TV} FROM traj WHERE date_diff('day', (SELECT min(base_date) FROM traj), base_date) // 30 NOT IN (2, 9)", lambda t: t.set_missing([2, 9]))
on_traj(
    "traj_tendencies",
    "SELECT base_date, step_s, member, cell, q FROM (SELECT base_date, step_s, member, cell, q - lag(q) OVER w AS q, lag(step_s) OVER w AS before FROM traj WINDOW w AS (PARTITION BY base_date, member, cell ORDER BY step_s)) WHERE before IS NOT NULL",
    lambda t: t.select("q").tendencies(),
)
on_traj("traj_statistics", stats_sql("(SELECT * FROM traj WHERE base_date + INTERVAL 6 HOUR >= '1996-01-01' AND base_date + INTERVAL 42 HOUR < '1999-01-01')"), lambda t: stats(t.statistics(1996, 1998)))


def totals(t: Trajectories) -> DataFrame:
    """Running totals of q since the base, as fields from the base to each step."""
    w = Window.partitionBy("base_date", "member", "cell").orderBy("step_s")
    end = F.col("base_date") + F.make_dt_interval(secs=F.col("step_s").cast("decimal(18,6)"))
    return t.df.select(F.col("base_date").alias("start"), end.alias("end"), F.col("base_date").alias("base"), "member", "cell", F.sum("q").over(w).alias("q"))


def pieces(t: Trajectories) -> DataFrame:
    """q as fields from each step's predecessor to the step."""
    at = lambda s: F.col("base_date") + F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    return t.df.select(at(F.col("step_s") - 21600).alias("start"), at(F.col("step_s")).alias("end"), F.col("base_date").alias("base"), "member", "cell", "q")


def whole(t: Trajectories) -> Trajectories:
    """Only trajectories with all steps, so that accumulations are complete."""
    full = t.df.groupBy("base_date", "member", "cell").agg(F.count("*").alias("_n")).filter("_n = 7").drop("_n")
    return Trajectories(t.df.join(full, ["base_date", "member", "cell"], "left_semi"), *[getattr(t, f) for f in ("variables", "base_start", "base_end", "base_frequency", "steps", "members", "cells", "grid", "missing")])


def accumulated(mode: str) -> Callable[[Trajectories], DataFrame]:
    def f(t: Trajectories) -> DataFrame:
        t = whole(t)
        targets = [(b + 24 * HOUR, derived.forecast_cover(b, b + 12 * HOUR if mode == "from-zero" else b + 18 * HOUR, b + 24 * HOUR, mode)) for b in t.base_dates]
        return derived.accumulate(totals(t) if mode == "from-zero" else pieces(t), targets, ["member", "cell"], ["q"])

    return f


_WHOLE = "(SELECT t.* FROM traj t SEMI JOIN (SELECT base_date, member, cell FROM traj GROUP BY ALL HAVING count(*) = 7) f USING (base_date, member, cell))"
on_traj("accumulate_from_zero", f"SELECT base_date + INTERVAL 24 HOUR AS date, member, cell, sum(q) AS q FROM {_WHOLE} WHERE step_s IN (64800, 86400) GROUP BY ALL", accumulated("from-zero"))
on_traj("accumulate_prev_step", f"SELECT base_date + INTERVAL 24 HOUR AS date, member, cell, q FROM {_WHOLE} WHERE step_s = 86400", accumulated("from-previous-step"))


def auto_cover(t: Trajectories) -> DataFrame:
    """Two steps' pieces cover [base + 12 h, base + 24 h]; the chain is searched for."""
    t = whole(t)
    targets = []
    for b in t.base_dates:
        options = [derived.Interval(b + 6 * k * HOUR, b + 6 * (k + 1) * HOUR, b) for k in range(7)]
        targets.append((b + 24 * HOUR, derived.cover(b + 12 * HOUR, b + 24 * HOUR, lambda _, options=options: options)))
    return derived.accumulate(pieces(t), targets, ["member", "cell"], ["q"])


on_traj("accumulate_auto_cover", f"SELECT base_date + INTERVAL 24 HOUR AS date, member, cell, sum(q) AS q FROM {_WHOLE} WHERE step_s IN (64800, 86400) GROUP BY ALL", auto_cover)
def from_index(t: Trajectories) -> DataFrame:
    """The same targets, with the intervals read from an index of messages: two days of reach, bases found from valid times and steps."""
    t = whole(t)
    fields = pieces(t)
    steps = [((F.unix_seconds(F.col(c).cast("timestamp")) - F.unix_seconds(F.col("base").cast("timestamp"))) / 3600).cast("int").alias(n) for c, n in (("start", "startStep"), ("end", "endStep"))]
    messages = fields.select(F.col("end").alias("valid_datetime"), *steps).distinct()
    index = coverings.periods(messages)
    dates = fields.select((F.col("base") + F.expr("interval 24 hours")).alias("date")).distinct()
    return coverings.accumulate(fields, dates, "12h", ["member", "cell"], ["q"], index, reach="2d")


on_traj("accumulate_from_index", f"SELECT base_date + INTERVAL 24 HOUR AS date, member, cell, sum(q) AS q FROM {_WHOLE} WHERE step_s IN (64800, 86400) GROUP BY ALL", from_index)
on_traj(
    "from_trajectories",
    "SELECT date, member, cell, q FROM (SELECT base_date + to_seconds(step_s) AS date, member, cell, q, row_number() OVER (PARTITION BY base_date + to_seconds(step_s), member, cell ORDER BY CASE step_s WHEN 43200 THEN 0 ELSE 1 END, base_date) AS k FROM traj WHERE step_s IN (43200, 21600) AND strftime(base_date, '%Y') = '1996') WHERE k = 1",
    lambda t: derived.from_trajectories(t.select("q").df, [12, 6], "1996-*"),
)


def opened(t: Trajectories) -> DataFrame:
    return open_dataset(t.df.sparkSession, t, base_start="1996-06", base_end=1997, base_frequency="60d", step_start=12, step_end=36, step_frequency=12, select=["x", "q"], step=18).rows()


on_traj(
    "open_dataset_trajectories",
    "SELECT base_date + INTERVAL 18 HOUR AS date, member, cell, x, q FROM traj WHERE step_s = 64800 AND base_date >= '1996-06-01' AND base_date < '1998-01-01' AND (date_diff('day', (SELECT min(base_date) FROM traj WHERE base_date >= '1996-06-01'), base_date) // 30) % 2 = 0",
    opened,
)


def recipe_bases(t: Trajectories) -> DataFrame:
    """A recipe of forecasts: early and late bases, and of the late ones short and long steps, from different sources."""
    q = t.select("q").df
    SOURCES["bases_early"] = lambda spark, dates: recipe.asked(q, dates)
    SOURCES["bases_scaled"] = lambda spark, dates, by: recipe.asked(q, dates).withColumn("q", F.col("q") * by)
    first, cut, last = t.base_dates[0], t.base_dates[30], t.base_dates[-1]
    late = {"base_dates": {"start": cut, "end": last, "frequency": "30d"}}
    spec = {
        "dates": {"base_dates": {"start": first, "end": last, "frequency": "30d"}, "steps": "6/to/24/by/6"},
        "group_by": "yearly",
        "input": {
            "concat": [
                {"base_dates": {"start": first, "end": cut - timedelta(days=30), "frequency": "30d"}, "bases_early": {}},
                late | {"steps": [6, 12], "bases_scaled": {"by": 2}},
                late | {"steps": {"start": "18h", "end": "24h", "frequency": "6h"}, "bases_scaled": {"by": -1}},
            ]
        },
    }
    return recipe.run(t.df.sparkSession, spec).drop("group")


on_traj(
    "recipe_concat_bases",
    "SELECT base_date, step_s, member, cell, CASE WHEN date_diff('day', (SELECT min(base_date) FROM traj), base_date) // 30 < 30 THEN q WHEN step_s <= 43200 THEN 2 * q ELSE -q END AS q FROM traj WHERE step_s <= 86400",
    recipe_bases,
)


def recipe_valid(t: Trajectories) -> DataFrame:
    """A recipe's valid dates out of trajectories that are its source."""
    SOURCES["forecasts"] = lambda spark, dates: t.select("q").df.filter(F.col("base_date").isin([str(d) for d in dates]))
    spec = {"dates": {"values": [b + 12 * HOUR for b in t.base_dates[12:24]]}, "group_by": 5, "input": {"from-trajectories": {"source": {"forecasts": {}}, "steps": [12, 6]}}}
    return recipe.run(t.df.sparkSession, spec).drop("group")


on_traj(
    "recipe_from_trajectories",
    "SELECT base_date + INTERVAL 12 HOUR AS date, member, cell, q FROM traj WHERE step_s = 43200 AND date_diff('day', (SELECT min(base_date) FROM traj), base_date) // 30 BETWEEN 12 AND 23",
    recipe_valid,
)


on_traj(
    "patch_valid_time",
    "SELECT base_date + to_seconds(step_s) AS date, member, cell, q AS quantity FROM traj WHERE step_s IN (21600, 43200)",
    lambda t: patches.patched(t.select("q").df, {"analysis_lead_to_valid_time": {"analysis": "base_date", "lead": "step_s", "unit": "seconds"}, "rename": {"q": "quantity"}, "subset": {"step_s": [21600, 43200]}}),
)


def on_dates(name: str, sql: str, f: Callable[[Cube], DataFrame]) -> None:
    QUERIES[name] = (lambda spark, sf_dir: f(cube(spark, sf_dir).select("q")), sql)


_T = ("1996-03-05", "1997-07-01", "1998-12-31")
_TARGETS = [datetime.fromisoformat(t) for t in _T]
_VALUES = ", ".join(f"(TIMESTAMP '{t}')" for t in _T)
on_dates(
    "repeated_closest",
    f"SELECT t AS date, member, cell, q FROM (SELECT t, (SELECT date FROM (SELECT DISTINCT date FROM cube) ORDER BY abs(epoch(date) - epoch(t)), date DESC LIMIT 1) AS s FROM (VALUES {_VALUES}) v(t)) JOIN cube ON date = s",
    lambda c: derived.repeated_closest(c.df, _TARGETS, c.dates),
)
on_dates(
    "repeated_climatology",
    "SELECT t AS date, member, cell, q FROM (VALUES (TIMESTAMP '1996-01-20'), (TIMESTAMP '1997-01-05')) v(t) JOIN cube ON date = TIMESTAMP '1995-01-31'",
    lambda c: derived.repeated_climatology(c.df, [datetime(1996, 1, 20), datetime(1997, 1, 5)], 1995, 31, 0),
)
on_dates(
    "repeated_constant",
    f"SELECT t AS date, member, cell, q FROM (VALUES {_VALUES}) v(t) JOIN c ON i = 4",
    lambda c: derived.repeated_constant(c.df, _TARGETS, c.dates[4]),
)


def hindcast_mean(c: Cube) -> DataFrame:
    """Statistics of a step's gridded view."""
    return stats(statistics.statistics(c))


QUERIES["traj_step_statistics"] = (
    lambda spark, sf_dir: hindcast_mean(trajectories(spark, sf_dir).step(6)),
    stats_sql("(SELECT * FROM traj WHERE step_s = 21600)"),
)
