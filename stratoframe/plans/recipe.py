"""Build recipes: a tree of sources, filters, joins and concatenations over groups of dates, as one lazy plan, and its sink."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.functions.timegrammar import calendar_filter, expand, frequency, groups, hindcast_requests, part, spine
from stratoframe.operators import combine, coverings, derived, statistics
from stratoframe.operators.cube import KEYS, Cube, on_dates
from stratoframe.operators.side import side
from stratoframe.operators.trajectories import TKEYS
from stratoframe.plans.dataset import open_dataset
from stratoframe.sources.registry import FILTERS, SOURCES

CALENDAR = ("weekday", "pattern", "day_of_month", "months")
Named = dict[str, DataFrame]


def _at(value: object) -> datetime:
    return datetime.fromisoformat(str(value))


class Bases(list):
    """Base dates of forecasts, and the steps (hours) that are asked for of each of them."""

    def __init__(self, dates: Iterable[datetime], steps: Iterable[int]) -> None:
        super().__init__(dates)
        self.steps = tuple(steps)


#: What a choice of a concatenation may be limited by.
CHOICE = ("dates", "base_dates", "steps")


def steps_of(spec: object) -> tuple[int, ...]:
    """Steps in hours: a list, "0/to/24/by/6", or {start, end, frequency}."""
    if isinstance(spec, dict):
        first, last, step = (int(frequency(spec[k]).total_seconds()) for k in ("start", "end", "frequency"))
        if any(x % 3600 for x in (first, last, step)):
            raise ValueError("steps are whole hours")
        return tuple(range(first // 3600, last // 3600 + 1, step // 3600))
    return tuple(int(x) for x in expand(spec))


def time_of(df: DataFrame) -> str:
    """The date column of rows: base_date of forecasts."""
    return "base_date" if "base_date" in df.columns else "date"


def keys_of(df: DataFrame) -> tuple[str, ...]:
    return TKEYS if "base_date" in df.columns else KEYS


def asked(df: DataFrame, dates: Sequence[datetime]) -> DataFrame:
    """The rows of the dates (of base dates: and steps) that are asked for."""
    found = on_dates(df, dates, time_of(df))
    return found.filter(F.col("step_s").isin([3600 * h for h in dates.steps])) if isinstance(dates, Bases) else found


def dates_of(spec: dict) -> tuple[list[datetime], list[datetime]]:
    """All dates and the missing ones of {start, end, frequency, missing, calendar filters}, {values}, {hindcasts: {reference, years, steps}} or, for forecasts, {base_dates: one of these, steps}."""
    if "base_dates" in spec:
        bases, missing = dates_of(spec["base_dates"])
        return Bases(bases, steps_of(spec["steps"])), missing
    if "values" in spec:
        return [_at(v) for v in spec["values"]], []
    if "hindcasts" in spec:
        h = spec["hindcasts"]
        return sorted({r["valid"] for r in hindcast_requests([_at(r) for r in h["reference"]], h["years"], expand(h.get("steps", (0,))))}), []
    start, end = (_at(spec[k]) for k in ("start", "end"))
    missing = []
    for m in spec.get("missing", ()):
        missing += spine(*(_at(m[k]) for k in ("start", "end")), frequency(m.get("frequency", spec["frequency"]))) if isinstance(m, dict) else [_at(m)]
    dates = spine(start, end, frequency(spec["frequency"]))
    return calendar_filter(dates, **{k: spec[k] for k in CALENDAR if k in spec}), missing


# -- nodes: functions from (spark, body, dates, named) to rows

NODES: dict[str, Callable[[SparkSession, object, Sequence[datetime], Named], DataFrame]] = {}


def node(name: str) -> Callable:
    return lambda f: NODES.setdefault(name, f)


@node("join")
def _join(spark: SparkSession, body: list, dates: Sequence[datetime], named: Named) -> DataFrame:
    parts = [build(spark, n, dates, named) for n in body]
    return reduce(lambda a, b: a.join(b, list(keys_of(parts[0]))), parts)


@node("pipe")
def _pipe(spark: SparkSession, body: list, dates: Sequence[datetime], named: Named) -> DataFrame:
    first, *filters = body
    df = build(spark, first, dates, named)
    for f in filters:
        (name, options) = next(iter(f.items()))
        df = FILTERS[name](df, **(options or {}))
    return df


def routed(choices: Sequence[dict], dates: Sequence[datetime]) -> list[Sequence[datetime]]:
    """The part of the dates (of base dates: and steps) that each choice is for.

    Base dates and steps are two axes: a choice is for the pairs of some of either. Each pair that is asked for must be in one
    choice: as choices are rectangles, that is so if no two meet and their areas add up to that of the request.
    """
    if not isinstance(dates, Bases):
        return [[d for d in dates if d in listed] for listed in (set(dates_of(c["dates"])[0]) for c in choices)]
    parts = []
    for c in choices:
        if not any(k in c for k in CHOICE):
            raise ValueError(f"a choice has one of {CHOICE}")
        listed = set(dates_of(c.get("base_dates", c.get("dates")))[0]) if "base_dates" in c or "dates" in c else set(dates)
        steps = set(steps_of(c["steps"])) if "steps" in c else set(dates.steps)
        parts.append(Bases([d for d in dates if d in listed], [h for h in dates.steps if h in steps]))
    for k, a in enumerate(parts):
        for j in range(k):
            if (both := set(a) & set(parts[j])) and (steps := set(a.steps) & set(parts[j].steps)):
                raise ValueError(f"{min(both)} + {min(steps)} h is in choices {j} and {k}")
    if sum(len(p) * len(p.steps) for p in parts) < len(set(dates)) * len(set(dates.steps)):
        d, h = next((d, h) for d in dates for h in dates.steps if not any(d in set(p) and h in p.steps for p in parts))
        raise ValueError(f"no choice has {d} + {h} h")
    return parts


@node("concat")
def _concat(spark: SparkSession, body: list, dates: Sequence[datetime], named: Named) -> DataFrame:
    """Choices for parts of the dates (``dates``), or of forecasts' base dates and steps (``base_dates``, ``steps``)."""
    parts = []
    for choice, own in zip(body, routed(body, dates), strict=True):
        if own and getattr(own, "steps", True):
            parts.append(asked(build(spark, {k: v for k, v in choice.items() if k not in CHOICE}, own, named), own))
    return reduce(DataFrame.unionByName, parts)


@node("ref")
def _ref(spark: SparkSession, body: str, dates: Sequence[datetime], named: Named) -> DataFrame:
    return named[body]


@node("dataset")
def _dataset(spark: SparkSession, body: dict, dates: Sequence[datetime], named: Named) -> DataFrame:
    """Another dataset, opened with any keywords."""
    return asked(open_dataset(spark, **body).rows(), dates)


@node("repeated_dates")
def _repeated(spark: SparkSession, body: dict, dates: Sequence[datetime], named: Named) -> DataFrame:
    """A source's dates under other ones: {source, mode: closest (dates, frequency, maximum), climatology (year, day, hour) or constant (date)}."""
    mode, source = body["mode"], body["source"]
    if mode == "closest":
        most = frequency(body.get("maximum", "30d"))
        lo, hi = min(dates) - most, max(dates) + most
        present = [d for d in dates_of(body["dates"])[0] if lo <= d <= hi]
        return derived.repeated_closest(build(spark, source, present, named), dates, present, body.get("frequency", "1h"), most)
    if mode == "climatology":
        year, day, hour = body["year"], body["day"], body.get("hour")
        wanted = sorted({d.replace(year=year, day=day, minute=0, second=0, **({} if hour is None else {"hour": hour})) for d in dates})
        return derived.repeated_climatology(build(spark, source, wanted, named), dates, year, day, hour)
    if mode == "constant":
        at = _at(body["date"]) if "date" in body else None
        return derived.repeated_constant(build(spark, source, [at] if at else [], named), dates, at)
    raise ValueError(f"unknown mode of repeated dates: {mode!r}")


@node("recentre")
def _recentre(spark: SparkSession, body: dict, dates: Sequence[datetime], named: Named) -> DataFrame:
    """Members around another centre: {members, centre, alpha}."""

    def rows_of(name: str) -> Cube:
        df = build(spark, body[name], dates, named)
        return Cube(df, tuple(c for c in df.columns if c not in KEYS), min(dates), max(dates), timedelta(0), 0, 0)

    return combine.recentred(rows_of("members"), rows_of("centre"), body.get("alpha", 1.0)).rows()


@node("from-trajectories")
def _from_trajectories(spark: SparkSession, body: dict, dates: Sequence[datetime], named: Named) -> DataFrame:
    """Valid dates of a source's trajectories: {source, steps (hours), bases (pattern)}. The source is asked for base dates."""
    steps = expand(body["steps"])
    bases = sorted({d - timedelta(hours=s) for d in dates for s in steps})
    return on_dates(derived.from_trajectories(build(spark, body["source"], bases, named), steps, body.get("bases", "*")), dates)


@node("accumulate")
def _accumulate(spark: SparkSession, body: dict, dates: Sequence[datetime], named: Named) -> DataFrame:
    """Accumulations over a period: {source, period, archive: (class, stream), keys, values}. The source, asked for base dates, has fields (start, end, base, keys, values).

    Without an archive the intervals are those that the source itself (or the node ``index``) holds: it is asked for the dates from ``reach`` before the first period on.
    """
    if "archive" not in body:
        reach, step = frequency(body.get("reach", "1d")), frequency(body.get("frequency", "1h"))
        asked = spine(min(dates) - frequency(body["period"]) - reach, max(dates) + reach, step)
        index = build(spark, body["index"], asked, named) if "index" in body else None
        return coverings.accumulate(build(spark, body["source"], asked, named), dates, body["period"], body.get("keys", ("member", "cell")), body["values"], index, reach, body.get("missing", "error"))
    targets = [(d, derived.archived(d, frequency(body["period"]), tuple(body["archive"]))) for d in dates]
    bases = sorted({i.base for _, plan in targets for i in plan})
    return derived.accumulate(build(spark, body["source"], bases, named), targets, body.get("keys", ("member", "cell")), body["values"])


def build(spark: SparkSession, spec: dict, dates: Sequence[datetime], named: Named | None = None) -> DataFrame:
    """The rows of one node: one of ``NODES`` by its name, else {name: options} of a source."""
    (kind, body) = next(iter(spec.items()))
    if kind in NODES:
        return NODES[kind](spark, body, dates, named or {})
    return SOURCES[kind](spark, dates, **(body or {}))


# -- recipes


def problems(recipe: dict) -> list[str]:
    """What is wrong with a recipe, without reading anything."""
    found = [f"no {k}" for k in ("dates", "input") if k not in recipe]

    def check(spec: object, where: str) -> Iterator[str]:
        if not isinstance(spec, dict) or len(set(spec) - set(CHOICE)) != 1:
            yield f"{where}: a node has one name"
            return
        kind = next(k for k in spec if k not in CHOICE)
        body = spec[kind]
        if kind not in NODES and kind not in SOURCES:
            yield f"{where}: unknown source {kind!r}"
        if kind in ("join", "concat"):
            for k, child in enumerate(body):
                if kind == "concat" and not any(k in child for k in CHOICE):
                    yield f"{where}/concat[{k}]: no dates"
                yield from check(child, f"{where}/{kind}[{k}]")
        elif kind == "pipe":
            yield from check(body[0], f"{where}/pipe[0]")
            yield from (f"{where}/pipe: unknown filter {name!r}" for f in body[1:] for name in f if name not in FILTERS)
        elif kind == "ref" and body not in recipe.get("data_sources", {}):
            yield f"{where}: no data source {body!r}"
        elif isinstance(body, dict) and kind in NODES:
            for name in ("source", "members", "centre"):
                if name in body:
                    yield from check(body[name], f"{where}/{kind}/{name}")

    if "input" in recipe:
        found += check(recipe["input"], "input")
    for name, spec in recipe.get("data_sources", {}).items():
        found += check(spec, f"data_sources/{name}")
    return found


def dealt(recipe: dict) -> list[list[datetime]]:
    """The groups of dates, missing ones left out."""
    dates, missing = dates_of(recipe["dates"])
    return groups(dates, recipe.get("group_by", "monthly"), missing)


def run(spark: SparkSession, recipe: dict, only: str | None = None, done: Sequence[int] = ()) -> DataFrame | None:
    """All groups' rows (or those of part "i/n", less those that are done; None where none is left). The group's number is a column to partition the output by."""
    dates, parts = dates_of(recipe["dates"])[0], dealt(recipe)
    kept = [k for k in (part(len(parts), only) if only else range(len(parts))) if k not in set(done)]
    if not kept:
        return None
    # all groups are one plan; a table of dates says which group a row is in
    table = [(str(d), k) for k in kept for d in parts[k]]
    wanted = [d for k in kept for d in parts[k]]
    wanted = Bases(wanted, dates.steps) if isinstance(dates, Bases) else wanted
    named = {name: build(spark, spec, dates) for name, spec in recipe.get("data_sources", {}).items()}
    rows = build(spark, recipe["input"], wanted, named)
    of = spark.createDataFrame(table, "at string, `group` int").select(F.col("at").cast("timestamp_ntz").alias(time_of(rows)), "group")
    return rows.join(side(of, len(table)), time_of(rows)).select(*rows.columns, "group")


def done_groups(spark: SparkSession, path: str) -> list[int]:
    """Groups that a build has written whole (one row for each)."""
    try:
        return sorted(r[0] for r in spark.read.parquet(f"{path}/done").select("group").distinct().collect())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def load(spark: SparkSession, recipe: dict, path: str, only: str | None = None) -> list[int]:
    """Writes the groups (of a part) that aren't done, then marks them as done; returns them. Groups replace what a build that was cut off has left of them, so a repeated call adds nothing twice and parts may run side by side."""
    if wrong := problems(recipe):
        raise ValueError("; ".join(wrong))
    before = set(done_groups(spark, path))
    rows = run(spark, recipe, only, sorted(before))
    if rows is None:
        return []
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group").parquet(f"{path}/data")
    n = len(dealt(recipe))
    fresh = [k for k in (part(n, only) if only else range(n)) if k not in before]
    spark.createDataFrame([(k,) for k in fresh], "`group` int").coalesce(1).write.mode("append").parquet(f"{path}/done")
    return fresh


def finalise(spark: SparkSession, recipe: dict, path: str) -> DataFrame:
    """Once all groups are done: statistics of all variables, written beside the data and returned."""
    if lacking := set(range(len(dealt(recipe)))) - set(done_groups(spark, path)):
        raise ValueError(f"groups {sorted(lacking)[:5]} aren't done")
    rows = spark.read.parquet(f"{path}/data").drop("group")
    statistics.summary(rows, [c for c in rows.columns if c not in keys_of(rows)]).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    return spark.read.parquet(f"{path}/statistics")


def incomplete(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What keeps a cube from being whole: keys' values that occur another number of times than the others, with their counts."""
    whole = df.agg(*[F.count_distinct(k).alias(k) for k in keys]).first()
    total = 1
    for k in keys:
        total *= whole[k]
    tables = [df.groupBy(F.col(k).cast("string").alias("value")).agg(F.count("*").alias("n")).filter(F.col("n") != total // whole[k]).withColumn("key", F.lit(k)) for k in keys]
    return reduce(DataFrame.unionByName, tables).select("key", "value", "n")
