"""Derived sources: accumulations, repeated dates, valid dates from trajectories."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratoframe.functions.timegrammar import frequency
from stratoframe.operators.side import side

#: Fixed value: each change of the base costs as much as so long an interval.
SWITCH = timedelta(days=7)


@dataclass(frozen=True, order=True)
class Interval:
    """A field accumulated from start to end in a forecast from base; sign -1 where it is subtracted."""

    start: datetime
    end: datetime
    base: datetime | None = None
    sign: int = 1


#: Which accumulations archives hold, by class and stream or origin: hours of the bases, then either the length
#: of consecutive pieces and the last step, or the steps up to which there are totals since the base.
AVAILABLE = {
    ("ea", "oper"): {"bases": (6, 18), "pieces": 1, "last": 18},
    ("ea", "enda"): {"bases": (6, 18), "pieces": 3, "last": 18},
    ("e6", "oper"): {"bases": (6, 18), "pieces": 1, "last": 18},
    ("e6", "enda"): {"bases": (6, 18), "pieces": 1, "last": 18},
    ("od", "oper"): {"bases": (0, 12), "totals": range(1, 91)},
    ("od", "elda"): {"bases": (6, 18), "totals": range(1, 13)},
    ("rr", "se-al-ec"): {"bases": (0,), "totals": (1, 2, 3, 4, 5, 6, 9, 12, 15, 18, 21, 24, 27, 30)},
    ("rr", "fr-ms-ec"): {"bases": (0,), "totals": range(1, 22, 3)},
    ("l5", "oper"): {"bases": (0,), "pieces": 1, "last": 24},
}


def archived(target: datetime, period: timedelta, key: tuple[str, str]) -> list[Interval]:
    """The intervals that accumulate to a target date over a period, from what an archive holds."""
    held = AVAILABLE[key]
    steps = [(0, s) for s in held["totals"]] if "totals" in held else [(s, s + held["pieces"]) for s in range(0, held["last"], held["pieces"])]
    return cover(target - period, target, lambda at: available([(hour, steps) for hour in held["bases"]], at))


def available(pattern: Sequence[tuple[int, Sequence[tuple[int, int]]]], around: datetime) -> list[Interval]:
    """Intervals of a pattern (base hour, [(first step, last step)]) in the days around a time, latest base first."""
    day = datetime(around.year, around.month, around.day)
    bases = [(day + timedelta(days=d, hours=hour), steps) for d in (-1, 0, 1) for hour, steps in pattern]
    return [Interval(b + timedelta(hours=s), b + timedelta(hours=e), b) for b, steps in sorted(bases, reverse=True, key=lambda x: x[0]) for s, e in steps]


def cover(start: datetime, end: datetime, candidates: Callable[[datetime], Sequence[Interval]], reach: timedelta = timedelta(days=5), limit: int = 20_000) -> list[Interval]:
    """The cheapest chain of intervals, forwards or backwards, that leads from start to end: lengths count whichever the direction, and each change of base costs ``SWITCH``.

    A place is a time and the base that led there. Costs are relaxed in rounds: places that became cheaper in one round pass
    their cost on in the next, until none does. Times are looked at within ``reach`` of the period; nothing dearer than
    the best way to the end so far is followed.
    """
    lengths = lambda i: i.end - i.start
    touching: dict[datetime, list[tuple[datetime, Interval]]] = {}

    def moves(at: datetime) -> list[tuple[datetime, Interval]]:
        if at not in touching:
            held = [(i.end, i) for i in candidates(at) if i.start == at] + [(i.start, Interval(i.start, i.end, i.base, -1)) for i in candidates(at) if i.end == at]
            touching[at] = [(to, i) for to, i in held if start - reach <= to <= end + reach]
        return touching[at]

    cost: dict[tuple[datetime, datetime | None], timedelta] = {(start, None): timedelta(0)}
    came: dict[tuple[datetime, datetime | None], tuple[tuple[datetime, datetime | None], Interval]] = {}
    cheaper = [(start, None)]
    while cheaper:
        if len(cost) > limit:
            raise ValueError(f"over {limit} places between {start} and {end}: take a shorter reach")
        best = min((c for (at, _), c in cost.items() if at == end), default=timedelta.max)
        improved: dict[tuple[datetime, datetime | None], None] = {}
        for place in cheaper:
            for to, interval in moves(place[0]):
                total = cost[place] + lengths(interval) + (SWITCH if place[1] is not None and interval.base != place[1] else timedelta(0))
                there = (to, interval.base)
                if total < best and total < cost.get(there, timedelta.max):
                    cost[there], came[there] = total, (place, interval)
                    improved[there] = None
        cheaper = list(improved)
    ends = [place for place in cost if place[0] == end]
    if not ends:
        raise ValueError(f"no intervals cover {start} to {end}")
    place, path = min(ends, key=cost.__getitem__), []
    while place in came:
        place, interval = came[place]
        path.append(interval)
    return path[::-1]


def forecast_cover(base: datetime, start: datetime, end: datetime, mode: str = "from-zero") -> list[Interval]:
    """[base, end] less [base, start], or the one interval from start."""
    if start < base:
        raise ValueError("an accumulation can't begin before its base")
    if any((x - base) % timedelta(hours=1) for x in (start, end)):
        raise ValueError("steps are whole hours")
    if mode == "from-previous-step" or start == base:
        return [Interval(start, end, base)]
    return [Interval(base, end, base), Interval(base, start, base, -1)]


def accumulate(fields: DataFrame, targets: Sequence[tuple[datetime, Sequence[Interval]]], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """date, keys, values: the signed sum of each target's intervals of fields (start, end, base, keys, values). A target that lacks a field is an error when read."""
    rows = [(str(t), str(i.start), str(i.end), str(i.base) if i.base else None, i.sign) for t, plan in targets for i in plan]
    plan = fields.sparkSession.createDataFrame(rows, "d string, s string, e string, b string, sign int")
    plan = plan.select(*[F.col(c).cast("timestamp_ntz").alias(n) for c, n in (("d", "date"), ("s", "start"), ("e", "end"), ("b", "base"))], "sign")
    return accumulate_planned(fields, plan, keys, values, len(rows))


def accumulate_planned(fields: DataFrame, plan: DataFrame, keys: Sequence[str], values: Sequence[str], rows: int | None = None) -> DataFrame:
    """The same with the intervals in a table (date, start, end, base, sign), as ``coverings.plan`` makes it; fields and intervals without a base meet."""
    expected = plan.groupBy("date").agg(F.count("*").alias("_expected"))
    planned = plan.join(side(expected, rows), "date").withColumnsRenamed({"start": "_start", "end": "_end", "base": "_base"})
    same = (F.col("start") == F.col("_start")) & (F.col("end") == F.col("_end")) & F.col("base").eqNullSafe(F.col("_base"))
    joined = fields.join(side(planned, rows), same)
    summed = joined.groupBy("date", *keys).agg(F.count("*").alias("_n"), F.first("_expected").alias("_expected"), *[F.sum(F.col("sign") * F.col(v)).alias(v) for v in values])
    complete = F.when(F.col("_n") == F.col("_expected"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("incomplete accumulation at "), F.col("date").cast("string"))).cast("boolean"))
    return summed.filter(complete).select("date", *keys, *values)


def repeated_closest(df: DataFrame, targets: Sequence[datetime], present: Sequence[datetime], step: int | str | timedelta = "1h", maximum: int | str | timedelta = "30d") -> DataFrame:
    """For each target the rows of the nearest present date within ``maximum`` on the frequency's raster; of two as near the later."""
    pitch, most = frequency(step), frequency(maximum)
    pairs = []
    for t in targets:
        near = [(abs(p - t), -(p - t), p) for p in present if abs(p - t) <= most and not (p - t) % pitch]
        if not near:
            raise ValueError(f"no date within {most} of {t}")
        pairs.append((t, min(near)[2]))
    return rewritten(df, pairs)


def repeated_climatology(df: DataFrame, targets: Sequence[datetime], year: int, day: int, hour: int | None = None) -> DataFrame:
    """For each target the rows of its month in a given year and day."""
    return rewritten(df, [(t, t.replace(year=year, day=day, minute=0, second=0, **({} if hour is None else {"hour": hour}))) for t in targets])


def repeated_constant(df: DataFrame, targets: Sequence[datetime], at: datetime | None = None) -> DataFrame:
    """For each target the rows of one date; without a date, of a table that has none."""
    if at is not None:
        return rewritten(df, [(t, at) for t in targets])
    dates = df.sparkSession.createDataFrame([(str(t),) for t in targets], "d string").select(F.col("d").cast("timestamp_ntz").alias("date"))
    return df.withColumn("_one", F.lit(1)).join(side(dates.withColumn("_one", F.lit(1)), len(targets)), "_one").drop("_one")


def rewritten(df: DataFrame, pairs: Sequence[tuple[datetime, datetime]]) -> DataFrame:
    """Rows of source dates under target dates."""
    table = df.sparkSession.createDataFrame([(str(t), str(s)) for t, s in pairs], "t string, s string").select(F.col("t").cast("timestamp_ntz").alias("_to"), F.col("s").cast("timestamp_ntz").alias("date"))
    return df.join(side(table, len(pairs)), "date").withColumn("date", F.col("_to")).drop("_to")


def from_trajectories(df: DataFrame, steps: Sequence[int], bases: str = "*") -> DataFrame:
    """Valid dates of trajectories (base_date, step_s, ...): of several (base, step) for a date the first step, in the order given, whose base (as 2020-01-01T00) matches the pattern. The earliest base wins among equals."""
    like = fnmatch.translate(bases).replace("(?s:", "(?s)(?:").replace(r"\z", r"\Z").replace(r"\Z", "$")
    order = F.array_position(F.array(*[F.lit(s * 3600) for s in steps]), F.col("step_s"))
    rows = df.filter(F.col("step_s").isin([s * 3600 for s in steps]) & F.date_format("base_date", "yyyy-MM-dd'T'HH").rlike(f"^{like}")).withColumn("_order", order)
    valid = F.col("base_date") + F.make_dt_interval(secs=F.col("step_s").cast("decimal(18,6)"))
    ranked = rows.withColumn("date", valid).withColumn("_k", F.dense_rank().over(Window.partitionBy("date", "member", "cell").orderBy("_order", "base_date")))
    return ranked.filter("_k = 1").drop("_k", "_order", "base_date", "step_s")


def requests(dates: Sequence[datetime], steps: Sequence[int], **fixed: object) -> Iterator[dict]:
    """One archive request for each base and step that a valid date needs, compressed: equal requests for several dates become one."""
    found: dict[tuple, set[str]] = {}
    for valid in dates:
        for s in steps:
            base = valid - timedelta(hours=s)
            stream = "scda" if fixed.get("stream") == "oper" and fixed.get("class") == "od" and base.hour in (6, 18) else fixed.get("stream")
            found.setdefault((base.strftime("%H%M"), s, stream), set()).add(base.strftime("%Y-%m-%d"))
    for (time, s, stream), days in found.items():
        yield fixed | ({"stream": stream} if stream else {}) | {"date": sorted(days), "time": time, "step": s}
