"""Operators along the time axis: gap filling, interpolation, rolling windows, tendencies.

All are window functions partitioned by member and cell and ordered by the date's ordinal, so a plan has one shuffle on
(member, cell) however many variables it covers.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratoframe.functions import geo
from stratoframe.functions.timegrammar import frequency
from stratoframe.operators.cube import KEYS, Cube, MissingDateError, skip_nan, stamp
from stratoframe.operators.side import cut, side

SERIES = ("member", "cell")


def date_table(cube: Cube) -> DataFrame:
    """i, date, missing: the whole spine, made on the executors."""
    step = int(cube.frequency.total_seconds())
    n = len(cube.dates)
    spine = cube.df.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    at = stamp(cube.start) + F.make_dt_interval(secs=(F.col("i").cast("long") * step).cast("decimal(18,6)"))
    gone = F.col("i").isin(cube.missing_indices) if cube.missing else F.lit(False)
    return spine.select("i", at.alias("date"), gone.alias("missing"))


def fill_missing(cube: Cube, method: str = "closest", closest: str = "up") -> Cube:
    """Missing dates get the nearest present date's rows (by ordinal; of two as near the later with "up"), or the linear interpolation of both neighbours."""
    gone = set(cube.missing_indices)
    present = [k for k in range(len(cube.dates)) if k not in gone]
    if not present:
        raise MissingDateError("all dates are missing")
    plan = []  # target, source, weight
    for k in gone:
        at = bisect(present, k)
        before, after = present[at - 1] if at else None, present[at] if at < len(present) else None
        if method == "interpolate":
            if before is None or after is None:
                raise MissingDateError(f"{cube.dates[k]} has no present dates on both sides")
            alpha = (k - before) / (after - before)
            plan += [(k, before, 1 - alpha), (k, after, alpha)]
        elif method == "closest":
            later = before is None or (after is not None and (after - k < k - before or (after - k == k - before and closest == "up")))
            plan.append((k, after if later else before, 1.0))
        else:
            raise ValueError(f"unknown filling: {method!r}")
    if not plan:
        return cube
    dates = cube.dates
    table = cube.df.sparkSession.createDataFrame([(str(dates[t]), str(dates[s]), w) for t, s, w in plan], "to string, of string, weight double")
    table = table.select(F.col("to").cast("timestamp_ntz").alias("to"), F.col("of").cast("timestamp_ntz").alias("date"), "weight")
    sources = cube.df.join(side(table, len(plan)), "date").withColumn("date", F.col("to"))
    if method == "closest":
        made = sources.select(*KEYS, *cube.variables)
    else:
        made = sources.groupBy(*KEYS).agg(*[F.sum(F.col(v) * F.col("weight")).alias(v) for v in cube.variables])
    return cube.with_("fill_missing", df=cube.rows().unionByName(made), missing=frozenset())


def interpolate_frequency(cube: Cube, step: int | str | timedelta) -> Cube:
    """A finer frequency, linear between consecutive dates; slots next to a missing date are missing."""
    wanted = frequency(step)
    ratio, rest = divmod(cube.frequency, wanted)
    if rest or ratio < 2:
        raise ValueError(f"{wanted} doesn't divide {cube.frequency}")
    order = Window.partitionBy(*SERIES).orderBy("date")
    nexts = [F.lead(v).over(order).alias(f"_next_{k}") for k, v in enumerate(cube.variables)]
    rows = cube.df.select(*KEYS, *cube.variables, *nexts, F.lead("date").over(order).alias("_until"))
    # a row without a next one (the last date's, or one before a hole) stands alone
    follows = F.coalesce(F.col("_until") == F.col("date") + F.expr(f"interval {int(cube.frequency.total_seconds())} seconds"), F.lit(False))
    rows = rows.withColumn("_j", F.explode(F.when(follows, F.sequence(F.lit(0), F.lit(ratio - 1))).otherwise(F.array(F.lit(0)))))
    alpha = F.col("_j") / ratio
    values = [F.when(F.col("_j") == 0, F.col(v)).otherwise((1 - alpha) * F.col(v) + alpha * F.col(f"_next_{k}")).alias(v) for k, v in enumerate(cube.variables)]
    at = (F.col("date") + F.make_dt_interval(secs=(F.col("_j").cast("long") * int(wanted.total_seconds())).cast("decimal(18,6)"))).alias("date")
    out = rows.select(at, "member", "cell", *values)
    fresh = cube.with_("interpolate_frequency", df=out, frequency=wanted, missing=frozenset())
    bad = set()
    for k in cube.missing_indices:
        bad |= set(range(max(0, (k - 1) * ratio + 1), min(len(fresh.dates), (k + 1) * ratio)))
    return fresh.with_("interpolate_frequency", missing=frozenset(fresh.dates[k] for k in bad))


def rolling_average(cube: Cube, before: int, after: int) -> Cube:
    """Mean of the present values from ``before`` dates back to ``after`` dates ahead (before is negative); edges are dropped, windows that meet a missing date fail when read."""
    a = -before
    n = len(cube.dates)
    if a < 0 or after < 0 or n - a - after < 1:
        raise ValueError(f"no window from {before} to {after} fits into {n} dates")
    frame = Window.partitionBy(*SERIES).orderBy(cube.date_idx).rangeBetween(-a, after)
    dates = cube.dates
    out = cube.df.select(*KEYS, *[F.avg(skip_nan(F.col(v))).over(frame).alias(v) for v in cube.variables]).filter(F.col("date").between(stamp(dates[a]), stamp(dates[n - 1 - after])))
    gone = set(cube.missing_indices)
    missing = frozenset(dates[k] for k in range(a, n - after) if gone & set(range(k - a, k + after + 1)))
    return cube.with_("rolling_average", df=out, start=dates[a], end=dates[n - 1 - after], missing=missing)


_REDUCERS = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "std": F.stddev_samp, "median": F.median, "count": F.count}


def rolling_operation(cube: Cube, steps: int, operation: str, variables: Sequence[str] | None = None) -> Cube:
    """A trailing window of so many dates (not rows); those that lack a full window, at the start or by a hole, are null."""
    names = list(variables or cube.variables)
    frame = Window.partitionBy(*SERIES).orderBy(cube.date_idx).rangeBetween(-(steps - 1), 0)

    def rolled(v: str) -> Column:
        value = skip_nan(F.col(v))
        return F.when(F.count(value).over(frame) == steps, _REDUCERS[operation](value).over(frame)).alias(v)

    return cube.with_("rolling_operation", df=cube.df.select(*KEYS, *[rolled(v) if v in names else F.col(v) for v in cube.variables]))


def tendencies(cube: Cube, delta: int | str | timedelta) -> Cube:
    """x(t) - x(t - delta) on the dates that have both; a date with a missing one delta before is missing too."""
    k, rest = divmod(frequency(delta), cube.frequency)
    if rest or k < 1 or k >= len(cube.dates):
        raise ValueError(f"{delta} isn't a multiple of {cube.frequency} within the dates")
    # exactly k dates before, however many rows lie between
    earlier = Window.partitionBy(*SERIES).orderBy(cube.date_idx).rangeBetween(-k, -k)
    both = cube.df.select(*KEYS, *cube.variables, *[F.first(v).over(earlier).alias(f"_before_{j}") for j, v in enumerate(cube.variables)], F.count("*").over(earlier).alias("_there"))
    out = both.filter("_there > 0").select(*KEYS, *[(F.col(v) - F.col(f"_before_{j}")).alias(v) for j, v in enumerate(cube.variables)])
    gone = set(cube.missing_indices)
    missing = frozenset(cube.dates[j] for j in range(k, len(cube.dates)) if j in gone or j - k in gone)
    return cube.with_("tendencies", df=out, start=cube.dates[k], missing=missing)


def _point(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    far = pairs.withColumn("distance", geo.chord(_point("x", "y", "z"), _point("x2", "y2", "z2")))
    return far.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("distance", "source"))).filter(F.col("rank") <= k).select("target", "source", "distance", "rank")


def _descend(here: DataFrame, there: DataFrame, n: int, k: int, levels: int, limit: float | None) -> DataFrame:
    """Pairs of each target and the sources in the smallest boxes that may hold one of its k nearest.

    The sources' boxes halve from level to level. A target keeps the boxes that are no farther than the k-th source can
    be at most (and than the limit), so it meets the few boxes on the near side of a far area, not all of its points.
    """
    box = lambda c, level: F.least(F.floor((F.col(c) + 1.05) / (2.1 / (1 << level))), F.lit((1 << level) - 1)).cast("long")
    code = lambda level: reduce(lambda a, b: a * (1 << 20) + b, [box(c, level) for c in ("x2", "y2", "z2")])
    state = here.withColumn("box", F.lit(0).cast("long"))
    axes = (("x", "x2"), ("y", "y2"), ("z", "z2"))
    by_target = Window.partitionBy("target")
    for level in range(1, levels + 1):
        bounds = [f(c).alias(f"{name}_{c}") for _, c in axes for name, f in (("lo", F.min), ("hi", F.max))]
        boxes = there.groupBy(code(level - 1).alias("box"), code(level).alias("inner")).agg(F.count("*").alias("n"), *bounds)
        met = state.join(side(boxes, min(n, 8**level)), "box")
        least = [F.greatest(F.col(f"lo_{b}") - F.col(a), F.col(a) - F.col(f"hi_{b}"), F.lit(0.0)) for a, b in axes]
        most = [F.greatest(F.abs(F.col(a) - F.col(f"lo_{b}")), F.abs(F.col(a) - F.col(f"hi_{b}"))) for a, b in axes]
        length = lambda parts: F.sqrt(reduce(lambda p, q: p + q, [v * v for v in parts]))
        met = met.select("target", "x", "y", "z", "inner", "n", length(least).alias("least"), length(most).alias("most"))
        met = met.withColumn("within", F.sum("n").over(by_target.orderBy("most", "inner").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        met = met.withColumn("reach", F.min(F.when(F.col("within") >= k, F.col("most"))).over(by_target))
        kept = F.coalesce(F.col("least") <= F.col("reach") + 1e-12, F.lit(True))
        if limit is not None:
            kept &= F.col("least") <= limit + 1e-12
        state = met.filter(kept).select("target", "x", "y", "z", F.col("inner").alias("box"))
    return state.join(side(there.withColumn("box", code(levels)), n), "box")


def nearest(targets: DataFrame, sources: DataFrame, k: int = 1, max_km: float | None = None) -> DataFrame:
    """target, source, distance (chord), rank: each target's k nearest source points.

    Points fall into cells of the unit cube. A target looks into its own and the 26 cells around; if these hold k points
    within one cell's width they are the nearest, and the target is done. The others search the sources' boxes from the
    largest to the smallest (``_descend``), so nowhere do all targets meet all sources.
    """
    x, y, z = geo.xyz(F.col("latitude"), F.col("longitude"))
    here = targets.select(F.col("cell").alias("target"), x.alias("x"), y.alias("y"), z.alias("z"))
    there = sources.select(F.col("cell").alias("source"), x.alias("x2"), y.alias("y2"), z.alias("z2"))
    limit = geo.chord_of_km(max_km) if max_km is not None else None
    n = sources.count()
    width = min(2.1, 4.0 / max(1.0, n**0.5))
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    own = here.withColumns({"cx": cell("x"), "cy": cell("y"), "cz": cell("z")})
    for c in ("cx", "cy", "cz"):
        own = own.withColumn("d", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))).withColumn(c, F.col(c) + F.col("d")).drop("d")
    spread = there.withColumns({"cx": cell("x2"), "cy": cell("y2"), "cz": cell("z2")})
    found = _ranked(own.join(side(spread, n), ["cx", "cy", "cz"]), k)
    if width < 2.1 and (limit is None or limit > width):
        found = cut(found)
        done = found.groupBy("target").agg(F.count(F.when(F.col("distance") <= width, 1)).alias("n")).filter(F.col("n") >= k).select("target")
        left = cut(here.join(done, "target", "left_anti"))
        if left.limit(1).count():
            levels = math.ceil(math.log2(2.1 / width))
            found = found.join(done, "target", "left_semi").unionByName(_ranked(_descend(left, there, n, k, levels, limit), k))
    return found.filter(F.col("distance") <= limit) if limit is not None else found


def interpolate_nearest_cells(cube: Cube, variables: Sequence[str], max_km: float | None = None) -> Cube:
    """Each cell of a variable takes the values of the nearest cell that has a value on the first date.

    Variables that have values at the same cells then (told by a sum of the cells' hashes) share one search and one pass over the cube.
    """
    has = [F.max(skip_nan(F.col(v)).isNotNull()).alias(f"_has{k}") for k, v in enumerate(variables)]
    first = cut(cube.df.filter(F.col("date") == stamp(cube.start)).groupBy("cell").agg(*has))
    marks = first.agg(*[F.sum(F.when(F.col(f"_has{k}"), F.xxhash64("cell")).cast("decimal(38,0)")) for k in range(len(variables))]).first()
    alike: dict[object, list[int]] = {}
    for k, mark in enumerate(marks):
        alike.setdefault(mark, []).append(k)
    df = cube.df
    for places in alike.values():
        filled, names = first.filter(f"_has{places[0]}").select("cell"), [variables[k] for k in places]
        pairs = cut(nearest(cube.grid, cube.grid.join(filled, "cell", "left_semi"), 1, max_km).select(F.col("target"), F.col("source").alias("cell")))
        values = cube.df.select(*KEYS, *[F.col(v).alias(f"_v{k}") for k, v in enumerate(names)]).join(side(pairs, cube.cells), "cell").drop("cell").withColumnRenamed("target", "cell")
        df = df.drop(*names).join(values, list(KEYS), "left").withColumnsRenamed({f"_v{k}": v for k, v in enumerate(names)})
    return cube.with_("interpolate_nearest_cells", df=df.select(*KEYS, *cube.variables))


