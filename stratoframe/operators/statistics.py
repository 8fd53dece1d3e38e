"""Statistics of variables: one aggregation over wide rows, NaN left out, population deviation.

Spark's mean and deviation keep mergeable partial sums, so partial aggregation happens where the rows are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratoframe.functions import geo
from stratoframe.functions.timegrammar import frequency, frequency_text, statistics_range
from stratoframe.operators.cube import Cube, skip_nan
from stratoframe.operators.series import SERIES

FIELDS = ("mean", "stdev", "minimum", "maximum", "count")


def summary(df: DataFrame, variables: Sequence[str], nan: bool = True) -> DataFrame:
    """variable, mean, stdev, minimum, maximum, count over all rows of a wide table; variables without values have null."""

    def of(v: str) -> Column:
        x = skip_nan(F.col(v).cast("double")) if nan else F.col(v).cast("double")
        return F.struct(F.lit(v).alias("variable"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stdev"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.count(x).alias("count"))

    return df.agg(F.array(*[of(v) for v in variables]).alias("all")).select(F.inline("all"))


def statistics(cube: Cube, start: object = None, end: object = None, default_range: bool = False) -> DataFrame:
    """Over the present dates of a range; the default range leaves recent dates out."""
    view = cube
    if default_range or start is not None or end is not None:
        lo, hi = statistics_range(cube.dates, start, end) if default_range else (start, end)
        view = cube.between(lo, hi)
    return summary(view.rows(), view.variables)


def tendency_statistics(cube: Cube, deltas: Sequence[int | str | timedelta] | bool = True) -> DataFrame:
    """delta and the statistics of differences (of the dataset that ``statistics_tendencies`` named, if one did); deltas that aren't multiples of the frequency are left out."""
    if cube.tendencies_of is not None:
        return tendency_statistics(cube.tendencies_of.select(list(cube.variables)), deltas)
    wanted = [frequency(h) for h in ((1, 3, 6, 12, 24) if deltas is True else deltas)]
    usable = [d for d in wanted if not d % cube.frequency and timedelta(0) < d and d // cube.frequency < len(cube.dates)]
    if not usable:
        raise ValueError("no delta is a multiple of the frequency")
    # all deltas are frames of one window and one aggregation; what lacks its earlier date has no difference
    order = Window.partitionBy(*SERIES).orderBy(cube.date_idx)
    frames = [order.rangeBetween(-(d // cube.frequency), -(d // cube.frequency)) for d in usable]
    names = [f"{n}_{j}" for n in range(len(usable)) for j in range(len(cube.variables))]
    values = [F.col(v) - F.first(v).over(frame) for frame in frames for v in cube.variables]
    found = summary(cube.rows().select(*[x.alias(name) for x, name in zip(values, names, strict=True)]), names)
    at = F.split("variable", "_").cast("array<int>")
    named = F.array(*[F.lit(v) for v in cube.variables])[at[1]].alias("variable")
    return found.select(named, *FIELDS, F.array(*[F.lit(frequency_text(d)) for d in usable])[at[0]].alias("delta"))


def stored_tendencies(cube: Cube, delta: int | str | timedelta) -> dict[str, dict[str, float]]:
    """Each variable's statistics of differences as they are stored with the dataset, of all its dates; an error where they aren't."""
    name = frequency_text(frequency(delta))
    found = (cube.stored_tendencies or {}).get(name, {})
    if lacking := [v for v in cube.variables if v not in found]:
        raise ValueError(f"no stored statistics of tendencies over {name} of {lacking}")
    return {v: found[v] for v in cube.variables}


def constant_variables(cube: Cube) -> DataFrame:
    """variable, constant: whether each cell of each member has one value (NaN counts as one) on all dates."""
    one = [(F.count_distinct(F.coalesce(F.col(v).cast("double"), F.lit(float("nan")))) == 1).alias(v) for v in cube.variables]
    each = cube.rows().groupBy("member", "cell").agg(*one)
    return each.agg(F.array(*[F.struct(F.lit(v).alias("variable"), F.bool_and(v).alias("constant")) for v in cube.variables]).alias("all")).select(F.inline("all"))


def with_constants(cube: Cube) -> Cube:
    """The dataset with the constancy of its variables found from its rows."""
    return cube.typed({r["variable"]: replace(cube.typed_variables[r["variable"]], constant=bool(r["constant"])) for r in constant_variables(cube).collect()})


def with_statistics(cube: Cube, stats: dict[str, dict[str, float]] | Cube) -> Cube:
    """The dataset with another's statistics; they must cover its variables."""
    found = stats.statistics if isinstance(stats, Cube) else stats
    if lacking := [v for v in cube.variables if v not in (found or {})]:
        raise ValueError(f"no statistics of {lacking}")
    other = cube.tendencies_of or (stats if isinstance(stats, Cube) else None)
    return cube.with_("statistics", statistics={v: found[v] for v in cube.variables}, tendencies_of=other)


def with_tendency_statistics(cube: Cube, other: Cube) -> Cube:
    """The dataset with another's statistics of tendencies; it must have all of its variables."""
    if lacking := [v for v in cube.variables if v not in other.variables]:
        raise ValueError(f"no statistics of tendencies of {lacking}")
    return cube.with_("statistics_tendencies", tendencies_of=other)


def collected(table: DataFrame) -> dict[str, dict[str, float]]:
    """One row for each variable, as metadata."""
    return {r["variable"]: {f: r[f] for f in FIELDS} for r in table.collect()}


def obfuscated(cube: Cube, stats: dict[str, dict[str, float]], seed: int = 0) -> Cube:
    """Values replaced by normal ones of the same mean and deviation, made from a hash of the row's place: the same in each run."""

    def uniform(salt: str) -> Column:
        place = F.concat_ws("|", F.col("date").cast("string"), "member", "cell", F.lit(salt))
        return (F.conv(F.substring(F.md5(place.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)

    def normal(k: int) -> Column:
        return F.sqrt(-2 * F.log(uniform(f"{seed} {k} radius"))) * F.cos(2 * math.pi * uniform(f"{seed} {k} angle"))

    return cube.with_("obfuscate", df=cube.df.withColumns({v: normal(k) * stats[v]["stdev"] + stats[v]["mean"] for k, v in enumerate(cube.variables)}))


def climatology(cube: Cube) -> Cube:
    """The first date seen in each calendar month; an error unless all twelve occur."""
    first = {}
    for d in cube.dates:
        if d not in cube.missing:
            first.setdefault(d.month, d)
    if len(first) < 12:
        raise ValueError(f"months {sorted(set(range(1, 13)) - set(first))} are missing")
    return cube.with_("climatology", df=cube.df.filter(F.col("date").isin([str(d) for d in first.values()])))


def overlap_differences(whole: Cube, area: Cube, digits: int = 4) -> DataFrame:
    """variable, statistic, whole, area, percent: both datasets' mean, stdev, minimum and maximum over the second one's dates and box, and the second's difference in percent of its own value (null where that is zero)."""
    names = [v for v in whole.variables if v in area.variables]
    kinds = ["mean", "stdev", "minimum", "maximum"]

    def long(cube: Cube, name: str) -> DataFrame:
        return summary(cube.rows(), names).unpivot(["variable"], kinds, "statistic", name)

    both = long(whole.select(names).between(area.start, area.end).area_of(area), "whole").join(long(area.select(names), "area"), ["variable", "statistic"])
    return both.withColumn("percent", F.round((F.col("area") - F.col("whole")) * 100 / F.nullif(F.col("area"), F.lit(0.0)), digits))


def spacing_km(cube: Cube) -> float:
    """The side of the square that a point of the grid has to itself in the grid's box."""
    n, s, w, e = cube.grid.agg(F.max("latitude"), F.min("latitude"), F.min("longitude"), F.max("longitude")).first()
    return math.sqrt(geo.box_area_km2(n, w, s, e) / cube.cells)


def compare(a: Cube, b: Cube, absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """variable, compared, different, largest: values of both at the same keys that aren't equal (NaN equals NaN); where tolerances are given, those beyond them.

    A tolerance hides changes that are small beside their values, so there is none unless asked for. An infinite value is close to its equal only.
    """
    names = [v for v in a.variables if v in b.variables]
    left = a.rows().select("date", "member", "cell", *[F.col(v).alias(f"_a{k}") for k, v in enumerate(names)])
    right = b.rows().select("date", "member", "cell", *[F.col(v).alias(f"_b{k}") for k, v in enumerate(names)])
    joined = left.join(right, ["date", "member", "cell"], "full_outer")

    def of(k: int, v: str) -> Column:
        x, y = skip_nan(F.col(f"_a{k}")), skip_nan(F.col(f"_b{k}"))
        gap = F.when(x == y, 0.0).otherwise(F.abs(x - y))  # equal infinite values would have NaN
        beyond = (gap > absolute + relative * F.abs(y)) | (gap == float("inf"))
        differs = (x.isNull() != y.isNull()) | F.coalesce(beyond, F.lit(False))
        return F.struct(F.lit(v).alias("variable"), F.count("*").alias("compared"), F.count(F.when(differs, 1)).alias("different"), F.max(gap).alias("largest"))

    return joined.agg(F.array(*[of(k, v) for k, v in enumerate(names)]).alias("all")).select(F.inline("all"))
