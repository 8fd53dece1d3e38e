"""Combinations of gridded datasets: unions and equi-joins, planned from metadata that is checked first."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.functions import geo
from stratoframe.functions.timegrammar import spine
from stratoframe.functions.variables import Variable, unified
from stratoframe.operators.cube import KEYS, Cube, on_dates, skip_nan
from stratoframe.operators.series import nearest
from stratoframe.operators.side import cut, side

ALIASES = {"all": ("select", "frequency", "start", "end"), "dates": ("start", "end", "frequency"), "variables": ("select",)}


def _same(cubes: Sequence[Cube], *, dates: bool = True, variables: bool = False, cells: bool = True, members: bool = True) -> None:
    first = cubes[0]
    for other in cubes[1:]:
        if first.frequency != other.frequency:
            raise ValueError(f"frequencies differ: {first.frequency}, {other.frequency}")
        if cells and (first.cells != other.cells or first.field_shape != other.field_shape):
            raise ValueError(f"grids differ: {first.cells} and {other.cells} cells")
        if members and first.members != other.members:
            raise ValueError(f"members differ: {first.members}, {other.members}")
        if dates and (first.start, first.end) != (other.start, other.end):
            raise ValueError(f"dates differ: {first.start}..{first.end}, {other.start}..{other.end}")
        if variables and first.variables != other.variables:
            raise ValueError(f"variables differ: {first.variables}, {other.variables}")
    if variables:
        unified_types(cubes)
    if cells:
        same_grid(cubes)


def unified_types(cubes: Sequence[Cube]) -> dict[str, Variable]:
    """What is known of each variable in all datasets that have it; an error where units, levels or periods differ."""
    found: dict[str, list[Variable]] = {}
    for c in cubes:
        for v, t in c.typed_variables.items():
            found.setdefault(v, []).append(t)
    return {v: unified(types) for v, types in found.items()}


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _merged_statistics(cubes: Sequence[Cube], names: Sequence[str]) -> dict | None:
    found = {k: v for c in cubes for k, v in (c.statistics or {}).items()}
    return {n: found[n] for n in names} if all(n in found for n in names) else None


def same_grid(cubes: Sequence[Cube], relative: float = 1e-7) -> None:
    """Raises unless all grids that are known have the same points (a join for each that isn't the first one's own table)."""
    for other in cubes[1:]:
        if cubes[0].grid is None or other.grid is None or other.grid is cubes[0].grid:
            continue
        a = cubes[0].grid.select("cell", "latitude", "longitude")
        b = other.grid.select("cell", F.col("latitude").alias("y"), F.col("longitude").alias("x"))
        off = lambda p, q: F.abs(F.col(p) - F.col(q)) > relative * F.abs(F.col(q)) + 1e-8
        joined = a.join(b, "cell", "full_outer").filter(F.coalesce(off("latitude", "y") | off("longitude", "x"), F.lit(True)))
        if joined.limit(1).count():
            raise ValueError("grids differ")


def join(cubes: Sequence[Cube]) -> Cube:
    """Variables side by side. A name that several have is the last one's, at the first one's place."""
    if len(cubes) == 1:
        return cubes[0]
    _same(cubes)
    names = list(dict.fromkeys(v for c in cubes for v in c.variables))
    owner = {v: k for k, c in enumerate(cubes) for v in c.variables}
    df = None
    for k, c in enumerate(cubes):
        own = [v for v in c.variables if owner[v] == k]
        if not own:
            continue  # all of it is overlaid by later ones
        part = c.df.select(*KEYS, *own)
        df = part if df is None else df.join(part, list(KEYS))
    missing = frozenset().union(*(c.missing for c in cubes))
    origins = {v: cubes[k].origin(v) for v, k in owner.items()}
    types = {v: cubes[k].typed_variables[v] for v, k in owner.items()}
    unified_types(cubes)
    deltas = set.intersection(*(set(c.stored_tendencies or {}) for c in cubes))
    tendencies = {delta: {v: cubes[k].stored_tendencies[delta][v] for v, k in owner.items()} for delta in sorted(deltas)} or None
    return cubes[0].with_("join", origins=origins, types=types, stored_tendencies=tendencies, df=df.select(*KEYS, *names), variables=tuple(names), missing=missing, statistics=_merged_statistics(cubes, names), tree=("join", *(c.tree for c in cubes)))


def concat(cubes: Sequence[Cube], fill_missing_gaps: bool = False) -> Cube:
    """Dates one after the other, without gaps, or with gaps as missing dates."""
    if len(cubes) == 1:
        return cubes[0]
    _same(cubes, dates=False, variables=True)
    step = cubes[0].frequency
    missing = set().union(*(c.missing for c in cubes))
    for a, b in zip(cubes, cubes[1:], strict=False):
        if b.start <= a.end:
            raise ValueError(f"dates overlap or aren't in order: {a.end}, {b.start}")
        if a.end + step != b.start:
            if not fill_missing_gaps or (b.start - a.end) % step:
                raise ValueError(f"a gap from {a.end} to {b.start}")
            missing |= set(spine(a.end + step, b.start - step, step))
    df = _union([c.df.select(*KEYS, *cubes[0].variables) for c in cubes])
    return cubes[0].with_("concat", types=unified_types(cubes), df=df, end=cubes[-1].end, missing=frozenset(missing), tree=("concat", *(c.tree for c in cubes)))


def merge(cubes: Sequence[Cube], allow_gaps_in_dates: bool = False) -> Cube:
    """Dates interleaved: of a date that several have, the first that isn't missing counts; two present ones are an error. Whole datasets' dates are chosen on the driver, so each contributes by a filter."""
    if len(cubes) == 1:
        return cubes[0]
    same_grid(cubes)
    types = unified_types(cubes)
    owner: dict[datetime, int] = {}
    for k, c in enumerate(cubes):
        if c.variables != cubes[0].variables or c.cells != cubes[0].cells or c.members != cubes[0].members:
            raise ValueError("variables, cells and members must be the same")
        for d in c.dates:
            if d not in owner or d in cubes[owner[d]].missing:
                if d in owner and d in c.missing:
                    continue
                owner[d] = k
            elif d not in c.missing:
                raise ValueError(f"{d} is in datasets {owner[d]} and {k}")
    dates = sorted(owner)
    step = min(b - a for a, b in zip(dates, dates[1:], strict=False))
    full = spine(dates[0], dates[-1], step)
    if odd := [d for d in dates if (d - dates[0]) % step]:
        raise ValueError(f"{odd[0]} is off the common frequency {step}")
    gaps = set(full) - set(dates)
    if gaps and not allow_gaps_in_dates:
        raise ValueError(f"no dataset has {sorted(gaps)[0]}")
    parts = []
    for k, c in enumerate(cubes):
        own = [d for d in dates if owner[d] == k]
        if len(own) == len(c.dates):
            parts.append(c.df.select(*KEYS, *c.variables))
        elif own:
            parts.append(on_dates(c.df, own).select(*KEYS, *c.variables))
    missing = gaps | {d for d in dates if d in cubes[owner[d]].missing}
    return cubes[0].with_("merge", types=types, df=_union(parts), start=full[0], end=full[-1], frequency=step, missing=frozenset(missing), tree=("merge", *(c.tree for c in cubes)))


def ensemble(cubes: Sequence[Cube]) -> Cube:
    """Members one after the other."""
    _same(cubes, variables=True, members=False)
    parts, offset = [], 0
    for c in cubes:
        parts.append(c.df.withColumn("member", (F.col("member") + offset).cast("int")).select(*KEYS, *c.variables))
        offset += c.members
    return cubes[0].with_("ensemble", types=unified_types(cubes), df=_union(parts), members=offset, missing=frozenset().union(*(c.missing for c in cubes)), tree=("ensemble", *(c.tree for c in cubes)))


def grids(cubes: Sequence[Cube]) -> Cube:
    """Cells one after the other."""
    _same(cubes, variables=True, cells=False)
    parts, points, offset = [], [], 0
    for c in cubes:
        parts.append(c.df.withColumn("cell", (F.col("cell") + offset).cast("int")).select(*KEYS, *c.variables))
        if c.grid is not None:
            points.append(c.grid.select((F.col("cell") + offset).cast("int").alias("cell"), "latitude", "longitude", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col")))
        offset += c.cells
    grid = _union(points) if len(points) == len(cubes) else None
    return cubes[0].with_("grids", types=unified_types(cubes), df=_union(parts), grid=grid, cells=offset, parts=tuple(n for c in cubes for n in c.grids), field_shape=None, missing=frozenset().union(*(c.missing for c in cubes)), tree=("grids", *(c.tree for c in cubes)))


def _covered(points: DataFrame, area: DataFrame, neighbours: int, min_km: float | None, max_km: float | None) -> DataFrame:
    """The cells (of points) that an area covers: the line from the Earth's centre meets a triangle of three points that follow each other among the nearest ``neighbours``, or the nearest point is within ``min_km``.

    Where ``min_km`` isn't given it is the least distance between two of the points themselves. Beyond ``max_km`` of the
    nearest point nothing is covered.
    """
    if min_km is None:
        spacing = nearest(points, points, 2).filter("rank = 2").agg(F.min("distance")).first()[0]
        least = spacing or 0.0
    else:
        least = geo.chord_of_km(min_km)
    place = lambda df, name: df.select(F.col("cell").alias(name), F.array(*geo.xyz(F.col("latitude"), F.col("longitude"))).alias(f"{name}_at"))
    near = nearest(points, area, neighbours).join(side(place(area, "source")), "source")
    found = near.groupBy("target").agg(F.min("distance").alias("distance"), F.array_sort(F.collect_list(F.struct("rank", F.col("source_at").alias("at")))).alias("near"))
    found = found.join(side(place(points, "target")), "target")

    def volume(a: Column, b: Column, c: Column) -> Column:
        return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])

    def meets(j: Column) -> Column:
        a, b, c = (F.get("near", j + i)["at"] for i in range(3))
        p = F.col("target_at")
        turns = [volume(p, b, c), volume(a, p, c), volume(a, b, p)]
        alike = reduce(lambda x, y: x & y, [t * volume(a, b, c) >= 0 for t in turns])
        return alike & (F.abs(volume(a, b, c)) > 1e-15)

    inside = F.exists(F.sequence(F.lit(0), F.lit(neighbours - 3)), meets) if neighbours >= 3 else F.lit(False)
    covered = F.coalesce(inside, F.lit(False)) | (F.col("distance") <= least)
    if max_km is not None:
        covered &= F.col("distance") <= geo.chord_of_km(max_km)
    return found.filter(covered).select(F.col("target").alias("cell"))


def cutout(cubes: Sequence[Cube], cropping_distance: float = 2.0, neighbours: int = 5, min_distance_km: float | None = None, max_distance_km: float | None = None) -> Cube:
    """Limited areas, then the global grid (last). From each dataset go the cells that an earlier one covers; only cells within ``cropping_distance`` degrees of its points' box are compared."""
    if len(cubes) < 2:
        raise ValueError("a cutout takes at least two datasets")
    if min(cropping_distance, min_distance_km or 0, max_distance_km or 0) < 0:
        raise ValueError("distances must not be negative")
    kept = [cubes[0]]
    for c in cubes[1:]:
        points = c.grid
        for earlier in kept:
            n, s, w, e = earlier.grid.agg(F.max("latitude"), F.min("latitude"), F.min("longitude"), F.max("longitude")).first()
            near = points.filter(geo.inside(F.col("latitude"), F.col("longitude"), n + cropping_distance, w - cropping_distance, s - cropping_distance, e + cropping_distance))
            covered = _covered(near, earlier.grid, neighbours, min_distance_km, max_distance_km)
            points = points.join(side(covered), "cell", "left_anti")
        kept.append(c.keep_cells("cutout", cut(points)))
    return grids(kept)


def complement(target: Cube, source: Cube, interpolation: str = "none", k: int = 1, max_km: float | None = None) -> Cube:
    """The source's variables that the target lacks, on the same grid or from the k nearest cells, weighted by inverse distance; columns sorted by name."""
    names = [v for v in source.variables if v not in target.variables]
    if not names:
        raise ValueError("the source has no further variables")
    target, source = adjusted([target, source], "dates")
    added = source.select(names)
    if interpolation == "nearest":
        pairs = nearest(target.grid, source.grid, k, max_km).withColumn("weight", 1 / (F.col("distance") + 1e-8))
        total = pairs.groupBy("target").agg(F.sum("weight").alias("total"))
        weights = pairs.join(total, "target").select("target", F.col("source").alias("cell"), (F.col("weight") / F.col("total")).alias("weight"))
        spread = added.df.join(side(weights), "cell").groupBy("date", "member", F.col("target").alias("to")).agg(*[F.sum(F.col(v) * F.col("weight")).alias(v) for v in names])
        spread = spread.withColumnRenamed("to", "cell")
        reached = target.df.select(*KEYS).join(spread, list(KEYS), "left")
        filled = reached.select(*KEYS, *[F.coalesce(F.col(v), F.lit(float("nan"))).alias(v) for v in names])
        added = target.with_("complement", df=filled, variables=tuple(names), statistics=added.statistics, types=added.types)
    elif interpolation != "none":
        raise ValueError(f"unknown interpolation: {interpolation!r}")
    return join([target, added]).reorder("sort")


def zipped(cubes: Sequence[Cube], names: Sequence[str] | None = None, check_compatibility: bool = True) -> DataFrame:
    """date_idx, member, cell and a struct (x0, x1, ... unless named) of each dataset's variables, by position of the date."""
    if check_compatibility and len({c.frequency for c in cubes}) > 1:
        raise ValueError(f"frequencies differ: {[str(c.frequency) for c in cubes]}")
    n = min(len(c.dates) for c in cubes)
    out = None
    for k, c in enumerate(cubes):
        part = c.df.select(c.date_idx.alias("date_idx"), "member", "cell", F.struct(*c.variables).alias(names[k] if names else f"x{k}")).filter(F.col("date_idx") < n)
        out = part if out is None else out.join(part, ["date_idx", "member", "cell"])
    return out


def chain(cubes: Sequence[Cube]) -> DataFrame:
    """Rows of all datasets, one after the other, without checks: dataset, position, and the rows."""
    parts, offset = [], 0
    for k, c in enumerate(cubes):
        parts.append(c.df.select(F.lit(k).alias("dataset"), (c.date_idx + offset).alias("position"), *KEYS, *c.variables))
        offset += len(c.dates)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def adjusted(cubes: Sequence[Cube], adjust: str | Sequence[str]) -> list[Cube]:
    """All datasets cut to their common variables (sorted), common dates and coarsest frequency."""
    wanted: set[str] = set()
    for a in [adjust] if isinstance(adjust, str) else adjust:
        wanted |= set(ALIASES.get(a, (a,)))
    out = list(cubes)
    if "select" in wanted:
        names = sorted(set.intersection(*(set(c.variables) for c in out)))
        if not names:
            raise ValueError("no common variables")
        out = [c if list(c.variables) == names else c.select(names) for c in out]
    if "frequency" in wanted:
        step = max(c.frequency for c in out)
        out = [c if c.frequency == step else c.every(step) for c in out]
    if wanted & {"start", "end"}:
        common = set.intersection(*(set(c.dates) for c in out))
        if not common:
            raise ValueError("no common dates")
        lo, hi = min(common) if "start" in wanted else None, max(common) if "end" in wanted else None
        out = [c if (lo or c.start, hi or c.end) == (c.start, c.end) else c.between(lo, hi) for c in out]
    return out


def automatic(cubes: Sequence[Cube]) -> Cube:
    """A join where all have the same dates, else a concatenation."""
    same = all((c.start, c.end) == (cubes[0].start, cubes[0].end) for c in cubes)
    return join(cubes) if same else concat(cubes)


def recentred(members: Cube, centre: Cube, alpha: float = 1.0, non_negative: Sequence[str] = ("q", "cp", "lsp", "tp", "sf", "swl1", "swl2", "swl3", "swl4")) -> Cube:
    """centre + alpha * (member - mean of members); variables that can't be negative are cut at zero."""
    names = [v for v in members.variables if v in centre.variables]
    one = centre.df.filter("member = 0").select("date", "cell", *[F.col(v).alias(f"_c{k}") for k, v in enumerate(names)])
    means = members.df.groupBy("date", "cell").agg(*[F.avg(skip_nan(F.col(v))).alias(f"_m{k}") for k, v in enumerate(names)])
    joined = members.df.join(means, ["date", "cell"]).join(one, ["date", "cell"])

    def value(k: int, v: str):  # noqa: ANN202
        x = F.col(f"_c{k}") + alpha * (F.col(v) - F.col(f"_m{k}"))
        return (F.greatest(x, F.lit(0.0)) if v in non_negative else x).alias(v)

    return members.with_("recentre", df=joined.select(*KEYS, *[value(k, v) for k, v in enumerate(names)]), variables=tuple(names), statistics=None)
