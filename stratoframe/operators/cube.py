"""The gridded dataset: a lazy wide DataFrame (date, member, cell, one column for each variable) and its metadata.

Metadata (dates, variables, members, grid size) lives on the driver and is small; rows never come to the driver. Dates are
regular, so the ordinal of a date is arithmetic on its column and needs no join; selections of dates, members and variables
are plain filters and projections that reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratoframe.functions import geo, units
from stratoframe.functions.timegrammar import first_date, frequency, last_date, spine
from stratoframe.functions.variables import Variable
from stratoframe.operators.side import numbered, side
from stratoframe.operators.thinning import thinned_by_distance

KEYS = ("date", "member", "cell")
#: Dates up to which a filter names them.
LITERALS = 100


class MissingDateError(ValueError):
    """A date that the dataset flags as missing was read."""


def seconds(column: Column) -> Column:
    return F.unix_seconds(column.cast("timestamp"))


def stamp(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def skip_nan(value: Column) -> Column:
    """NaN as null: aggregates then leave it out."""
    return F.nanvl(value, F.lit(None).cast("double"))


def on_dates(df: DataFrame, dates: Sequence[datetime], column: str = "date", keep: bool = True) -> DataFrame:
    """The rows of these dates (or the others): by a few literals, by a range and step where they are regular, else by a join with their table, however many they are."""
    dates = sorted(set(dates))
    at = F.col(column)
    if len(dates) <= LITERALS:
        wanted = at.isin([str(d) for d in dates])
    elif dates == spine(dates[0], dates[-1], dates[1] - dates[0]):
        since = seconds(at) - F.lit(int((dates[0] - datetime(1970, 1, 1)).total_seconds()))
        wanted = at.between(stamp(dates[0]), stamp(dates[-1])) & (F.pmod(since, F.lit(int((dates[1] - dates[0]).total_seconds()))) == 0)
    else:
        table = df.sparkSession.createDataFrame([(str(d),) for d in dates], "at string").select(F.col("at").cast("timestamp_ntz").alias(column))
        return df.join(side(table, len(dates)), column, "left_semi" if keep else "left_anti")
    return df.filter(wanted if keep else ~wanted)


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    variables: tuple[str, ...]
    start: datetime
    end: datetime
    frequency: timedelta
    members: int
    cells: int
    grid: DataFrame | None = None  # cell, latitude, longitude, row, col
    field_shape: tuple[int, int] | None = None
    missing: frozenset[datetime] = frozenset()
    statistics: dict[str, dict[str, float]] | None = None
    tree: tuple = ("store",)
    tendencies_of: Cube | None = None  # whose differences count for statistics of tendencies
    parts: tuple[int, ...] | None = None  # cells of each grid, where there are several
    origins: dict[str, tuple[str, str]] | None = None  # of variables: the stored dataset and the name there
    types: dict[str, Variable] | None = None  # what is known of variables; may have more than the dataset
    stored_tendencies: dict[str, dict[str, dict[str, float]]] | None = None  # by delta and variable: statistics of differences that are stored with the dataset

    # -- metadata

    @property
    def dates(self) -> list[datetime]:
        return spine(self.start, self.end, self.frequency)

    @property
    def shape(self) -> tuple[int, int, int, int]:
        return len(self.dates), len(self.variables), self.members, self.cells

    @property
    def grids(self) -> tuple[int, ...]:
        """Cells of each of the grids that the dataset is made of."""
        return self.parts or (self.cells,)

    @property
    def missing_indices(self) -> list[int]:
        return [k for k, d in enumerate(self.dates) if d in self.missing]

    @property
    def date_idx(self) -> Column:
        step = int(self.frequency.total_seconds())
        return ((seconds(F.col("date")) - F.lit(int((self.start - datetime(1970, 1, 1)).total_seconds()))) / step).cast("int")

    def to_index(self, date: object = None, variable: str | None = None, member: int | None = None) -> tuple[int | None, int | None, int | None]:
        """Positions of labels; ValueError for what the dataset doesn't have."""
        at = self.dates.index(first_date(date, self.dates)) if date is not None else None
        if isinstance(date, datetime) and date not in self.dates:
            raise ValueError(f"no such date: {date}")
        if variable is not None and variable not in self.variables:
            raise ValueError(f"no such variable: {variable}")
        if member is not None and not 0 <= member < self.members:
            raise ValueError(f"no such member: {member}")
        return at, None if variable is None else self.variables.index(variable), member

    def origin(self, variable: str) -> tuple[str, str]:
        """The stored dataset that a variable comes from (the last that was opened, "store" where it has no name) and its name there."""
        self._known([variable])
        return (self.origins or {}).get(variable, ("store", variable))

    @property
    def typed_variables(self) -> dict[str, Variable]:
        return {v: Variable.of(v, (self.types or {}).get(v)) for v in self.variables}

    def typed(self, types: dict[str, Variable | dict[str, object]]) -> Cube:
        """The dataset with more known of its variables (units, level, level_type, constant, period)."""
        self._known(list(types))
        return self.with_("typed", types=self.typed_variables | {v: Variable.of(v, t) for v, t in types.items()})

    def with_(self, op: str, **changes: object) -> Cube:
        return replace(self, **({"tree": (op, self.tree)} | changes))

    def rows(self) -> DataFrame:
        """The rows of dates that aren't missing."""
        present = on_dates(self.df, list(self.missing), keep=False) if self.missing else self.df
        return present.select(*KEYS, *self.variables)

    def long(self) -> DataFrame:
        return self.rows().unpivot(list(KEYS), list(self.variables), "variable", "value")

    def packed(self) -> DataFrame:
        """date, variable, member, values in cell order: the form for training."""
        pairs = self.long().groupBy("date", "variable", "member").agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("pairs"))
        return pairs.select("date", "variable", "member", F.col("pairs.value").cast("array<float>").alias("values"))

    def at(self, index: int | slice | Sequence[int] | tuple) -> DataFrame:
        """Rows by position, as of an array (date, variable, member, cell): each an int, a slice or (one of them) a list.

        A list keeps its order and repeats: ``position`` is the place in it (a list of variables is the order of the columns
        and names each once).
        """
        index = index if isinstance(index, tuple) else (index,)
        if sum(isinstance(i, (list,)) for i in index) > 1 or len(index) > 4:
            raise IndexError("at most four indices, of which one is a list")
        sizes = self.shape
        chosen: list[list[int] | None] = []
        for size, i in zip(sizes, (*index, *[slice(None)] * (4 - len(index))), strict=True):
            if isinstance(i, slice):
                chosen.append(None if i == slice(None) else list(range(size))[i])
                continue
            found = [i] if isinstance(i, int) else list(i)
            if any(isinstance(k, bool) or not -size <= k < size for k in found):
                raise IndexError(f"index {i} is out of range of {size}")
            chosen.append([k % size for k in found])
        dates, names, members, cells = chosen
        wanted = self.dates if dates is None else [self.dates[k] for k in dates]
        if self.missing and (bad := sorted(set(wanted) & self.missing)):
            raise MissingDateError(f"missing dates: {bad[:3]}")
        out = self.df
        if dates is not None:
            out = on_dates(out, wanted)
        if members is not None:
            out = out.filter(F.col("member").isin(members))
        if cells is not None:
            out = out.filter(F.col("cell").isin(cells))
        named = self.variables if names is None else [self.variables[k] for k in names]
        if len(set(named)) < len(named):
            raise IndexError("a variable is listed twice")
        listed = next((axis for axis, i in enumerate(index) if isinstance(i, list) and axis != 1), None)
        if listed is None:
            return out.select(*KEYS, *named)
        key = ("date", None, "member", "cell")[listed]
        places = [(str(self.dates[k]) if key == "date" else str(k), p) for p, k in enumerate(chosen[listed])]
        table = self.df.sparkSession.createDataFrame(places, "at string, position int").select(F.col("at").cast(self.df.schema[key].dataType).alias(key), "position")
        return out.join(side(table, len(places)), key).select("position", *KEYS, *named)

    # -- variables

    def _known(self, names: Sequence[str]) -> None:
        if unknown := [n for n in names if n not in self.variables]:
            raise ValueError(f"unknown variables: {unknown}; the dataset has {list(self.variables)}")

    def _project(self, op: str, names: Sequence[str]) -> Cube:
        kept = None if self.statistics is None else {n: self.statistics[n] for n in names if n in self.statistics}
        return self.with_(op, df=self.df.select(*KEYS, *names), variables=tuple(names), statistics=kept)

    def select(self, names: str | Sequence[str] | set[str]) -> Cube:
        """In the order given; a set in the dataset's order."""
        names = [names] if isinstance(names, str) else names
        self._known(list(names))
        return self._project("select", [v for v in self.variables if v in names] if isinstance(names, (set, frozenset)) else list(names))

    def drop(self, names: str | Sequence[str]) -> Cube:
        names = [names] if isinstance(names, str) else list(names)
        self._known(names)
        return self._project("drop", [v for v in self.variables if v not in names])

    def reorder(self, order: str | Sequence[str] | dict[str, int]) -> Cube:
        names = sorted(self.variables) if order == "sort" else sorted(order, key=order.get) if isinstance(order, dict) else list(order)
        if sorted(names) != sorted(self.variables):
            raise ValueError("an order must name each variable once")
        return self._project("reorder", names)

    def rename(self, names: dict[str, str]) -> Cube:
        self._known(list(names))
        stats = None if self.statistics is None else {names.get(k, k): v for k, v in self.statistics.items()}
        origins = {names.get(v, v): self.origin(v) for v in self.variables}
        types = {names.get(v, v): Variable.of(names.get(v, v), t) for v, t in self.typed_variables.items()}
        tendencies = self.stored_tendencies and {delta: {names.get(n, n): s for n, s in each.items()} for delta, each in self.stored_tendencies.items()}
        return self.with_("rename", origins=origins, types=types, stored_tendencies=tendencies, tendencies_of=self.tendencies_of and self.tendencies_of.rename(names), df=self.df.withColumnsRenamed(names), variables=tuple(names.get(v, v) for v in self.variables), statistics=stats)

    def rescale(self, how: dict[str, object]) -> Cube:
        """variable -> (scale, offset), {"scale":, "offset":}, (unit, unit) or, where the variable's own unit is known, a unit."""
        self._known(list(how))
        factors, types = {}, self.typed_variables
        for name, value in how.items():
            if isinstance(value, str):
                if types[name].units is None:
                    raise ValueError(f"the unit of {name} isn't known")
                value = (types[name].units, value)  # noqa: PLW2901
            pair = (value["scale"], value["offset"]) if isinstance(value, dict) else tuple(value)
            a, b = units.conversion(*pair) if isinstance(pair[0], str) else pair
            if a < 0:
                raise ValueError(f"{name}: the scale must not be negative")
            factors[name] = (float(a), float(b))
            types[name] = types[name].rescaled(*(pair if isinstance(pair[0], str) else (None, types[name].units if (a, b) == (1, 0) else None)))
        stats = None
        if self.statistics is not None:
            stats = {n: dict(s) for n, s in self.statistics.items()}
            for n, (a, b) in factors.items():
                if n in stats:
                    stats[n] |= {k: stats[n][k] * a + b for k in ("mean", "minimum", "maximum")} | {"stdev": stats[n]["stdev"] * a}
        tendencies = None
        if self.stored_tendencies is not None:  # differences know no offset
            scaled = lambda n, s: s if n not in factors else s | {k: s[k] * factors[n][0] for k in ("mean", "stdev", "minimum", "maximum")}
            tendencies = {delta: {n: scaled(n, s) for n, s in each.items()} for delta, each in self.stored_tendencies.items()}
        return self.with_("rescale", types=types, stored_tendencies=tendencies, tendencies_of=self.tendencies_of and self.tendencies_of.rescale(factors), df=self.df.withColumns({n: F.col(n) * a + b for n, (a, b) in factors.items()}), statistics=stats)

    # -- dates

    def between(self, start: object = None, end: object = None) -> Cube:
        lo = first_date(start, self.dates) if start is not None else self.start
        hi = last_date(end, self.dates) if end is not None else self.end
        if lo > hi:
            raise ValueError(f"no dates from {start} to {end}")
        kept = self.df.filter(F.col("date").between(stamp(lo), stamp(hi)))
        return self.with_("between", df=kept, start=lo, end=hi, missing=frozenset(d for d in self.missing if lo <= d <= hi))

    def every(self, step: int | str | timedelta) -> Cube:
        """A coarser frequency: each k-th date of this view."""
        wanted = frequency(step)
        k, rest = divmod(wanted, self.frequency)
        if rest or k < 1:
            raise ValueError(f"{wanted} isn't a multiple of {self.frequency}")
        dates = self.dates[::k]
        kept = self.df.filter(F.pmod(self.date_idx, F.lit(k)) == 0)
        return self.with_("every", df=kept, end=dates[-1], frequency=wanted, missing=self.missing & set(dates))

    def shuffled(self, seed: int = 0) -> DataFrame:
        """Rows with position: the date's place in a seeded random order of dates."""
        order = self.df.sparkSession.createDataFrame([(str(d), k) for k, d in enumerate(self.dates)], "at string, k int").select(F.col("at").cast("timestamp_ntz").alias("date"), F.md5(F.concat_ws(":", "k", F.lit(seed)).cast("binary")).alias("draw"))
        places = order.select("date", (F.row_number().over(Window.orderBy("draw", "date")) - 1).alias("position"))
        return self.rows().join(side(places, len(self.dates)), "date")

    def set_missing(self, which: Sequence[int | datetime]) -> Cube:
        dates = self.dates
        flagged = frozenset(dates[w] if isinstance(w, int) else w for w in which)
        if not flagged & set(dates):
            raise ValueError("no date of the dataset is flagged")
        return self.with_("set_missing", missing=self.missing | (flagged & set(dates)))

    def skip_missing(self, access: int | slice = 1) -> DataFrame:
        """Samples of several dates: sample (its first position), offset, date and the rows; samples that meet a missing date or the end are left out."""
        wanted = slice(0, access) if isinstance(access, int) else access
        offsets = list(range(wanted.start or 0, wanted.stop, wanted.step or 1))
        dates, gone = self.dates, set(self.missing_indices)
        good = [i for i in range(len(dates)) if all(0 <= i + o < len(dates) and i + o not in gone for o in offsets)]
        pairs = self.df.sparkSession.createDataFrame([(i, o, str(dates[i + o])) for i in good for o in offsets], "sample int, offset int, at string")
        table = pairs.select("sample", "offset", F.col("at").cast("timestamp_ntz").alias("date"))
        return self.rows().join(side(table, len(good) * len(offsets)), "date").select("sample", "offset", *KEYS, *self.variables)

    # -- members and cells

    def number(self, members: int | Sequence[int], first: int = 0) -> Cube:
        """Members by number, counted from ``first``."""
        wanted = sorted({m - first for m in ([members] if isinstance(members, int) else members)})
        if any(not 0 <= m < self.members for m in wanted):
            raise ValueError(f"members {members} are out of range of {self.members}")
        place = F.create_map(*[F.lit(x) for k, m in enumerate(wanted) for x in (m, k)])
        kept = self.df.filter(F.col("member").isin(wanted)).withColumn("member", place[F.col("member")])
        return self.with_("number", df=kept.select(*KEYS, *self.variables), members=len(wanted))

    def keep_cells(self, op: str, kept: DataFrame, shape: tuple[int, int] | None = None) -> Cube:
        """The cells of a part of the grid, numbered anew in their order."""
        ranked, n = numbered(kept, "cell", "new")
        moved = self.df.join(side(ranked.select("cell", "new"), n), "cell").withColumn("cell", F.col("new").cast("int")).select(*KEYS, *self.variables)
        return self.with_(op, df=moved, grid=ranked.withColumn("cell", F.col("new").cast("int")).drop("new"), cells=n, field_shape=shape, parts=None)

    def mask(self, cells: DataFrame) -> Cube:
        """Cells of a table (cell, keep)."""
        return self.keep_cells("mask", self.grid.join(side(cells.filter("keep").select("cell")), "cell", "left_semi"))

    def area(self, north: float, west: float, south: float, east: float) -> Cube:
        return self.keep_cells("area", self.grid.filter(geo.inside(F.col("latitude"), F.col("longitude"), north, west, south, east)))

    def area_of(self, other: Cube) -> Cube:
        n, s, w, e = other.grid.agg(F.max("latitude"), F.min("latitude"), F.min("longitude"), F.max("longitude")).first()
        return self.area(n, w, s, e)

    def trim_edge(self, *edges: int) -> Cube:
        l0, u0, l1, u1 = edges * 4 if len(edges) == 1 else edges
        rows, cols = self.field_shape
        if min(l0, u0, l1, u1) < 0 or l0 + u0 >= rows or l1 + u1 >= cols:
            raise ValueError(f"edges {edges} leave nothing of {self.field_shape}")
        kept = self.grid.filter((F.col("row") >= l0) & (F.col("row") < rows - u0) & (F.col("col") >= l1) & (F.col("col") < cols - u1))
        return self.keep_cells("trim_edge", kept, (rows - l0 - u0, cols - l1 - u1))

    def thin(self, by: float | None, method: str = "every-nth", seed: int = 0) -> Cube:
        """every-nth (rows and columns), grid or distance-based (km), random (a share)."""
        if by is None:
            return self
        if method == "every-nth":
            shape = tuple(-(-n // int(by)) for n in self.field_shape)
            return self.keep_cells("thin", self.grid.filter((F.col("row") % int(by) == 0) & (F.col("col") % int(by) == 0)), shape)
        return self.keep_cells("thin", thinned(self.grid, by, method, "cell", seed))


def thinned(points: DataFrame, by: float, method: str, order: str, seed: int = 0) -> DataFrame:
    """Points (latitude, longitude) thinned in the order of a column."""
    if method == "random":
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(order).cast("string"), F.lit(seed)).cast("binary")), 1, 10), 16, 10).cast("double") / float(1 << 40)
        return points.filter(draw < by)
    if method == "grid":
        size = by / geo.EARTH_KM
        x, y, z = (F.round(v / size) for v in geo.xyz(F.col("latitude"), F.col("longitude")))
        placed = points.withColumns({"_x": x, "_y": y, "_z": z})
        return placed.withColumn("_k", F.row_number().over(Window.partitionBy("_x", "_y", "_z").orderBy(order))).filter("_k = 1").drop("_x", "_y", "_z", "_k")
    if method == "distance-based":
        return thinned_by_distance(points, by, order)
    raise ValueError(f"unknown thinning method: {method!r}")
