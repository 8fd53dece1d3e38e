"""Forecast trajectories: rows (base_date, step_s, member, cell, variables). The valid time is base + step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratoframe.functions.timegrammar import first_date, frequency, frequency_text, last_date, spine
from stratoframe.operators.cube import KEYS, Cube, MissingDateError, on_dates, seconds, stamp
from stratoframe.operators.statistics import summary

TKEYS = ("base_date", "step_s", "member", "cell")


@dataclass(frozen=True)
class Trajectories:
    df: DataFrame
    variables: tuple[str, ...]
    base_start: datetime
    base_end: datetime
    base_frequency: timedelta
    steps: tuple[timedelta, ...]
    members: int
    cells: int
    grid: DataFrame | None = None
    missing: frozenset[datetime] = frozenset()

    @property
    def base_dates(self) -> list[datetime]:
        return spine(self.base_start, self.base_end, self.base_frequency)

    @property
    def dates(self) -> list[datetime]:
        raise NotImplementedError("trajectories have base_dates and steps; select one step for dates")

    @property
    def frequency(self) -> timedelta:
        raise NotImplementedError("trajectories have base_frequency and steps")

    @property
    def base_idx(self) -> Column:
        origin = int((self.base_start - datetime(1970, 1, 1)).total_seconds())
        return ((seconds(F.col("base_date")) - origin) / int(self.base_frequency.total_seconds())).cast("int")

    def rows(self) -> DataFrame:
        present = self.df
        if self.missing:
            present = on_dates(present, sorted(self.missing), "base_date", keep=False)
        return present.select(*TKEYS, *self.variables)

    def select(self, names: str | Sequence[str]) -> Trajectories:
        names = [names] if isinstance(names, str) else list(names)
        if unknown := [n for n in names if n not in self.variables]:
            raise ValueError(f"unknown variables: {unknown}")
        return replace(self, df=self.df.select(*TKEYS, *names), variables=tuple(names))

    def drop(self, names: str | Sequence[str]) -> Trajectories:
        names = [names] if isinstance(names, str) else list(names)
        if unknown := [n for n in names if n not in self.variables]:
            raise ValueError(f"unknown variables: {unknown}")
        return self.select([v for v in self.variables if v not in names])

    def _bases(self, lo: datetime, hi: datetime) -> Trajectories:
        if lo > hi:
            raise ValueError("no base dates are left")
        return replace(self, df=self.df.filter(F.col("base_date").between(stamp(lo), stamp(hi))), base_start=lo, base_end=hi, missing=frozenset(d for d in self.missing if lo <= d <= hi))

    def base_range(self, start: object = None, end: object = None) -> Trajectories:
        lo = first_date(start, self.base_dates) if start is not None else self.base_start
        hi = last_date(end, self.base_dates) if end is not None else self.base_end
        return self._bases(lo, hi)

    def base_every(self, step: int | str | timedelta) -> Trajectories:
        k, rest = divmod(frequency(step), self.base_frequency)
        if rest or k < 1:
            raise ValueError(f"{step} isn't a multiple of {self.base_frequency}")
        dates = self.base_dates[::k]
        return replace(self, df=self.df.filter(F.pmod(self.base_idx, F.lit(k)) == 0), base_end=dates[-1], base_frequency=k * self.base_frequency, missing=self.missing & set(dates))

    def envelope(self, start: object = None, end: object = None) -> Trajectories:
        """Bases whose whole trajectory lies from start to end."""
        first, last = self.steps[0], self.steps[-1]
        firsts, lasts = [d + first for d in self.base_dates], [d + last for d in self.base_dates]
        lo = first_date(start, firsts) - first if start is not None else self.base_start
        hi = last_date(end, lasts) - last if end is not None else self.base_end
        return self._bases(lo, hi)

    def step(self, hours: int | str | timedelta) -> Cube:
        """One step as a gridded dataset at valid times."""
        at = frequency(hours)
        if at not in self.steps:
            raise ValueError(f"no step {at}")
        s = int(at.total_seconds())
        shift = F.expr(f"interval {s} seconds")
        df = self.df.filter(F.col("step_s") == s).select((F.col("base_date") + shift).alias("date"), "member", "cell", *self.variables)
        missing = frozenset(d + at for d in self.missing)
        return Cube(df.select(*KEYS, *self.variables), self.variables, self.base_start + at, self.base_end + at, self.base_frequency, self.members, self.cells, self.grid, None, missing, None, ("step",))

    def only_steps(self, hours: Sequence[int | str | timedelta]) -> Trajectories:
        wanted = [frequency(h) for h in hours]
        if unknown := [w for w in wanted if w not in self.steps]:
            raise ValueError(f"no steps {unknown}")
        return replace(self, df=self.df.filter(F.col("step_s").isin([int(w.total_seconds()) for w in wanted])), steps=tuple(wanted))

    def step_range(self, start: object = None, end: object = None, every: object = None) -> Trajectories:
        lo = frequency(start) if start is not None else self.steps[0]
        hi = frequency(end) if end is not None else self.steps[-1]
        kept = [s for s in self.steps if lo <= s <= hi and (every is None or not (s - self.steps[0]) % frequency(every))]
        if not kept:
            raise ValueError("no steps are left")
        return self.only_steps(kept)

    def set_missing(self, which: Sequence[int | datetime]) -> Trajectories:
        dates = self.base_dates
        flagged = {dates[w] if isinstance(w, int) else w for w in which} & set(dates)
        if not flagged:
            raise ValueError("no base date of the dataset is flagged")
        return replace(self, missing=self.missing | flagged)

    def at(self, index: int | slice) -> DataFrame:
        """Rows of base dates by position; a missing one is an error."""
        n = len(self.base_dates)
        if isinstance(index, int) and not -n <= index < n:
            raise IndexError(f"base date {index} of {n}")
        wanted = [self.base_dates[index]] if isinstance(index, int) else self.base_dates[index]
        if bad := sorted(set(wanted) & self.missing):
            raise MissingDateError(f"missing base dates: {bad[:3]}")
        return on_dates(self.df, wanted, "base_date").select(*TKEYS, *self.variables)

    def tendencies(self) -> DataFrame:
        """x(step) - x(the step before) within each trajectory; the first step has none."""
        order = Window.partitionBy("base_date", "member", "cell").orderBy("step_s")
        out = self.rows().select(*TKEYS, *[(F.col(v) - F.lag(v).over(order)).alias(v) for v in self.variables], F.lag("step_s").over(order).alias("_before"))
        return out.filter("_before is not null").drop("_before")

    def statistics(self, start: object = None, end: object = None) -> DataFrame:
        view = self.envelope(start, end) if start is not None or end is not None else self
        return summary(view.rows(), self.variables)

    def tendency_statistics(self) -> DataFrame:
        spacing = {b - a for a, b in zip(self.steps, self.steps[1:], strict=False)}
        if len(spacing) != 1:
            raise ValueError("steps aren't evenly spaced")
        return summary(self.tendencies(), self.variables).withColumn("delta", F.lit(frequency_text(spacing.pop())))
