"""Observations: a DataFrame (ts, latitude, longitude, one column for each variable) in event time, and samples by windows.

A row belongs to the windows of a range of reference dates that follows from its time by arithmetic, so assigning rows to
windows is a projection and an explode: no range join, and nothing is shuffled until samples are grouped or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from stratoframe.functions import geo
from stratoframe.functions.timegrammar import DEFAULT_WINDOW, Window, frequency
from stratoframe.operators.cube import seconds, thinned
from stratoframe.operators.series import nearest
from stratoframe.operators.side import side
from stratoframe.operators.statistics import summary

EPOCH = datetime(1970, 1, 1)


def encode(df: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows as stored: time rounded to the second, longitude in [0, 360), clipped to the range, exact repeats gone."""
    names = [c for c in df.columns if c not in ("ts", "latitude", "longitude")]
    rows = df.select(F.date_trunc("second", F.col("ts") + F.expr("interval '0.5' second")).cast("timestamp_ntz").alias("ts"), "latitude", geo.longitude(F.col("longitude")).alias("longitude"), *names)
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("ts") <= F.lit(str(end)).cast("timestamp_ntz"))
    return rows.distinct()


def sorted_rows(df: DataFrame) -> DataFrame:
    """Globally ordered by all columns: ranges of time for partitions, each sorted."""
    return df.orderBy(*df.columns)


def exported(df: DataFrame) -> DataFrame:
    """The float32 form: __date (days since 1970), __time (second of the day), then coordinates and variables."""
    names = [c for c in df.columns if c not in ("ts", "latitude", "longitude")]
    epoch = seconds(F.col("ts"))
    day, second = F.floor(epoch / 86400), F.pmod(epoch, F.lit(86400))
    return df.select(day.cast("float").alias("__date"), second.cast("float").alias("__time"), *[F.col(c).cast("float").alias(f"__{c}") for c in ("latitude", "longitude")], *[F.col(c).cast("float").alias(c) for c in names])


def index_runs(df: DataFrame, bucket_days: int = 1) -> DataFrame:
    """epoch, count, offset of each distinct second, in time order.

    Offsets are sums within a day's bucket plus the rows of earlier days, which are one row for each day.
    """
    counted = df.groupBy(seconds(F.col("ts")).alias("epoch")).agg(F.count("*").alias("count")).withColumn("bucket", F.floor(F.col("epoch") / (86400 * bucket_days)))
    days = counted.groupBy("bucket").agg(F.sum("count").alias("rows"))
    before = days.select("bucket", F.coalesce(F.sum("rows").over(Over.orderBy("bucket").rowsBetween(Over.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("count").over(Over.partitionBy("bucket").orderBy("epoch").rowsBetween(Over.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("within", within).join(side(before), "bucket").select("epoch", (F.col("before") + F.col("within")).cast("long").alias("offset"), "count")


@dataclass(frozen=True)
class Observations:
    """Samples of a table: sample i holds the rows in the window around reference date start + i * frequency."""

    df: DataFrame
    variables: tuple[str, ...]
    start: datetime
    end: datetime
    frequency: timedelta = timedelta(hours=3)
    window: Window = DEFAULT_WINDOW
    trailing_window: bool = False

    @staticmethod
    def of(df: DataFrame, start: datetime | None = None, end: datetime | None = None, **options: object) -> Observations:
        """The range is the data's, unless it is given."""
        names = tuple(c for c in df.columns if c not in ("ts", "latitude", "longitude"))
        if start is None or end is None:
            lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
            start, end = start or lo, end or hi
        options |= {k: f(options[k]) for k, f in (("frequency", frequency), ("window", Window.parse)) if k in options}
        return Observations(df, names, start, end, **options)

    def __len__(self) -> int:
        return max(0, int((self.end - self.start) // self.frequency) + 1 + self.trailing_window)

    def view(self, **changes: object) -> Observations:
        """Another start, end, frequency or window over the same rows."""
        changes |= {k: f(changes[k]) for k, f in (("frequency", frequency), ("window", Window.parse)) if k in changes}
        return replace(self, **changes)

    def select(self, names: str | Sequence[str]) -> Observations:
        names = [names] if isinstance(names, str) else list(names)
        if unknown := [n for n in names if n not in self.variables]:
            raise ValueError(f"unknown variables: {unknown}")
        return replace(self, df=self.df.select("ts", "latitude", "longitude", *names), variables=tuple(names))

    def drop(self, names: str | Sequence[str]) -> Observations:
        names = [names] if isinstance(names, str) else list(names)
        if unknown := [n for n in names if n not in self.variables]:
            raise ValueError(f"unknown variables: {unknown}")
        return self.select([v for v in self.variables if v not in names])

    def area(self, north: float, west: float, south: float, east: float) -> Observations:
        return replace(self, df=self.df.filter(geo.inside(F.col("latitude"), F.col("longitude"), north, west, south, east)))

    def thin_grid(self, km: float) -> DataFrame:
        """Samples with one row (the first) for each sample and cell of so many km."""
        placed = self.samples().withColumn("_order", F.struct("ts", "latitude", "longitude", *self.variables))
        size = km / geo.EARTH_KM
        x, y, z = (F.round(v / size) for v in geo.xyz(F.col("latitude"), F.col("longitude")))
        ranked = placed.withColumn("_k", F.row_number().over(Over.partitionBy("sample", x, y, z).orderBy("_order")))
        return ranked.filter("_k = 1").drop("_k", "_order")

    def thin_random(self, share: float, seed: int = 0) -> Observations:
        keyed = self.df.withColumn("_key", F.xxhash64(*self.df.columns))
        return replace(self, df=thinned(keyed, share, "random", "_key", seed).drop("_key"))

    def samples(self) -> DataFrame:
        """sample, reference, timedelta (seconds from the reference), ts, latitude, longitude, variables."""
        n = len(self)
        step = int(self.frequency.total_seconds())
        origin = int((self.start - EPOCH).total_seconds())
        w = self.window
        at = seconds(F.col("ts")) - origin
        # times are whole seconds: start + i f + a < ts (or <=) and ts <= start + i f + b (or <)
        low = F.ceil((at - w.end) / step) if w.end_closed else F.floor((at - w.end) / step) + 1
        high = F.floor((at - w.start) / step) if w.start_closed else F.ceil((at - w.start) / step) - 1
        low, high = F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(n - 1)).cast("int")
        lo = self.start + timedelta(seconds=w.start)
        hi = self.start + (n - 1) * self.frequency + timedelta(seconds=w.end)
        near = self.df.filter(F.col("ts").between(F.lit(str(lo)).cast("timestamp_ntz"), F.lit(str(hi)).cast("timestamp_ntz")))
        dealt = near.withColumns({"_low": low, "_high": high}).filter("_high >= _low").withColumn("sample", F.explode(F.sequence("_low", "_high")))
        reference = F.lit(str(self.start)).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("sample").cast("long") * step).cast("decimal(18,6)"))
        delta = (seconds(F.col("ts")) - origin - F.col("sample").cast("long") * step).alias("timedelta")
        return dealt.select("sample", reference.alias("reference"), delta, "ts", "latitude", "longitude", *self.variables)

    def sample(self, index: int) -> DataFrame:
        """One sample in storage order; negative positions count from the end."""
        n = len(self)
        if not -n <= index < n:
            raise IndexError(f"sample {index} of {n}")
        i = index % n
        one = replace(self, start=self.start + i * self.frequency, end=self.start + i * self.frequency, trailing_window=False)
        return one.samples().withColumn("sample", F.lit(i)).orderBy("ts", "latitude", "longitude", *self.variables)

    def samples_of(self, which: slice) -> Observations:
        """Consecutive samples, numbered anew."""
        first, last, step = which.indices(len(self))
        if step != 1 or last <= first:
            raise IndexError(f"{which} has a step or no samples")
        return replace(self, start=self.start + first * self.frequency, end=self.start + (last - 1) * self.frequency, trailing_window=False)

    def boundaries(self) -> DataFrame:
        """sample, reference, first, last: the rows of each sample (the last one excluded) when all samples stand one after the other."""
        # sums within buckets of samples, and of whole buckets, of which there are few
        counts = self.counts().withColumn("_bucket", F.floor(F.col("sample") / 100_000))
        before = counts.groupBy("_bucket").agg(F.sum("n").alias("_rows")).select("_bucket", F.coalesce(F.sum("_rows").over(Over.orderBy("_bucket").rowsBetween(Over.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        last = F.sum("n").over(Over.partitionBy("_bucket").orderBy("sample")) + F.col("_before")
        reference = F.lit(str(self.start)).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("sample").cast("long") * int(self.frequency.total_seconds())).cast("decimal(18,6)"))
        return counts.join(side(before, len(self) // 100_000 + 1), "_bucket").select("sample", reference.alias("reference"), (last - F.col("n")).alias("first"), last.alias("last"))

    def counts(self) -> DataFrame:
        """sample, n: rows of each sample, also of empty ones."""
        everything = self.df.sparkSession.range(len(self)).select(F.col("id").cast("int").alias("sample"))
        counted = self.samples().groupBy("sample").agg(F.count("*").alias("n"))
        return everything.join(counted, "sample", "left").select("sample", F.coalesce("n", F.lit(0)).alias("n"))

    def whole_range(self) -> tuple[datetime, datetime]:
        """From the first window's start to the last one's end."""
        return self.start + timedelta(seconds=self.window.start), self.start + (len(self) - 1) * self.frequency + timedelta(seconds=self.window.end)

    def statistics(self) -> DataFrame:
        return summary(self.df, self.variables)


def tabularise(fields: DataFrame, names: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Fields (date, latitude, longitude, variable, value) as rows with a column for each variable."""
    return fields.groupBy("date", "latitude", "longitude").pivot(name, list(names)).agg(F.first(value))


def pivot(df: DataFrame, columns: Sequence[str], values: Sequence[str], cases: Sequence[str]) -> DataFrame:
    """A column <value>_<case> for each value and case (the pivoted columns joined by _), one row for the rest; repeated cells are an error."""
    rest = [c for c in df.columns if c not in (*columns, *values)]
    keyed = df.withColumn("_case", F.concat_ws("_", *columns))

    def cell(v: str, case: str) -> Column:
        here = F.col("_case") == case
        once = F.when(F.count(F.when(here, 1)) > 1, F.raise_error(F.lit(f"repeated {v} for {case}")).cast("double")).otherwise(F.first(F.when(here, F.col(v)), ignorenulls=True))
        return once.alias(f"{v}_{case}")

    return keyed.groupBy(*rest).agg(*[cell(v, case) for v in values for case in cases])


def griddify(obs: DataFrame, grid: DataFrame, variables: Sequence[str], max_distance_km: float = 200.0) -> DataFrame:
    """Each row's values at the nearest grid point within the distance; of several the latest counts (then the largest)."""
    points = obs.select("latitude", "longitude").distinct().withColumn("cell", F.struct("latitude", "longitude"))
    near = nearest(points, grid, 1, max_distance_km).select(F.col("target").alias("point"), F.col("source").alias("cell"))
    placed = obs.withColumn("point", F.struct("latitude", "longitude")).join(side(near), "point")
    return placed.groupBy("cell").agg(*[F.max_by(v, F.struct("ts", v)).alias(v) for v in variables])


def message_filter(rules: dict[str, tuple[str, object]]) -> Column:
    """All of "column": (operator, value); a null fails."""
    ops = {
        "==": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
        "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
    }
    out = F.lit(True)
    for name, (op, value) in rules.items():
        out = out & F.coalesce(ops[op](F.col(name), float(value) if value in ("inf", "-inf") else value), F.lit(False))
    return out


def long_rows(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """A row for each element of parallel arrays, with its place."""
    rest = [c for c in df.columns if c not in arrays]
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return df.select(*rest, F.posexplode(zipped).alias("place", "_z")).select(*rest, "place", *[F.col("_z")[a].alias(a) for a in arrays])


def wide_rows(df: DataFrame, array: str, picks: Sequence[int]) -> DataFrame:
    """Columns <array>_1.. for elements at given places."""
    return df.select(*[c for c in df.columns if c != array], *[F.get(F.col(array), F.lit(p)).alias(f"{array}_{k}") for k, p in enumerate(picks, 1)])


