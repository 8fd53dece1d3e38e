"""open_dataset: a nested specification becomes a lazy dataset; a fixed order of keywords decides what applies first.

The layout (gridded, tabular, trajectories) of what is opened decides which keywords there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratoframe.functions.timegrammar import first_second, last_second
from stratoframe.operators import combine, series, statistics
from stratoframe.operators.cube import KEYS, Cube
from stratoframe.operators.tabular import Observations
from stratoframe.operators.trajectories import TKEYS, Trajectories
from stratoframe.plans.stored import opened, save
from stratoframe.plans.synthetic import synthetic
from stratoframe.plans.tensors import Tensors

Dataset = Cube | Observations | Trajectories
_NAMED: dict[str, Dataset | str] = {}
_PATHS: list[str] = []

#: Combinations, in the order in which they are looked for.
COMBINATIONS: dict[str, Callable] = {
    "chain": combine.chain, "join": combine.join, "concat": combine.concat, "merge": combine.merge,
    "ensemble": combine.ensemble, "ensembles": combine.ensemble, "grids": combine.grids, "cutout": combine.cutout,
}
OPTIONS = {"concat": ("fill_missing_gaps",), "merge": ("allow_gaps_in_dates",), "cutout": ("cropping_distance", "neighbours", "min_distance_km", "max_distance_km")}
#: Combinations by position: the other keywords apply to each of their datasets.
POSITIONAL = ("zip", "xy", "x")


def add_named_dataset(name: str, what: Dataset | str) -> None:
    """A name that specifications may use for a dataset or a path."""
    _NAMED[name] = what


def add_dataset_path(folder: str) -> None:
    """A folder in which names are looked for, after those that were added before."""
    if folder not in _PATHS:
        _PATHS.append(folder)


def stored(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalogue, a path, or a name in one of the folders."""
    if "/" not in name and ":" not in name and spark.catalog.tableExists(name):
        return spark.table(name)
    for path in (name, *(f"{folder.rstrip('/')}/{name}" for folder in _PATHS)):
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"no table, path or dataset {name!r} in {_PATHS}")


def catalogued(spark: SparkSession, name: str) -> Dataset | None:
    """The dataset that ``save_dataset`` has stored under a path, or a name in one of the folders."""
    for path in (name, *(f"{folder.rstrip('/')}/{name}" for folder in _PATHS)):
        if (found := opened(spark, path)) is not None:
            return found
    return None


def scan_trajectories(df: DataFrame) -> Trajectories:
    """A wide table (base_date, step_s, member, cell, variables) as a dataset: one aggregation and the distinct steps and first base dates, which are few."""
    names = tuple(c for c in df.columns if c not in TKEYS)
    lo, hi, members, cells = df.agg(F.min("base_date"), F.max("base_date"), F.max("member") + 1, F.max("cell") + 1).first()
    second = df.filter(F.col("base_date") > F.lit(str(lo)).cast("timestamp_ntz")).agg(F.min("base_date")).first()[0]
    steps = sorted(r[0] for r in df.select("step_s").distinct().collect())
    return Trajectories(df, names, lo, hi, (second or lo + timedelta(days=1)) - lo, tuple(timedelta(seconds=s) for s in steps), members, cells)


def scan(df: DataFrame, frequency: timedelta, grid: DataFrame | None = None, field_shape: tuple[int, int] | None = None, start: datetime | None = None, end: datetime | None = None) -> Cube:
    """A wide table (date, member, cell, variables) as a dataset; what isn't given of its metadata is aggregated once."""
    names = tuple(c for c in df.columns if c not in KEYS)
    lo, hi, members, cells = df.agg(F.min("date"), F.max("date"), F.max("member") + 1, F.max("cell") + 1).first()
    return Cube(df, names, start or lo, end or hi, frequency, members, cells, grid, field_shape)


def _leaf(spark: SparkSession, what: object) -> Dataset:
    if isinstance(what, Dataset):
        return what
    if isinstance(what, str):
        if what in _NAMED:
            return _leaf(spark, _NAMED[what])
        if (found := catalogued(spark, what)) is not None:
            return found
        df = stored(spark, what)
        if "base_date" in df.columns:
            return scan_trajectories(df)
        if "ts" in df.columns:
            return Observations.of(df)
        lo = df.agg(F.min("date")).first()[0]
        second = df.filter(F.col("date") > F.lit(str(lo)).cast("timestamp_ntz")).agg(F.min("date")).first()[0]
        found = scan(df, (second or lo + timedelta(days=1)) - lo, start=lo)
        return replace(found, origins={v: (what, v) for v in found.variables})
    if isinstance(what, dict):
        return open_dataset(spark, **what)
    if isinstance(what, (list, tuple)):
        return combine.automatic([_leaf(spark, w) for w in what])
    raise NotImplementedError(f"can't open {type(what).__name__}")


def _range(c: Cube, spec: dict) -> Cube:
    return c.between(spec.pop("start", None), spec.pop("end", None))


Steps = list[tuple[tuple[str, ...], Callable[[Dataset], object]]]


def _view(o: Observations, spec: dict) -> Observations:
    changes = {k: spec.pop(k) for k in ("frequency", "window", "trailing_window") if k in spec}
    changes |= {k: f(spec.pop(k)) for k, f in (("start", first_second), ("end", last_second)) if k in spec}
    return o.view(**changes)


def _tabular_thinning(o: Observations, spec: dict) -> Observations | DataFrame:
    by, method, seed = spec.pop("thinning"), spec.pop("method", "grid"), spec.pop("seed", 0)
    if method not in ("grid", "random"):
        raise ValueError(f"unknown thinning of observations: {method!r}")
    return o.thin_grid(by) if method == "grid" else o.thin_random(by, seed)


def _tabular_steps(spec: dict) -> Steps:
    pop = spec.pop
    return [
        (("start", "end", "frequency", "window", "trailing_window"), lambda o: _view(o, spec)),
        (("select",), lambda o: o.select(pop("select"))),
        (("drop",), lambda o: o.drop(pop("drop"))),
        (("area",), lambda o: o.area(*pop("area"))),
        (("thinning",), lambda o: _tabular_thinning(o, spec)),
    ]


def _trajectory_steps(spec: dict) -> Steps:
    pop = spec.pop
    if "frequency" in spec:
        raise ValueError("trajectories have base_frequency and step_frequency")
    return [
        (("start", "end"), lambda t: t.envelope(pop("start", None), pop("end", None))),
        (("select",), lambda t: t.select(pop("select"))),
        (("drop",), lambda t: t.drop(pop("drop"))),
        (("set_missing_base_dates",), lambda t: t.set_missing(pop("set_missing_base_dates"))),
        (("steps",), lambda t: t.only_steps(pop("steps"))),
        (("step_start", "step_end", "step_frequency"), lambda t: t.step_range(pop("step_start", None), pop("step_end", None), pop("step_frequency", None))),
        (("base_start", "base_end"), lambda t: t.base_range(pop("base_start", None), pop("base_end", None))),
        (("base_frequency",), lambda t: t.base_every(pop("base_frequency"))),
        (("step",), lambda t: t.step(pop("step"))),
    ]


def _gridded_steps(spec: dict) -> Steps:
    pop = spec.pop
    return [
        (("fill_missing_dates",), lambda c: series.fill_missing(c, pop("fill_missing_dates"), pop("closest", "up"))),
        (("start", "end"), lambda c: _range(c, spec)),
        (("frequency",), lambda c: c.every(pop("frequency"))),
        (("select",), lambda c: c.select(pop("select"))),
        (("drop",), lambda c: c.drop(pop("drop"))),
        (("reorder",), lambda c: c.reorder(pop("reorder"))),
        (("rename",), lambda c: c.rename(pop("rename"))),
        (("rescale",), lambda c: c.rescale(pop("rescale"))),
        (("statistics",), lambda c: statistics.with_statistics(c, pop("statistics"))),
        (("statistics_tendencies",), lambda c: statistics.with_tendency_statistics(c, pop("statistics_tendencies"))),
        (("mask",), lambda c: c.mask(pop("mask"))),
        (("trim_edge",), lambda c: c.trim_edge(*(e if isinstance(e := pop("trim_edge"), (list, tuple)) else (e,)))),
        (("thinning",), lambda c: c.thin(pop("thinning"), pop("method", "every-nth"))),
        (("area",), lambda c: c.area_of(a) if isinstance(a := pop("area"), Cube) else c.area(*a)),
        (("number",), lambda c: c.number(pop("number"), 1)),
        (("numbers",), lambda c: c.number(pop("numbers"), 1)),
        (("member",), lambda c: c.number(pop("member"))),
        (("members",), lambda c: c.number(pop("members"))),
        (("set_missing_dates",), lambda c: c.set_missing(pop("set_missing_dates"))),
        (("skip_missing_dates",), lambda c: c.skip_missing(pop("expected_access", 1)) if pop("skip_missing_dates") else c),
        (("interpolate_frequency",), lambda c: series.interpolate_frequency(c, pop("interpolate_frequency"))),
        (("interpolate_variables",), lambda c: series.interpolate_nearest_cells(c, pop("interpolate_variables"), pop("max_distance", None))),
        (("rolling_average",), lambda c: series.rolling_average(c, *pop("rolling_average")[:2])),
        (("shuffle",), lambda c: c.shuffled(pop("seed", 0)) if pop("shuffle") else c),
    ]


def _positional(spark: SparkSession, spec: dict, adjust: object) -> DataFrame:
    """Datasets side by side by position, the keywords applied to each."""
    compatible = spec.pop("check_compatibility", True)
    names = None if "zip" in spec else ("x", "y")
    given = spec.pop("zip") if "zip" in spec else spec.pop("xy") if "xy" in spec else [spec.pop("x"), spec.pop("y")]
    if names and len(given) != 2:
        raise ValueError("xy takes two datasets")
    children = [_leaf(spark, w) for w in given]
    children = combine.adjusted(children, adjust) if adjust else children
    return combine.zipped([open_dataset(spark, c, **spec) for c in children], names, compatible)


def open_dataset(spark: SparkSession, *datasets: object, **spec: object) -> Dataset | DataFrame | Tensors:
    """A dataset from a specification: a combination or a path, then unary keywords in their fixed order. Unknown keywords are an error.

    With ``tensors`` ("numpy", "arrow" or "torch") its samples are handed out as arrays.
    """
    if "tensors" in spec:
        container = spec.pop("tensors")
        return Tensors(open_dataset(spark, *datasets, **spec), container)
    adjust = spec.pop("adjust", None)
    if any(k in spec for k in POSITIONAL):
        return _positional(spark, spec, adjust)
    out: object = None
    if "complement" in spec:
        out = combine.complement(_leaf(spark, spec.pop("complement")), _leaf(spark, spec.pop("source")), spec.pop("interpolation", "none"), spec.pop("k", 1), spec.pop("max_distance", None))
    for key, f in COMBINATIONS.items():
        if out is None and key in spec:
            children = [_leaf(spark, w) for w in spec.pop(key)]
            children = combine.adjusted(children, adjust) if adjust else children
            out = f(children, **{o: spec.pop(o) for o in OPTIONS.get(key, ()) if o in spec})
    if out is None and "synthetic" in spec:
        out = synthetic(spark, **spec.pop("synthetic"))
    if out is None:
        given = [*datasets, *([spec.pop("dataset")] if "dataset" in spec else [])]
        children = [_leaf(spark, w) for w in given]
        children = combine.adjusted(children, adjust) if adjust else children
        out = children[0] if len(children) == 1 else combine.automatic(children)
    layouts = {Observations: _tabular_steps, Trajectories: _trajectory_steps}
    for keys, apply in layouts.get(type(out), _gridded_steps)(spec):
        if any(k in spec for k in keys):
            out = apply(out)
    if spec:
        raise NotImplementedError(f"unknown keywords: {sorted(spec)}")
    return out


def list_dataset_names(*datasets: object, **spec: object) -> list[str]:
    """The names and paths that a specification opens, sorted, without opening any."""
    found: set[str] = set()

    def walk(what: object) -> None:
        if isinstance(what, str):
            named = _NAMED.get(what, what)
            walk(named) if named != what else found.add(what)
        elif isinstance(what, (list, tuple)):
            for w in what:
                walk(w)
        elif isinstance(what, dict):
            for key in (*COMBINATIONS, *POSITIONAL, "y", "dataset", "complement", "source"):
                walk(what.get(key))

    walk(list(datasets))
    walk(spec)
    return sorted(found)


def new_dates(cube: Cube, stored: DataFrame) -> DataFrame:
    """Rows of dates that a stored table doesn't have yet."""
    return cube.rows().join(stored.select("date").distinct(), "date", "left_anti")


def save_dataset(dataset: Dataset, path: str, tendencies: Sequence[str] = ()) -> int:
    """Stores a dataset with all that is known of it, or adds to the stored one what it doesn't have yet; the version's number. Of cubes the statistics of differences over some deltas are stored on request."""
    return save(dataset, path, tendencies)
