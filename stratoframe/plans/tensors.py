"""Samples as arrays for training: packed on the executors, handed out one after the other in their order, never collected.

A sample of a cube is a date: an array (variable, member, cell). A sample of observations is a window: an array (row,
variable) with its times, latitudes and longitudes. Rows are dealt by ranges of samples and sorted, each range is packed in Arrow batches into one
binary value a sample, and a loop fetches one range at a time, so its memory is bounded by ``samples_at_once`` samples. A
lost executor costs the range it held. Single samples are read by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratoframe.operators.cube import Cube, MissingDateError, on_dates
from stratoframe.operators.tabular import Observations

#: Samples in a range that is fetched as a whole.
AT_ONCE = 16


def _torch(array: np.ndarray) -> object:
    import torch

    return torch.from_numpy(array)


#: What arrays are made into.
CONTAINERS: dict[str, Callable[[np.ndarray], object]] = {"numpy": lambda a: a, "arrow": lambda a: pa.Tensor.from_numpy(a), "torch": _torch}


@dataclass(frozen=True)
class WindowSample:
    """A window's rows: values (row, variable), times relative to the reference in seconds, and places."""

    index: int
    reference: datetime
    values: object
    timedeltas: object
    latitudes: object
    longitudes: object


def _packed(df: DataFrame, key: str, columns: tuple[str, ...], parts: int, order: tuple[str, ...]) -> DataFrame:
    """One row for each key: its number of rows and the columns' values as float64, column after column, in one binary value."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                values = np.concatenate(held, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([values.shape[1]], pa.int64()), pa.array([values.tobytes()], pa.binary())], names=["key", "n", "bytes"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]])
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and keys[a] != at:
                    yield from out()
                    at, held = int(keys[a]), []
                if a < b:
                    held.append(values[:, a:b])
        yield from out()

    numbers = df.select(F.col(key).cast("long").alias("_key"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)], *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    dealt = numbers.repartitionByRange(parts, "_key").sortWithinPartitions("_key", *[f"_o{k}" for k in range(len(order))])
    return dealt.select("_key", *[f"_{k}" for k in range(len(columns))]).mapInArrow(packed, "key long, n long, bytes binary")


@dataclass(frozen=True)
class Tensors:
    """The samples of a dataset by position and in a loop."""

    dataset: Cube | Observations
    container: str = "numpy"
    samples_at_once: int = AT_ONCE

    def __post_init__(self) -> None:
        if self.container not in CONTAINERS:
            raise ValueError(f"unknown container {self.container!r}; there are {sorted(CONTAINERS)}")

    def __len__(self) -> int:
        return len(self.dataset.dates) if isinstance(self.dataset, Cube) else len(self.dataset)

    @property
    def shape(self) -> tuple[int, ...]:
        """Of a cube: (date, variable, member, cell)."""
        if not isinstance(self.dataset, Cube):
            raise TypeError("windows have no common shape")
        return self.dataset.shape

    def __getitem__(self, index: int) -> object:
        n = len(self)
        if not -n <= index < n:
            raise IndexError(f"sample {index} of {n}")
        return next(self._loop([index % n]))

    def __iter__(self) -> Iterator[object]:
        """All samples in order; of a cube a flagged missing date is an error when it is reached."""
        return self._loop(None)

    def present(self) -> Iterator[tuple[int, object]]:
        """Positions and samples, without the missing dates of a cube."""
        gone = set(self.dataset.missing_indices) if isinstance(self.dataset, Cube) else set()
        kept = [k for k in range(len(self)) if k not in gone]
        return zip(kept, self._loop(kept), strict=True)

    def _loop(self, wanted: list[int] | None) -> Iterator[object]:
        return self._cube_loop(wanted) if isinstance(self.dataset, Cube) else self._window_loop(wanted)

    def _parts(self, samples: int) -> int:
        return max(1, -(-samples // self.samples_at_once))

    def _cube_loop(self, wanted: list[int] | None) -> Iterator[np.ndarray]:
        c, make = self.dataset, CONTAINERS[self.container]
        positions = range(len(self)) if wanted is None else wanted
        gone = set(c.missing_indices)
        present = [k for k in positions if k not in gone]
        rows = c.df if len(present) == len(c.dates) else on_dates(c.df, [c.dates[k] for k in present]) if present else c.df.limit(0)
        made = _packed(rows.withColumn("_at", c.date_idx), "_at", c.variables, self._parts(len(present)), ("member", "cell"))
        found = made.toLocalIterator()
        for k in positions:
            if k in gone:
                raise MissingDateError(f"{c.dates[k]} is missing")
            row = next(found, None)
            if row is None or row["key"] != k or row["n"] != c.members * c.cells:
                raise ValueError(f"{c.dates[k]} has not one row for each member and cell")
            yield make(np.frombuffer(row["bytes"], np.float64).reshape(len(c.variables), c.members, c.cells).astype(np.float32))

    def _window_loop(self, wanted: list[int] | None) -> Iterator[WindowSample]:
        o, make = self.dataset, CONTAINERS[self.container]
        if wanted is not None and len(wanted) == 1:
            rows, positions = o.sample(wanted[0]), wanted
        else:
            rows, positions = o.samples(), range(len(self)) if wanted is None else wanted
        made = _packed(rows, "sample", ("timedelta", "latitude", "longitude", *o.variables), self._parts(len(positions)), ("ts", "latitude", "longitude", *o.variables))
        found = made.toLocalIterator()
        row = next(found, None)
        for k in positions:
            while row is not None and row["key"] < k:
                row = next(found, None)
            n, data = (row["n"], row["bytes"]) if row is not None and row["key"] == k else (0, b"")
            values = np.frombuffer(data, np.float64).reshape(3 + len(o.variables), n)
            reference = o.start + k * o.frequency
            yield WindowSample(k, reference, make(np.ascontiguousarray(values[3:].T, np.float32)), make(values[0].astype(np.int64)), make(values[1].copy()), make(values[2].copy()))


def digests(t: Tensors) -> DataFrame:
    """date_idx, n, total of each packed date of a cube: what a loop would see, summed on the executors."""
    c, names = t.dataset, len(t.dataset.variables)
    made = _packed(c.rows().withColumn("_at", c.date_idx), "_at", c.variables, t._parts(len(c.dates)), ("member", "cell"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.frombuffer(b.as_py(), np.float64).reshape(names, -1) for b in batch.column(2)]
            first = [float(a[0].sum()) for a in arrays]
            last = [float(a[-1, -1]) for a in arrays]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.float64()), pa.array(last, pa.float64())], names=["date_idx", "n", "total", "last"])

    return made.mapInArrow(summed, "date_idx long, n long, total double, last double")


