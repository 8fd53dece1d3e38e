"""Greedy thinning by distance: in order, a point is kept if no kept point before it lies within the distance.

A point's fate hangs on near points before it, and chains of such points may be long. So whole blocks of space are settled at once, each by the plain greedy
pass over its points and those of its border (points of other blocks within the distance). A point of a block is kept if no near point before it is kept or open, it goes if one
is kept, and it stays open if its fate hangs on an open point of the border. What is open after a round is dealt anew to
blocks of at least twice the size, together with the points just kept, so chains that a border cut lie inside of a block then: rounds grow
with the logarithm of the extent, not with the length of chains. A block holds about ``BLOCK`` points; blocks that would hold over ``MOST`` aren't
enlarged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratoframe.functions import geo
from stratoframe.operators.side import cut

#: Points that a block should hold about, and the most that it may.
BLOCK, MOST = 20_000, 2_000_000
#: A block's side in distances, at least: its border is one distance wide.
NARROW = 4
OPEN, KEPT = 0, 1


def settled(xyz: np.ndarray, own: np.ndarray, kept: np.ndarray, limit: float) -> np.ndarray:
    """States after one greedy pass over points in order: 1 kept, 0 open, -1 gone. ``kept`` ones are so from before; of points that aren't the block's own only that they go can be told."""
    state = np.zeros(len(xyz), np.int8)
    cells: dict[tuple[int, int, int], list[int]] = {}
    where = np.floor(xyz / limit).astype(np.int64).tolist()
    places, square = xyz.tolist(), limit
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    fixed = np.flatnonzero(kept).tolist()
    for i in fixed:
        state[i] = 1
        cells.setdefault(tuple(where[i]), []).append(i)
    for i in np.flatnonzero(~kept).tolist():
        (a, b, c), (x, y, z) = where[i], places[i]
        found = 1 if own[i] else 0
        for da, db, dc in around:
            for j in cells.get((a + da, b + db, c + dc), ()):
                u, v, w = places[j]
                if math.sqrt((x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2) <= square:
                    if state[j] == 1:
                        found = -1
                        break
                    found = 0
            if found < 0:
                break
        state[i] = found
        if found >= 0:
            cells.setdefault((a, b, c), []).append(i)
    return state


def _blocks(points: DataFrame, side: float, limit: float) -> DataFrame:
    """Points with each block (bx, by, bz) that they lie in or within the distance of, and whether it is their own."""
    out = points
    for c, b in (("x", "bx"), ("y", "by"), ("z", "bz")):
        at = lambda v: F.floor(v / side).cast("int")
        out = out.withColumn(b, F.explode(F.sequence(at(F.col(c) - limit), at(F.col(c) + limit)))).withColumn(f"own_{b}", F.col(b) == at(F.col(c)))
    return out.withColumn("own", F.col("own_bx") & F.col("own_by") & F.col("own_bz")).drop("own_bx", "own_by", "own_bz")


def one_round(points: DataFrame, side: float, limit: float) -> DataFrame:
    """Points (k, x, y, z, state) after a greedy pass in each block: those kept now and those still open."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            block = pa.Table.from_batches(held).select(["k", "x", "y", "z", "state", "own"]).combine_chunks().sort_by("k")
            kept, own = block.column("state").to_numpy() == KEPT, block.column("own").to_numpy(zero_copy_only=False)
            xyz = np.stack([block.column(c).to_numpy() for c in "xyz"], axis=1)
            state = settled(xyz, own, kept, limit)
            fresh = own & ~kept & (state >= 0)
            found = block.select(["k", "x", "y", "z"]).append_column("state", pa.array(state.astype(np.int32))).filter(pa.array(fresh))
            yield from found.to_batches()

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bx", "by", "bz")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (key := tuple(keys[a])) != at:
                    yield from out()
                    at, held = key, []
                held.append(batch.slice(a, b - a))
        yield from out()

    kind = points.schema["k"].dataType.simpleString()
    names = ("bx", "by", "bz")
    dealt = _blocks(points, side, limit).repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(passed, f"k {kind}, x double, y double, z double, state int")


def thinned_by_distance(points: DataFrame, km: float, order: str, block: int = BLOCK) -> DataFrame:
    """The points (latitude, longitude) that the greedy pass in the order of a column of distinct values keeps."""
    limit = geo.chord_of_km(km)
    x, y, z = geo.xyz(F.col("latitude"), F.col("longitude"))
    left = cut(points.select(F.col(order).alias("k"), x.alias("x"), y.alias("y"), z.alias("z"), F.lit(OPEN).alias("state")))
    kept, side = [], 0.0
    while n := left.filter(F.col("state") == OPEN).count():
        before, side = side, max(NARROW * limit, 2 * side, math.sqrt(4 * math.pi * block / n))
        fullest = lambda s: left.groupBy(*[F.floor(F.col(c) / s) for c in "xyz"]).count().agg(F.max("count")).first()[0]  # noqa: B023, E731
        while side > max(before, NARROW * limit) and fullest(side) > max(MOST, block):
            side = max(side / 2, before, NARROW * limit)
        left = cut(one_round(left, side, limit))
        kept.append(left.filter(F.col("state") == KEPT).select(F.col("k").alias(order)))
    found = points.select(order).limit(0)
    for part in kept:
        found = found.unionByName(part)
    return points.join(found, order, "left_semi")
