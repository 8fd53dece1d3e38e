"""Greedy thinning against the plain pass: chains, blocks with borders, clusters."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratoframe.functions import geo
from stratoframe.operators import thinning
from stratoframe.operators.cube import thinned
from stratoframe.operators.side import numbered


def truth(points, km):
    limit, kept = geo.chord_of_km(km), []
    for k, la, lo in sorted(points):
        a, o = math.radians(la), math.radians(lo)
        p = (math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a))
        if all(math.dist(p, q) > limit for _, q in kept):
            kept.append((k, p))
    return [k for k, _ in kept]


def frame(spark, points):
    return spark.createDataFrame(points, "k int, latitude double, longitude double")


def kept(df):
    return sorted(r["k"] for r in df.collect())


def chain(n):
    return [(k, 0.0, k * 0.1) for k in range(n)]


@pytest.mark.parametrize("block", [20_000, 3])
def test_chains(spark, block):
    points = chain(60)
    got = thinning.thinned_by_distance(frame(spark, points), 15.0, "k", block)
    assert kept(got) == truth(points, 15.0) == list(range(0, 60, 2))


def test_rounds_dont_grow_with_chains(spark, monkeypatch):
    rounds = []
    one = thinning.one_round
    monkeypatch.setattr(thinning, "one_round", lambda *a: rounds.append(1) or one(*a))
    thinning.thinned_by_distance(frame(spark, chain(400)), 15.0, "k")
    assert len(rounds) == 1
    rounds.clear()
    found = thinning.thinned_by_distance(frame(spark, chain(400)), 15.0, "k", 20)
    assert kept(found) == list(range(0, 400, 2)) and len(rounds) <= 8


@pytest.mark.parametrize(("seed", "block", "km"), [(1, 20_000, 300.0), (2, 10, 300.0), (3, 5, 900.0), (4, 30, 2_000.0)])
def test_random_points(spark, seed, block, km):
    rng = random.Random(seed)
    centres = [(rng.uniform(-80, 80), rng.uniform(0, 360)) for _ in range(4)]
    points = [(k, rng.uniform(-90, 90), rng.uniform(0, 360)) for k in range(250)]
    points += [(250 + k, max(-90.0, min(90.0, la + rng.gauss(0, 4))), (lo + rng.gauss(0, 4)) % 360) for k, (la, lo) in enumerate(rng.choices(centres, k=250))]
    points += [(500 + k, *points[k][1:]) for k in range(20)]  # repeated places
    order = list(range(len(points)))
    rng.shuffle(order)
    points = [(o, la, lo) for o, (_, la, lo) in zip(order, points, strict=True)]
    assert kept(thinned(frame(spark, points), km, "distance-based", "k") if block == 20_000 else thinning.thinned_by_distance(frame(spark, points), km, "k", block)) == truth(points, km)


def test_no_points(spark):
    assert kept(thinning.thinned_by_distance(frame(spark, []), 10.0, "k")) == []


def test_points_of_the_border_are_never_kept():
    xyz = np.array([[0.0, 0, 0], [0.5, 0, 0], [1.2, 0, 0], [5.0, 0, 0]])
    every, none = np.ones(4, bool), np.zeros(4, bool)
    assert thinning.settled(xyz, every, none, 1.0).tolist() == [1, -1, 1, 1]
    assert thinning.settled(xyz, np.array([False, True, True, True]), none, 1.0).tolist() == [0, 0, 0, 1]
    assert thinning.settled(xyz, every, np.array([False, False, True, False]), 1.0).tolist() == [1, -1, 1, 1]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000 * 3).alias("cell")).repartition(5)
    for few in (2000, 100):
        found, n = numbered(df, "cell", "new", few)
        assert n == 1000 and sorted((r["cell"], r["new"]) for r in found.collect()) == [(3 * k, k) for k in range(1000)]
    assert numbered(df.limit(0), "cell", "new")[1] == 0
