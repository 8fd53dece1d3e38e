"""Fingerprints of fields: digests of ordered values that merge, so equal, constant and changed fields are found in one pass.

A field is the values of one variable on one date for one member, in the order of cells. Its digest is the sum, in the ring of
128-bit numbers made of two 64-bit ones, of hashes of (cell, value): each value's hash is keyed by its place, so sums taken in any order and in any parts
are that of the ordered field, and partial sums are made where rows are read. NaN equals NaN, zeros of both signs are equal, and a missing row differs from any value. Digests of fields are summed
the same way to those of dates, ranges and datasets. Different fields have equal digests with a chance of 2**-128 or so, for values that aren't chosen to collide.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratoframe.operators.cube import Cube

RING = Decimal(1 << 64)
SEEDS = (11, 23)


def ring_sum(value: Column) -> Column:
    """A sum of longs modulo 2**64, as a decimal from 0: partial sums don't overflow."""
    total = F.sum(value.cast("decimal(38,0)"))
    return F.pmod(total, F.lit(RING)).cast("decimal(20,0)")


def _joined(sums: Sequence[Column]) -> Column:
    """Ring numbers as one text of hexadecimal digits."""
    half = lambda d: F.lower(F.lpad(F.hex(F.when(d >= F.lit(RING / 2), d - F.lit(RING)).otherwise(d).cast("long")), 16, "0"))
    return F.concat(*[half(s) for s in sums])


def field_digests(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("date", "member"), place: Sequence[str] = ("cell",)) -> DataFrame:
    """keys, variable, n, digest of each field of a wide table; one aggregation for all variables."""
    sums = [ring_sum(F.xxhash64(*place, F.col(v).cast("double"), F.lit(seed))).alias(f"_{k}_{seed}") for k, v in enumerate(variables) for seed in SEEDS]
    each = df.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    fields = F.array(*[F.struct(F.lit(v).alias("variable"), _joined([F.col(f"_{k}_{seed}") for seed in SEEDS]).alias("digest")) for k, v in enumerate(variables)])
    return each.select(*keys, "n", F.explode(fields).alias("_field")).select(*keys, "_field.variable", "n", "_field.digest")


def combined(digests: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """by, n, digest: of all fields of a group, each keyed by ``keys`` (what tells it from the group's other fields)."""
    sums = [ring_sum(F.xxhash64(*keys, "digest", "n", F.lit(seed))).alias(f"_{seed}") for seed in SEEDS]
    grouped = digests.groupBy(*by) if by else digests.groupBy()
    return grouped.agg(F.sum("n").alias("n"), *sums).select(*by, "n", _joined([F.col(f"_{seed}") for seed in SEEDS]).alias("digest"))


def dataset_digest(cube: Cube) -> str:
    """One digest of all present fields, the same for the same values whatever the order of rows and variables."""
    row = combined(field_digests(cube.rows(), cube.variables), (), ("date", "member", "variable")).first()
    return row["digest"] or "0" * 32


def constant_by_digest(digests: DataFrame) -> DataFrame:
    """variable, constant: whether each member has one field on all dates."""
    each = digests.groupBy("variable", "member").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    return each.groupBy("variable").agg(F.bool_and(F.col("a") == F.col("b")).alias("constant"))


def repeated_fields(digests: DataFrame) -> DataFrame:
    """variable, member, digest, first (date), repeats: fields that occur on several dates."""
    found = digests.groupBy("variable", "member", "digest").agg(F.min("date").alias("first"), F.count("*").alias("repeats"))
    return found.filter("repeats > 1")


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """date, member, variable of fields that differ between two tables of digests, or that only one of them has."""
    keys = ["date", "member", "variable"]
    joined = one.select(*keys, F.col("digest").alias("_a")).join(other.select(*keys, F.col("digest").alias("_b")), keys, "full_outer")
    return joined.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)
