"""Digests of fields, copies that resume, and names of datasets."""

from __future__ import annotations

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from stratoframe.functions import naming
from stratoframe.operators import digests
from stratoframe.plans import copying, stored
from stratoframe.plans.dataset import open_dataset
from tests.test_cube import analytic

# -- digests


def fields(df, names=("a", "b")):
    return {(r["date"], r["member"], r["variable"]): (r["n"], r["digest"]) for r in digests.field_digests(df, names).collect()}


def test_digests_are_those_of_ordered_values(spark):
    c = analytic(spark)
    base = fields(c.df)
    assert len(base) == 10 * 2 * 2 and len({d for _, d in base.values()}) == len(base)
    assert all(n == 6 and len(d) == 32 for n, d in base.values())
    assert fields(c.df.repartition(9, "cell")) == base == fields(c.df.orderBy(F.rand(3)).coalesce(1))
    swapped = c.df.withColumn("cell", F.when(F.col("cell") == 0, 1).when(F.col("cell") == 1, 0).otherwise(F.col("cell")))
    changed = fields(swapped)
    assert all(changed[k] != base[k] for k in base)  # the same values in another order


def test_special_values(spark):
    rows = [(0, 0, float("nan")), (1, 0, float("nan")), (2, 0, 0.0), (3, 0, -0.0), (4, 0, None), (5, 0, 1.0)]
    df = spark.createDataFrame(rows, "date int, cell int, v double").withColumn("member", F.lit(0))
    d = {k[0]: v[1] for k, v in fields(df, ("v",)).items()}
    assert d[0] == d[1] and d[2] == d[3] and len({d[0], d[2], d[4], d[5]}) == 4
    short = digests.field_digests(df.filter("date < 0"), ("v",))
    assert short.count() == 0


def test_constant_repeated_and_differing_fields(spark):
    c = analytic(spark)
    rows = c.df.withColumn("a", F.col("cell") * 1.0).withColumn("b", F.pmod(F.dayofmonth("date"), F.lit(3)) * 10.0 + F.col("cell"))
    found = digests.field_digests(rows, ("a", "b"))
    assert {r["variable"]: r["constant"] for r in digests.constant_by_digest(found).collect()} == {"a": True, "b": False}
    assert sorted(r["repeats"] for r in digests.repeated_fields(found).filter("variable = 'b' and member = 0").collect()) == [3, 3, 4]
    other = digests.field_digests(rows.withColumn("b", F.when((F.col("cell") == 5) & (F.dayofmonth("date") == 4), -1.0).otherwise(F.col("b"))).filter("not (member = 1 and dayofmonth(date) = 7)"), ("a", "b"))
    got = {(r["date"].day, r["member"], r["variable"]) for r in digests.differing(found, other).collect()}
    assert got == {(4, 0, "b"), (4, 1, "b"), (7, 1, "a"), (7, 1, "b")}


def test_digest_of_a_dataset(spark):
    c = analytic(spark)
    same = c.with_("dealt", df=c.df.repartition(5)).reorder(["b", "a"])
    assert digests.dataset_digest(c) == digests.dataset_digest(same)
    assert digests.dataset_digest(c.rename({"a": "z"})) != digests.dataset_digest(c) != digests.dataset_digest(c.set_missing([3]))


# -- copies


def files(path):
    return {str(p) for p in pathlib.Path(path).rglob("rows/**/*.parquet")}


@pytest.mark.parametrize("layout", ["date", "cell"])
def test_a_copy_is_the_dataset(spark, tmp_path, layout):
    c, path = analytic(spark).set_missing([4]), str(tmp_path / "copy")
    done = copying.copy(c, path, 3, layout, batch=2)
    assert done == [str(c.dates[k]) for k in (0, 3, 6, 9)]
    back = open_dataset(spark, path)
    assert sorted(back.rows().collect()) == sorted(c.rows().collect())
    assert (back.dates, back.missing, back.variables, back.cells, back.field_shape) == (c.dates, c.missing, c.variables, c.cells, c.field_shape)
    assert copying.copy(c, path, 3, layout) == [] and stored.metadata(spark, path)["version"] == 2


def test_a_cut_off_copy_resumes(spark, tmp_path, monkeypatch):
    c, path = analytic(spark), str(tmp_path / "copy")
    written = copying._written
    calls = []

    def failing(cube, where, ranges, *rest):
        calls.append(sorted(ranges))
        if len(calls) == 3:
            written(cube, where, ranges, *rest)  # rows without a version
            raise RuntimeError("lost")
        return written(cube, where, ranges, *rest)

    monkeypatch.setattr(copying, "_written", failing)
    with pytest.raises(RuntimeError):
        copying.copy(c, path, 2, batch=1)
    half = open_dataset(spark, path)
    assert sorted(set(c.dates) - half.missing) == c.dates[:4] and half.rows().count() == 4 * 12
    before = {f for f in files(path)}
    assert copying.copy(c, path, 2, batch=10) == [str(c.dates[k]) for k in (4, 6, 8)]
    assert calls[3] == [2, 3, 4] and before <= files(path)
    assert sorted(open_dataset(spark, path).rows().collect()) == sorted(c.rows().collect())


def test_only_changed_ranges_are_written(spark, tmp_path):
    c, path = analytic(spark), str(tmp_path / "copy")
    copying.copy(c, path, 2)
    changed = c.with_("changed", df=c.df.withColumn("b", F.when((F.col("cell") == 3) & (F.col("member") == 1) & (F.dayofmonth("date") == 6), 0.0).otherwise(F.col("b"))))
    assert copying.copy(changed, path, 2) == [str(c.dates[4])]
    assert sorted(open_dataset(spark, path).rows().collect()) == sorted(changed.rows().collect())
    assert open_dataset(spark, path).statistics["b"]["minimum"] == 0.0
    shorter = changed.between(c.dates[2], None)
    assert copying.copy(shorter, path, 2) == [] and open_dataset(spark, path).dates == c.dates[2:] and copying.manifest(spark, path).count() == 4
    assert len(copying.copy(shorter, path, 2, overwrite=True)) == 4
    with pytest.raises(ValueError, match="variables"):
        copying.copy(c.select(["a"]), path, 2)
    with pytest.raises(ValueError, match="copy"):
        copying.copy(c, path, 3)
    with pytest.raises(ValueError, match="unknown layout"):
        copying.copy(c, path, 2, "member")


def test_obfuscated_copies(spark, tmp_path):
    c, path = analytic(spark), str(tmp_path / "copy")
    copying.copy(c, path, 5, obfuscate=True)
    back = open_dataset(spark, path)
    assert back.rows().count() == c.rows().count() and digests.dataset_digest(back) != digests.dataset_digest(c)
    assert copying.copy(c, path, 5, obfuscate=True) == []


# -- names

NAMES = {
    "aifs-od-an-oper-0001-mars-o96-1979-2022-6h-v1": "gridded", "aifs-ea-an-mars-o96-1979-2022-1h-v12-some-more": "gridded", "x-y-z-n320-2000-2001-30m-v1": "gridded",
    "fc-od-fc-mars-o96-2020-2021-12h-6h-v1": "trajectories", "obs-synop-dop-2020-2021-v1": "tabular", "obs-x-synop-o96-2020-2021-v1": "tabular",
    "nothing": None, "a-b-c-o96-79-2022-6h-v1": None, "a-b-c-o96-1979-2022-6h": None, "": None,
}


def test_layouts_of_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert {r[0]: r[1] for r in df.select("name", naming.layout_of(F.col("name"))).collect()} == NAMES


def test_problems_of_names(spark):
    name = "aifs-od-an-mars-o96-1979-2022-6h-v1"
    cases = [
        (name, "gridded", {}, []), (name, None, {"resolution": "o96", "frequency": "6h", "start": "1979-03-01", "end": "2022-12-31"}, []),
        (name, "trajectories", {}, ["not a trajectories name"]), (name.upper(), None, {}, ["upper case", "no layout fits"]), ("a_b", None, {}, ["underscore", "no layout fits"]), ("a b!", None, {}, ["characters", "no layout fits"]),
        (name, None, {"resolution": 0.25, "frequency": "1h", "start": "1980-01-01", "end": "2021-01-01"}, ["resolution", "frequency", "start", "end"]), ("x-a-b-0p25-1979-2022-6h-v1", None, {"resolution": 0.25}, []),
        ("fc-od-fc-mars-o96-2020-2021-12h-6h-v1", "trajectories", {"frequency": "12h", "step_frequency": "1h"}, ["step_frequency"]), ("obs-x-synop-2020-2021-v1", "tabular", {"resolution": "o96", "start": "2019-01-01"}, ["start"]), ("123", "tabular", {}, ["no letters", "not a tabular name"]),
    ]
    for text, layout, actual, wanted in cases:
        df = spark.createDataFrame([(text,)], "name string")
        assert df.select(naming.problems(F.col("name"), layout, naming.Actual(**actual))).first()[0] == wanted, text
    with pytest.raises(ValueError, match="unknown layout"):
        naming.pattern("other")


def test_parts_of_names(spark):
    df = spark.createDataFrame([("aifs-od-an-oper-mars-o96-1979-2022-6h-v12-some-more",)], "name string")
    got = df.select(*[naming.part_of(F.col("name"), "gridded", p).alias(p) for p in naming.LAYOUTS["gridded"]]).first().asDict()
    assert got == {"purpose": "aifs", "labelling": "od-an-oper", "source": "mars", "resolution": "o96", "start": "1979", "end": "2022", "frequency": "6h", "version": "12", "additional": "some-more"}


def test_random_edits_are_told_apart(spark):
    """Digests of fields that differ in one value differ."""
    rng = random.Random(1)
    rows = [(d, 0, c, float(rng.randrange(3))) for d in range(200) for c in range(4)]
    df = spark.createDataFrame(rows, "date int, member int, cell int, v double")
    byvalue, bydigest = {}, {}
    for (d, _, _), (_, digest) in fields(df, ("v",)).items():
        byvalue.setdefault(tuple(r[3] for r in rows if r[0] == d), set()).add(digest)
        bydigest.setdefault(digest, set()).add(tuple(r[3] for r in rows if r[0] == d))
    assert all(len(x) == 1 for x in byvalue.values()) and all(len(x) == 1 for x in bydigest.values())
