"""Every catalogue query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os
import pathlib
import shutil
import subprocess
import sys
from datetime import datetime

import duckdb
import pytest

from stratoframe.plans import catalogue

FOLDER = os.environ.get("STRATOFRAME_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, oracle, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in (sql := catalogue.oracle_sql()):
        found = oracle.execute(sql[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall())


def test_changes_of_large_sums_are_different(spark, tmp_path):
    """Sums as large as those of tables that are many times larger."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (l_quantity * 10000 AS l_quantity) FROM '{FOLDER}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = [tuple(r) for r in catalogue.queries()["compare_datasets"](spark, str(tmp_path)).collect()]
    assert got == con.execute(catalogue.oracle_sql()["compare_datasets"]).fetchall()


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("stratoframe/llm", "tests/llm"), ("stratoframe/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_works_without_the_removable_parts(tmp_path, gone):
    root = pathlib.Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or str((pathlib.Path(folder) / n).relative_to(root)) in gone])
    code = "import __spark_entry__ as e; assert 'statistics' in e.queries() and 'statistics' in e.oracle_sql(); assert not [n for n in e.queries() if n.startswith('op') and n[2].isdigit() or n == 'pipeline']"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
