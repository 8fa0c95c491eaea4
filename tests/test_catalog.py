"""Every catalog query with SQL, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

from quillworks import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return tuple(sorted(v.items())) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
