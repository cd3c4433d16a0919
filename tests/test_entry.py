"""Every query of the small data set that has SQL agrees with it, and the entry runs."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ranklake.plans import registry

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or v != v:
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(tuple(map(cell, r)) for r in got[columns].itertuples(index=False)) == sorted(tuple(map(cell, r)) for r in want[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
