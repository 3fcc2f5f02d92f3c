"""Every query of the catalogue against its SQL, and none of them empty."""

import glob
import math
import os

import duckdb
import pytest

from glossmill import oracle, queries


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if hasattr(v, "__float__") and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.01/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    assert got
    if name in oracle.ORACLE_SQL:
        found = duck.sql(oracle.ORACLE_SQL[name])
        assert sorted(found.columns) == names
        at = [found.columns.index(n) for n in names]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_oracles_have_queries():
    assert set(oracle.ORACLE_SQL) <= set(queries.QUERIES)
