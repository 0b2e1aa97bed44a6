"""Every panel query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from tests.conftest import SF
from tidemark.plans import queries as registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def norm(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return f"{x:.5f}".replace("-0.00000", "0.00000")
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    a = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    b = sorted(tuple(norm(r[want.columns.index(c)]) for c in names) for r in want.fetchall())
    assert a == b and a
