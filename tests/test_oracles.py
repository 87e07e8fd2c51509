"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import glob
import os

import duckdb
import pytest

from weftlist.plans import registry

DATA = "/root/testdata/sf0.001"


def norm(x):
    if isinstance(x, float):
        return round(x, 4)
    if hasattr(x, "tolist"):
        x = x.tolist()
    return tuple(map(norm, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.sql(registry.SQL[name])
    columns = sorted(want.columns)
    got = registry.Q[name](spark, DATA)
    assert sorted(got.columns) == columns
    a = sorted((norm(tuple(r[c] for c in columns)) for r in got.collect()), key=repr)
    order = [want.columns.index(c) for c in columns]
    b = sorted((norm(tuple(r[i] for i in order)) for r in want.fetchall()), key=repr)
    assert a == b


def test_flagship(spark):
    rows = registry.flagship(spark, DATA).collect()
    assert len(rows) == 50 and all(r.size >= 3 for r in rows)
