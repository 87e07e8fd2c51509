"""Titles with cut references and shares that binary fractions miss, against DuckDB's SQL."""

import duckdb
import pytest

from weftlist.plans import registry


def same(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{table}.parquet"))
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.Q[name](spark, str(folder)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_titles(spark, tmp_path):
    htmls = ["<title>a &amp b&amp</title><h1>c&lt</h1>", "<title>a &amp;lt; b</title><h1> x&#39;\n y</h1><h1>z</h1>", "<p>none</p>", "<title lang='en'>x</title><h1>a <b>b</b>\r\t c&nbsp;</h1>", "<title></title><h1>" + "é" * 140 + "</h1>", "<h1>" + "y" * 141 + "</h1>", "<h1>a\x85b  c</h1>", "", None]
    same(spark, tmp_path, "page_titles", "pages", list(enumerate(htmls)), "page_id long, html string")


@pytest.mark.parametrize("n", [0, 1, 9, 90, 115])
def test_split(spark, tmp_path, n):
    same(spark, tmp_path, "train_test_split", "customer", [(i,) for i in range(n)], "c_custkey long")
