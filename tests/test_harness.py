import duckdb
import pytest

import __spark_entry__
from rollbook.plans import harness

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", sorted(harness.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = harness.queries()[name](spark, SF)
    want = duck.sql(harness.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id"]


def equals_sql(spark, folder, name, table, data, schema):
    """The query's rows and its SQL's over a table of a few odd rows."""
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(folder / f"{table}.parquet"))
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, want = harness.queries()[name](spark, str(folder)), con.sql(harness.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_odd_pages(spark, tmp_path):
    heads = ["<title>a = &quot;b&quot; &amp; c &AMP; d&#39;s </title>", "<title>é</title><META\nhttp-equiv=x content='text/html; CHARSET=ISO-8859-1'>", "<meta name=a><meta charset=utf-8>", "<metaé x><metaX><title\n>&amp;amp; x", "", None]
    equals_sql(spark, tmp_path, "html_meta", "pages", [(k, "https://x.example", h) for k, h in enumerate(heads)], "page_id long, url string, html string")
