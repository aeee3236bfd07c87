"""Queries that take every row, against their SQL."""

import glob
import os

import duckdb
import pytest

from quire.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["list_runs", "dense_sheets", "merged_cells", "heading_slugs", "order_files_to_markdown", "order_headers", "header_rows", "rtf_to_markdown"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = catalogue.QUERIES[name](spark, SF)
    asked = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, asked.fetchall()))


def test_every_cell_is_there(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    cells = catalogue.dense_sheets(spark, SF).where("value != ''").count()
    assert cells == rows.select("l_suppkey", "l_orderkey", "l_linenumber").distinct().count()
    assert catalogue.list_runs(spark, SF).selectExpr("sum(items)").first()[0] == rows.select("l_suppkey", "l_orderkey").distinct().count()
