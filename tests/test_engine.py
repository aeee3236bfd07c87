"""The engine, the catalogue and the stream on Spark."""

import datetime
import sys

import pytest

from quire import engine
from quire.operators import relational
from quire.plans import catalogue
from quire.sources import tables
from quire.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_one_row_per_file(spark):
    rows = [(1, b"a,b\n1,2\n", "x.csv"), (2, b"\0", None), (3, None, "x.txt"), (4, b"%PDF-1", "x.csv"), (5, b"<html><p>x", "p"), (None, b"{}", None)]
    df = spark.createDataFrame(rows, "doc_id long, content binary, path string")
    found = {r["doc_id"]: r for r in engine.to_markdown(df, path="path").collect()}
    assert len(found) == 6
    assert (found[1]["format"], found[1]["markdown"], found[1]["error"]) == ("csv", "| a | b |\n| --- | --- |\n| 1 | 2 |\n", None)
    assert found[2]["error"]["code"] == "unsupported" and found[2]["markdown"] is None
    assert found[3]["markdown"] == ""
    assert found[4]["error"]["message"] == "unsupported input: pdf"
    assert found[5]["markdown"] == "x\n"
    assert found[None]["markdown"] == "```json\n{}\n```\n"
    assert engine.to_markdown(df.limit(0), path="path").collect() == []


def test_conversion_is_one_narrow_pass(spark):
    plan = catalogue.pages_to_markdown(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<page_id:bigint,html:string>" in plan


@pytest.mark.parametrize("name", ["heading_fragments", "dense_sheets", "merged_cells", "header_rows", "subtitle_cues", "alpha_labels", "excel_dates", "cell_kinds"])
def test_queries_match_their_sql(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = catalogue.QUERIES[name](spark, SF)
    asked = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, asked.fetchall()))


def test_relational(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 1, 1), ("b", 2, 2)], "k string, o int, v int")
    assert sorted(map(tuple, relational.modal(rows.select("k", "v"), ["k"], "v").collect())) == [("a", 5), ("b", 2)]
    assert sorted(map(tuple, relational.modal(rows.select("k", "v"), ["k"], "v", largest=False).collect())) == [("a", 5), ("b", 1)]
    assert sorted((r["k"], r["o"]) for r in relational.first_wins(rows, ["k"], "o").collect()) == [("a", 1), ("b", 1)]
    assert sorted(map(tuple, relational.upper_median(rows.select("k", "o"), ["k"], "o").collect())) == [("a", 2), ("b", 2)]


def test_stream_converts_each_file_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.csv").write_text(f"a,b\n{k},x\n")
        ingest.to_parquet(ingest.converted(spark, str(folder)), str(out), str(state)).start().awaitTermination()
        assert spark.read.parquet(str(out)).count() == k + 1
    assert {r["format"] for r in spark.read.parquet(str(out)).collect()} == {"csv"}
    assert tables.folder(spark, str(folder), "*.csv").count() == 2


def test_stream_counts(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a")
    counts = ingest.counts_by_window(spark, str(tmp_path))
    query = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("counted").first()
    assert (row["extension"], row["files"], row["bytes"]) == ("csv", 1, 1) and isinstance(row["window"]["start"], datetime.datetime)


def test_entry_without_the_optional_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quire.llm")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "quire.llm", None)
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pages_to_markdown" in names and not any(n.startswith("op1_") or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
