"""The delimited ingest reads its lines as seldom as it can, sorts none to inspect them and orders files by the key alone."""

import random

from pyspark.sql import functions as F

from lossframe import tables
from lossframe.sources import delimited, records, writers
from lossframe.sources.delimited import inspect_files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_read_once_for_their_starts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n', "utf-8")
    assert plan_of(records.open_blocks(records._lines(spark, [str(tmp_path / "a.csv")]))).count("MapInArrow") == 1


def test_lines_are_not_sorted_to_inspect_files(spark, tmp_path):
    good = 'h1,h2\n1,"x ""y"" z"\n2,"two\nlines"\n'
    for name, raw in (("u", good.encode()), ("g", "编号,灾种\nR1,洪涝\n".encode("gbk")), ("q", 'h,i\n1,"x, y"\n'.encode()), ("empty", b"")):
        (tmp_path / f"{name}.csv").write_bytes(raw)
    paths = [str(p) for p in tmp_path.glob("*.csv")]
    found = {f.path.rsplit("/", 1)[1]: (f.header, f.charset, f.broken) for f in inspect_files(spark, paths)}
    assert found == {"u.csv": ("h1,h2", "UTF-8", True), "g.csv": ("编号,灾种", "GBK", False), "q.csv": ("h,i", "UTF-8", False)}
    assert "SortAggregate" not in plan_of(delimited._file_kinds(delimited._file_lines(spark, paths)))


def test_lines_between_quotes_are_cut_in_batches(spark, tmp_path):
    """Runs of lines without quotes inside and outside cells, over several Arrow batches."""
    rng = random.Random(5)
    cells = [f'"c{i}' + "\nplain,line" * rng.choice((1, 40)) + '"' if rng.random() < 0.1 else f"c{i}" for i in range(2000)]
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f"{i},{c}\n" for i, c in enumerate(cells)), "utf-8")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        rows = delimited._broken_cells(spark, [str(tmp_path / "a.csv")], "UTF-8", 2).orderBy("_seq").collect()
    finally:
        spark.conf.set(key, before)
    assert [tuple(r.cells) for r in rows] == [(str(i), c.strip('"')) for i, c in enumerate(cells)]


def test_files_are_ordered_by_a_scan_of_the_key(spark, monkeypatch):
    monkeypatch.setattr(writers, "_FILE_ROWS", 10)
    keys = [None, None, -5, 7, 7, 7, *range(100, 0, -1), 10**12]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k long, t string").repartition(4)
    got = writers.in_order(df, "k")
    parts = got.select("k", F.spark_partition_id().alias("p")).collect()
    assert [r.k for r in parts] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert len({r.p for r in parts}) > 5 and "rangepartitioning" not in plan_of(got)
    assert writers.in_order(df.where("k = 0.5"), "k").count() == 0
    named = df.select(F.struct("t", "k").alias("k"))  # as an ingest's order
    assert [r.k for r in writers.in_order(named, "k").collect()] == [r.k for r in named.orderBy("k").collect()]


def test_reports_count_rows_without_writing_them(spark, sf):
    from lossframe.registry import QUERIES

    tables.reset()
    written = []
    real = tables.write_parquet
    tables.write_parquet = lambda df, path, *by: (written.append(path), real(df, path, *by))[1]
    try:
        assert QUERIES["ingest_issues"](spark, sf).count() == 2 and QUERIES["ingest_report"](spark, sf).first().rows_out > 0
        assert not any("ingested" in p for p in written)
        n = tables.csv_ingest(spark, sf, pinned=False).frame.count()
        assert QUERIES["src_csv"](spark, sf).count() == n and sum("ingested" in p for p in written) == 1
        assert QUERIES["ingest_report"](spark, sf).first().rows_out == n
    finally:
        tables.write_parquet = real
        tables.reset()
