"""Header mapping and the delimited source round trip."""

from pyspark.sql import functions as F

from lossframe.sources import headers as H


def test_normalize_header(spark):
    df = spark.createDataFrame([("受灾人口（人）",), (" Direct_Economic-Loss ",), ("县 (区)",)], "h string")
    got = [r[0] for r in df.select(H.normalize_header("h")).collect()]
    assert got == ["受灾人口", "directeconomicloss", "县"]


def test_map_columns_first_wins(spark):
    hd = spark.createDataFrame([("f", 0, "灾种"), ("f", 1, "灾害类型"), ("f", 2, "乡镇代码"), ("f", 3, "县（区）")],
                               "source string, pos int, header string")
    out = {r["pos"]: (r["target"], r["status"]) for r in H.map_columns(hd).collect()}
    assert out[0] == ("disaster_type", "matched")
    assert out[1] == (None, "unmapped")
    assert out[2] == (None, "unmapped")
    assert out[3] == ("county", "matched")


def test_csv_round_trip(spark, sf):
    from lossframe.tables import csv_ingest, raw_table
    from lossframe.sources.delimited import ingest_report
    ing = csv_ingest(spark, sf)
    raw = raw_table(spark, sf)
    assert ing.frame.count() == raw.count()
    rep = ingest_report(ing).first()
    assert rep["unmapped"] == 3 and rep["missing_required"] == ""
    # same rows apart from empty strings (read back as missing, like pandas)
    std = [c for c in raw.columns if c not in ("_seq", "_source_file", "_source_sheet")]
    norm = lambda df: df.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in std])
    assert norm(ing.frame).exceptAll(norm(raw)).count() == 0


HEAD = "编号,灾种,发生时间,县（区）,直接经济损失（万元）"


def _read(spark, *paths):
    from lossframe.sources.delimited import read_delimited
    return read_delimited(spark, [str(p) for p in paths])


def test_gbk_file(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes((HEAD + "\nR1,洪涝,2021-07-01,甲县,12\nR2,干旱,2021-07-02,乙县,3.2亿元\n").encode("gbk"))
    rows = _read(spark, tmp_path / "g.csv").frame.orderBy("_seq").collect()
    assert [(r.record_id, r.disaster_type, r.county, r.direct_economic_loss) for r in rows] == [
        ("R1", "洪涝", "甲县", "12"), ("R2", "干旱", "乙县", "3.2亿元")]
    (tmp_path / "ascii.csv").write_bytes("record_id,county\nR1,甲县\n".encode("gbk"))
    assert _read(spark, tmp_path / "ascii.csv").frame.first().county == "甲县"


def test_unreadable_charset_fails(spark, tmp_path):
    import pytest
    (tmp_path / "x.csv").write_bytes(b"record_id,county\nR1,\xff\xff\xff\n")
    with pytest.raises(Exception):
        _read(spark, tmp_path / "x.csv").frame.count()


def test_same_name_in_two_folders(spark, tmp_path):
    for folder, text in (("x", "编号,县（区）,直接经济损失（万元）\nR1,甲县,5\n"), ("y", "直接经济损失（万元）,编号,县（区）\n6,R2,乙县\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "data.csv").write_text(text, "utf-8")
    rows = _read(spark, tmp_path / "x/data.csv", tmp_path / "y/data.csv").frame.orderBy("_seq").collect()
    assert [(r.record_id, r.county, r.direct_economic_loss) for r in rows] == [("R1", "甲县", "5"), ("R2", "乙县", "6")]


def test_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('\ufeff编号,"县\n（区）",直接经济损失（万元）\nR1,"甲""乙""县","1,234"\nR2,"丙\n县",7\nR3,丁县,8\n', "utf-8")
    rows = _read(spark, tmp_path / "q.csv").frame.orderBy("_seq").collect()
    assert [(r.record_id, r.county, r.direct_economic_loss) for r in rows] == [("R1", '甲"乙"县', "1,234"), ("R2", "丙\n县", "7"), ("R3", "丁县", "8")]


def test_issues_of_unknown_and_missing_columns(spark, tmp_path):
    from lossframe.sources.delimited import ingest_issues
    (tmp_path / "a.csv").write_text("编号,县（区）,unknown\nR1,甲县,1\n", "utf-8")
    (tmp_path / "b.csv").write_text("列名,说明\nx,y\n", "utf-8")
    got = {r.code: (r["count"], r.samples) for r in ingest_issues(_read(spark, tmp_path / "a.csv", tmp_path / "b.csv")).collect()}
    assert got["SHEET_EMPTY"] == (1, "") and got["UNMAPPED_COLUMN"] == (3, "unknown,列名,说明")
    assert got["MISSING_REQUIRED_FIELD"][0] == 4


def test_csv_sink_starts_with_a_mark(spark, sf, tmp_path):
    from lossframe.sources.writers import write_clean
    from lossframe.tables import clean_table
    write_clean(clean_table(spark, sf).limit(5), str(tmp_path / "out"), "csv")
    files = list((tmp_path / "out").glob("part-*.csv"))
    assert files and all(f.read_bytes().startswith("\ufeff_seq,".encode()) for f in files)


def test_shared_folder_is_asked_for():
    import pytest

    from lossframe.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
