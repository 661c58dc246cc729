"""Delimited files with line breaks in cells: cut in blocks, equal to reading them as one piece."""

import random

import pytest
from pyspark.sql import functions as F

from lossframe.sources import delimited, records
from lossframe.sources.delimited import inspect_files, read_delimited

HEADER = "编号,灾种,发生时间,县（区）,直接经济损失（万元）"


@pytest.fixture
def blocks(spark):
    """Cuts files into blocks of a few bytes, many to a file."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = [spark.conf.get(k, None) for k in keys]

    def cut(size):
        for k, v in zip(keys, (str(size), "1", "1")):
            spark.conf.set(k, v)

    yield cut
    for k, v in zip(keys, old):
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def whole(spark, path, width, charset="UTF-8"):
    """The file read as one piece."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    df = spark.read.options(quote='"', escape='"', header=True, multiLine=True, encoding=charset).schema(schema).csv(str(path))
    return [tuple(r) for r in df.collect()]


def cut(spark, path, width, charset="UTF-8"):
    rows = delimited._broken_cells(spark, [str(path)], charset, width).orderBy("_seq").collect()
    return [tuple(r.cells) for r in rows]


CELLS = ["a", "", "7", '"q"', '"x,y"', '"two\nlines"', '"a ""said"" b"', '"""\n"""', '"\n\n,"', '5" pipe', 'x"y"z', '""', '"c" d', "日本", '" \r\n "', '"long ' + "w\n" * 30 + '"']


@pytest.mark.parametrize("size", [150, 100_000])
def test_equal_to_reading_in_one_piece(spark, tmp_path, blocks, size):
    rng = random.Random(size)
    path = tmp_path / "rows.csv"
    lines = [",".join(rng.choice(CELLS) for _ in range(3)) for _ in range(120)]
    path.write_text("a,b,c\n" + "\n".join(x if x.strip() else "z,," for x in lines) + "\n", encoding="utf-8")
    want = whole(spark, path, 3)
    blocks(size)
    assert cut(spark, path, 3) == want and len(want) == 120


def test_line_ends_and_the_last_record(spark, tmp_path, blocks):
    for k, text in enumerate(('a,b\r\n1,"x\r\ny"\r\n2,z\r\n', 'a,b\n1,"never\nclosed', 'a,b\n\n1,"x\n\ny"\n\n2,"z"', 'a,"b\nc"\n1,2\n"3\n",4')):
        path = tmp_path / f"{k}.csv"
        path.write_bytes(text.encode())
        want = whole(spark, path, 2)
        blocks(9)
        assert cut(spark, path, 2) == want, text


def test_blocks_inside_one_cell(spark, tmp_path, blocks):
    """A cell over many blocks, a quote that a block's start looks like opening, and states found block by block."""
    path = tmp_path / "deep.csv"
    path.write_text('a,b\n1,"' + 'line,""q""\n",'[:-2] * 60 + '"\n2,"x"\n' + "3,y\n" * 50, encoding="utf-8")
    want = whole(spark, path, 2)
    blocks(50)
    assert cut(spark, path, 2) == want and len(want) == 52
    lines = records._lines(spark, [str(path)])
    assert records.open_blocks(lines).count() > 8 and lines.select("block").distinct().count() > 15


def test_many_tasks_read_a_file_with_one_broken_line(spark, tmp_path, blocks):
    path = tmp_path / "reports.csv"
    body = "".join(f'R{i},洪涝,2021-07-01,A县,{i}\n' for i in range(3000)) + 'R3000,"洪\n涝",2021-07-02,"B\n县",1\n' + "".join(f"R{i},干旱,2021-07-03,C县,{i}\n" for i in range(3001, 6000))
    for charset, name in (("utf-8", "u.csv"), ("gbk", "g.csv")):
        path = tmp_path / name
        path.write_bytes((HEADER + "\n" + body).encode(charset))
        blocks(16_384)
        frame = read_delimited(spark, [str(path)]).frame
        rows = frame.orderBy("_seq").select("record_id", "disaster_type", "county", "_source_file", "_source_sheet").collect()
        assert [r.record_id for r in rows] == [f"R{i}" for i in range(6000)]
        assert rows[3000].disaster_type == "洪\n涝" and rows[3000].county == "B\n县"
        assert rows[0]["_source_file"] == name and rows[0]["_source_sheet"] == name[0]
        tasks = records._lines(spark, [str(path)]).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 5


def test_headers_of_any_length(spark, tmp_path):
    path = tmp_path / "tall.csv"
    path.write_text('编号,"灾' + "\n" * 299 + '种",发生时间\nR1,洪涝,2021-07-01\n', encoding="utf-8")
    info, = inspect_files(spark, [str(path)])
    assert info.broken and info.header.count("\n") == 299
    row, = read_delimited(spark, [str(path)]).frame.collect()
    assert (row.record_id, row.disaster_type, row.occur_date) == ("R1", "洪涝", "2021-07-01")
    bad = tmp_path / "bad.csv"
    bad.write_text('编号,"灾种\nR1,洪涝\n' + "x\n" * 200, encoding="utf-8")
    with pytest.raises(ValueError, match="never closed"):
        read_delimited(spark, [str(bad)])


def test_line_states():
    assert records.ends_open(b'a,"b', False) and not records.ends_open(b'a,"b"', False) and not records.ends_open(b'5" pipe,x', False)
    assert records.ends_open(b'x ""y""', True) and not records.ends_open(b'x" tail, z', True) and records.ends_open(b'x",y,"z', True)
    assert not records.ends_open(b'"a""",b', False) and records.ends_open(b'"a""', False) and not records.ends_open(b'"c" d "e,f', False)
