"""Workbook data source: header detection, mapping, pivot to records."""

import zipfile
from xml.sax.saxutils import escape


def _col(i):
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path, sheets):
    """Minimal workbook writer (inline strings) for tests."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        entries = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns} {rns}><sheets>{entries}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
                       for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, (_, rows) in enumerate(sheets):
            body = ""
            for r, row in enumerate(rows):
                cells = "".join(f'<c r="{_col(c)}{r + 1}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
                                for c, v in enumerate(row) if v is not None)
                body += f'<row r="{r + 1}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet {ns}><sheetData>{body}</sheetData></worksheet>')


def test_workbook_source(spark, tmp_path):
    from lossframe.sources.workbook import header_rows, read_rows, read_workbooks
    data = [["编号", "灾种", "发生时间", "县（区）", "直接经济损失（万元）"],
            ["R1", "洪涝", "2021-07-01", "A县", "3.2亿元"],
            ["R2", " 干旱 ", "2021/8/2", "B县", "12"]]
    # the rule looks at the row under a header candidate: one filled cell there
    # means "title-like", and the header moves down
    titled = [["统计表", None, None], ["单位：万元", None, None], ["编号", "灾种", "县"], ["R9", "洪涝", "C县"]]
    plain_title = [["统计表", None, None], ["编号", "灾种", "县"], ["R8", "洪涝", "D县"]]
    notes = [["列名", "说明"], ["灾种", "灾害类型"]]
    p = tmp_path / "book.xlsx"
    write_xlsx(p, [("灾情数据", data), ("字段说明", notes)])
    q = tmp_path / "titles.xlsx"
    write_xlsx(q, [("a", titled), ("b", plain_title)])
    hdr = {r["sheet"]: r["header_row"] for r in header_rows(read_rows(spark, [str(p), str(q)])).collect()}
    assert hdr == {"灾情数据": 0, "字段说明": 0, "a": 1, "b": 0}
    frame, mapping = read_workbooks(spark, [str(p)])
    rows = {r["record_id"]: r for r in frame.collect()}
    assert set(rows) == {"R1", "R2"}
    assert rows["R1"]["direct_economic_loss"] == "3.2亿元" and rows["R2"]["disaster_type"] == " 干旱 "
    assert rows["R1"]["_source_sheet"] == "灾情数据" and rows["R1"]["_seq"] < rows["R2"]["_seq"]
    unmapped = {r["header"] for r in mapping.where("status = 'unmapped'").collect()}
    assert unmapped == {"列名", "说明"}


def test_workbook_write_read_round_trip(spark, tmp_path):
    """Spark-written workbooks (bounded blocks, two layouts, extra sheets)
    read back to the same rows, in input order, with the right header rows."""
    from pyspark.sql import functions as F

    from lossframe.sources.workbook import header_rows, read_rows, read_workbooks, write_workbooks
    rows = [(i, f"R{i}", "洪涝" if i % 2 else " 干旱 ", "2021-07-0" + str(i % 9 + 1), "A县", None if i % 5 == 0 else f"{i}万元")
            for i in range(1, 41)]
    df = spark.createDataFrame(rows, "_seq long, record_id string, disaster_type string, occur_date string, county string, "
                                     "direct_economic_loss string")
    df = df.withColumn("_g", F.when(F.col("_seq") % 3 == 0, "a").otherwise("b")).withColumn("_b", F.floor(F.col("_seq") / 16))
    cols = ["record_id", "disaster_type", "occur_date", "county", "direct_economic_loss"]
    layouts = {"a": (cols, ["编号", "灾种", "发生时间", "县（区）", "直接经济损失（万元）"]),
               "b": (cols, ["record_id", "disaster_type", "occur_date", "county", "direct_economic_loss"])}
    cover = [["统计表"], ["单位：万元"], ["a", "b", "c"]]
    paths = write_workbooks(df, str(tmp_path / "wb"), layouts, "_g", "_b",
                            extra_sheets={"a": [("封面", cover)]}, data_sheet={"a": "灾情数据"})
    assert [p.rsplit("/", 1)[-1] for p in paths] == [f"{g}-{b:012d}.xlsx" for g in "ab" for b in range(3)]
    hdr = {(r["sheet"], r["header_row"]) for r in header_rows(read_rows(spark, paths)).collect()}
    assert hdr == {("灾情数据", 0), ("封面", 1), ("Sheet1", 0)}
    frame, _ = read_workbooks(spark, paths)
    got = frame.orderBy("_seq").select("record_id", "disaster_type", "direct_economic_loss").collect()
    # keep-first order: group a files first, then b; input order inside each
    want = [r for g in (0, 1) for r in rows if (r[0] % 3 == 0) == (g == 0)]
    assert [(r["record_id"], r["disaster_type"], r["direct_economic_loss"]) for r in got] == [(w[1], w[2], w[5]) for w in want]


def test_same_named_books_and_date_cells(spark, tmp_path):
    from lossframe.sources.workbook import read_workbooks, serial_date
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    paths = []
    for n, folder in enumerate("xy"):
        (tmp_path / folder).mkdir()
        p = tmp_path / folder / "book.xlsx"
        write_xlsx(p, [("s", [["编号", "灾种", "发生时间"], [f"R{n}", "洪涝"]])])
        with zipfile.ZipFile(p) as z:
            parts = {i: z.read(i) for i in z.namelist()}
        sheet = "xl/worksheets/sheet1.xml"
        serial = f'<c r="C2" s="{n + 1}"><v>44927.5</v></c>'
        at = parts[sheet].rindex(b"</row>")
        parts[sheet] = parts[sheet][:at] + serial.encode() + parts[sheet][at:]
        parts["xl/styles.xml"] = (f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;年&quot;m"/></numFmts><cellXfs><xf numFmtId="0"/>'
                                  '<xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>').encode()
        with zipfile.ZipFile(p, "w") as z:
            for name, data in parts.items():
                z.writestr(name, data)
        paths.append(str(p))
    frame, _ = read_workbooks(spark, paths)
    assert [(r.record_id, r.occur_date) for r in frame.orderBy("_seq").collect()] == [("R0", "2023-01-01 12:00:00"), ("R1", "2023-01-01 12:00:00")]
    assert serial_date("0", True) == "1904-01-01" and serial_date("x", False) == "x" and serial_date("61", False) == "1900-03-01"


FORMATS = [  # (code, value, what it shows)
    ("#,##0.00;[Red]-#,##0.00", 1234.5, "number"), ("#,##0.00;[Red]-#,##0.00", -3, "number"), ("[Red]0", 5, "number"), ("[Color 12]General", 5, "number"),
    ("#,##0\\d", 7, "number"), ('0.0"days"', 7, "number"), ("0_d", 7, "number"), ("0*y", 7, "number"), ("[$￥-804]#,##0", 7, "number"), ("0.00E+00", 7, "number"),
    ("# ?/?", 7.5, "number"), ("General", 7, "number"), ("@", 7, "number"), ("0%", 7, "number"), ('"yyyy"0', 7, "number"), ("[>=100]0;[<-5]0.0;0.00", 7, "number"),
    ("[$-804]yyyy\\-mm\\-dd", 44927, "date"), ('yyyy"年"m"月"d"日"', 44927, "date"), ("m/d/yy h:mm AM/PM", 44927, "date"), ("[$-F800]dddd, mmmm dd, yyyy", 44927, "date"),
    ("h:mm:ss.0", 0.5, "date"), ("上午/下午h", 0.5, "date"), ("gggee", 44927, "date"), ("0;yyyy", 5, "number"), ("0;yyyy", -5, "date"), ("0;0;d", 0, "date"),
    ("[<40000]0;yyyy", 39999, "number"), ("[<40000]0;yyyy", 44927, "date"), ("[=1]0;[=2]d;0", 2, "date"), ("[=1]0;[=2]d;0", 3, "number"),
    ("[h]:mm", 1.5, "elapsed"), ("[mm]:ss", 1.5, "elapsed"), ("[Red][s]", 1.5, "elapsed"), ("yyyy;[h]:mm", -1.5, "elapsed")]


def test_number_formats():
    from lossframe.sources import number_formats as nf
    for code, value, kind in FORMATS:
        assert nf.shows(code, value) == kind, (code, value)
    assert [nf.shows_built_in(i) for i in (0, 4, 14, 22, 40, 45, 46, 58, 164)] == ["number", "number", "date", "date", "number", "date", "elapsed", "date", "number"]
    assert nf.elapsed_time("1.5") == "36:00:00" and nf.elapsed_time("-0.25") == "-6:00:00" and nf.elapsed_time("x") == "x"
    assert nf.serial_date("0.5", False) == "12:00:00" and nf.serial_date("1", False) == "1900-01-01" and nf.serial_date("1e300", False) == "1e300"
    assert nf.iso_date("2021-07-01T00:00:00") == "2021-07-01" and nf.iso_date("2021-07-01T08:30:00.000Z") == "2021-07-01 08:30:00"


def odd_book(path, sheet, codes, shared="", props=""):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    write_xlsx(path, [("s", [])])
    with zipfile.ZipFile(path) as z:
        parts = {i: z.read(i) for i in z.namelist()}
    own = "".join(f'<numFmt numFmtId="{170 + i}" formatCode="{escape(c, {chr(34): "&quot;"})}"/>' for i, c in enumerate(codes))
    parts["xl/styles.xml"] = f'<styleSheet {ns}><numFmts>{own}</numFmts><cellXfs><xf/>{"".join(f"<xf numFmtId={chr(34)}{170 + i}{chr(34)}/>" for i in range(len(codes)))}</cellXfs></styleSheet>'
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>'
    parts["xl/sharedStrings.xml"] = f"<sst {ns}>{shared}</sst>"
    with zipfile.ZipFile(path, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)


def test_formats_and_kinds_of_cells(tmp_path):
    from lossframe.sources.workbook import iter_rows
    p = str(tmp_path / "odd.xlsx")
    cells = "".join(f'<c s="{i + 1}"><v>{v}</v></c>' for i, (_, v, _) in enumerate(FORMATS))
    odd = ('<row r="5"><c t="b"><v>1</v></c><c t="b"><v>0</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>f</v></c><c t="d"><v>2021-07-01T00:00:00</v></c>'
           '<c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="inlineStr"><is><r><t>a</t></r><r><t> b</t></r></is></c><c s="999"><v>5</v></c></row>')
    shared = "<si><t>东京</t><rPh sb='0' eb='2'><t>トウキョウ</t></rPh></si><si><r><t>x</t></r><r><t>y</t></r></si>"
    odd_book(p, f"<row>{cells}</row>" + odd, [c for c, _, _ in FORMATS], shared)
    got = {row: values for _, _, row, values in iter_rows(p)}
    for (code, value, kind), said in zip(FORMATS, got[0]):
        assert (said == str(value)) == (kind == "number"), (code, said)
        assert kind != "elapsed" or said.count(":") == 2
    assert got[4] == ["True", "False", None, "f", "2021-07-01", "东京", "xy", "a b", "5"]


def test_cells_without_positions(tmp_path):
    from lossframe.sources.workbook import iter_rows
    p = str(tmp_path / "bare.xlsx")
    odd_book(p, '<row><c><v>1</v></c><c/><c><v>3</v></c></row><row/><row><c r="B3"><v>5</v></c><c><v>6</v></c><c r="F3"><v>9</v></c><c><v>10</v></c></row>'
                '<row r="9"><c><v>1</v></c></row><row><c><v>2</v></c></row>', [])
    assert [(row, values) for _, _, row, values in iter_rows(p)] == [
        (0, ["1", None, "3"]), (2, [None, "5", "6", None, None, "9", "10"]), (8, ["1"]), (9, ["2"])]


def test_memory_does_not_grow_with_the_sheet(tmp_path):
    import tracemalloc

    from lossframe.sources.workbook import iter_rows, xlsx_bytes_to
    peaks = []
    for n in (2_000, 40_000):
        p = str(tmp_path / f"{n}.xlsx")
        xlsx_bytes_to(p, [("s", [["a", "1.5", None, "2021-07-01"]] * n)], typed=True, positions=False)
        tracemalloc.start()
        assert sum(values == ["a", "1.5", None, "2021-07-01"] for *_, values in iter_rows(p)) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 3 * peaks[0]
