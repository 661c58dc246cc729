"""Spreadsheet workbooks (.xlsx / .xlsm) as a Spark data source.

Spark has no built-in workbook reader, so ``WorkbookDataSource`` is a Python
Data Source: one input partition per workbook, each task unzips its file with
the standard library and emits a row for each sheet row,
``(file, sheet, sheet_idx, row_idx, values)``. Everything after that (header
detection, header mapping, the choice of columns) is DataFrame work: small
aggregates for each sheet, and one projection of the rows, which are never
shuffled.

Cells are read as text: shared and inline strings without their phonetic hints,
numbers as stored, numbers shown as dates as ISO dates (both epochs), elapsed
times as hours, truth values as True and False; errors count as missing. What a
number shows depends on its format (``number_formats``). Rows and cells may
leave out their positions, and then follow the one before. A sheet is parsed
row by row and nothing of it stays, so memory does not grow with it. Workbooks
are identified by their full path.
"""

from __future__ import annotations

import io
import re
import zipfile
from functools import lru_cache
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalog import DEFAULT_CATALOG, Catalog
from ..operators.clean import to_standard
from ..session import materialize
from . import number_formats as formats
from .headers import map_columns
from .number_formats import serial_date as serial_date

ROW_SCHEMA = "file string, sheet string, sheet_idx int, row_idx int, values array<string>"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_REF = re.compile(r"\$?([A-Z]+)\$?(\d+)")
_C, _V, _IS, _T, _R, _SI, _ROW, _DATA = (f"{{{_NS['m']}}}{t}" for t in ("c", "v", "is", "t", "r", "si", "row", "sheetData"))
_BATCH_CELLS = 65_536


def _filesystem(path: str):
    """``(filesystem, path)`` for a local path or any URI pyarrow knows
    (``file:``, ``hdfs://``, ``s3://``, ...), so tasks read and write the
    shared folder, not a machine-local one."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@lru_cache(20_000)  # a sheet has 16,384 columns at most
def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(node) -> str:
    """Text of a string item: its own and that of its runs, not its phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag in (_T, _R) for t in ([part] if part.tag == _T else part.iter(_T)))


def _shown_by(z: zipfile.ZipFile):
    """Function (style number, number as text) -> the text it is read as."""
    codes: list[str | int] = []
    if "xl/styles.xml" in z.namelist():
        root = ET.fromstring(z.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.findall("m:numFmts/m:numFmt", _NS)}
        codes = [own.get(n, n) for n in (int(x.get("numFmtId", 0)) for x in root.findall("m:cellXfs/m:xf", _NS))]

    def shown(style: int, value: str, since_1904: bool) -> str:
        code = codes[style] if style < len(codes) else 0
        if code == 0:
            return value
        try:
            kind = formats.shows_built_in(code) if isinstance(code, int) else formats.shows(code, float(value))
        except ValueError:
            return value
        return formats.serial_date(value, since_1904) if kind == formats.DATE else formats.elapsed_time(value) if kind == formats.ELAPSED else value

    return shown


def _cell_text(node, shared: list[str], shown, since_1904: bool) -> str | None:
    kind, value = node.get("t", "n"), None
    for child in node:
        if child.tag == _IS and kind == "inlineStr":
            value = _text(child)
        elif child.tag == _V:
            value = child.text
    if not value or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)] or None
    if kind == "n":
        return shown(int(node.get("s", 0)), value, since_1904)
    return {"b": lambda v: "True" if v == "1" else "False", "d": formats.iso_date}.get(kind, str)(value)


def iter_rows(path: str):
    """Yield ``(sheet, sheet_idx, row_idx, values)`` for rows with at least one filled cell."""
    fs, p = _filesystem(path)
    with fs.open_input_file(p) as f, zipfile.ZipFile(f) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                root = None
                for event, si in ET.iterparse(part, ("start", "end")):
                    root = si if root is None else root
                    if event == "end" and si.tag == _SI:
                        shared.append(_text(si))
                        root.clear()
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target") for r in rels}
        props = wb.find("m:workbookPr", _NS)
        since_1904 = props is not None and props.get("date1904") in ("1", "true")
        shown = _shown_by(z)
        for sheet_idx, sh in enumerate(wb.find("m:sheets", _NS)):
            target = targets[sh.get(_REL)].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as part:
                for row_idx, values in _sheet_rows(part, lambda c: _cell_text(c, shared, shown, since_1904)):
                    yield sh.get("name"), sheet_idx, row_idx, values


def _sheet_rows(part, text):
    """(row index, values) of each filled row; rows and cells without a position follow the one before."""
    data, at, column, values = None, -1, -1, []
    for event, node in ET.iterparse(part, ("start", "end")):
        if event == "start":
            if node.tag == _DATA:
                data = node
            elif node.tag == _ROW:
                at = int(node.get("r")) - 1 if node.get("r") else at + 1
                column, values = -1, []
        elif node.tag == _C and data is not None:
            m = _REF.fullmatch(node.get("r", ""))
            column = _col_index(m.group(1)) if m else column + 1
            value = text(node)
            if value is not None:
                values += [None] * (column + 1 - len(values))
                values[column] = value
        elif node.tag == _ROW and data is not None:
            data.clear()
            if values:
                yield at, values


class WorkbookDataSource(DataSource):
    """``spark.read.format("workbook").option("paths", "p1\\np2").load()``."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return ROW_SCHEMA

    def reader(self, schema):
        return _WorkbookReader(self.options)


class _WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split("\n") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        """Arrow record batches of rows (no per-row conversion in Spark)."""
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("sheet_idx", pa.int32()),
                            ("row_idx", pa.int32()), ("values", pa.list_(pa.string()))])
        rows, cells = [], 0

        def batch():
            columns = [[partition.value] * len(rows), *map(list, zip(*rows))]
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(columns, schema)], schema=schema)

        for row in iter_rows(partition.value):
            rows.append(row)
            cells += len(row[-1])
            if cells >= _BATCH_CELLS:
                yield batch()
                rows, cells = [], 0
        if rows:
            yield batch()


def read_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, sheet, sheet_idx, row_idx, values)``, a row for each filled sheet row."""
    for p in paths:
        if not p.lower().endswith((".xlsx", ".xlsm")):
            raise ValueError(f"unsupported workbook type: {p}")
    spark.dataSource.register(WorkbookDataSource)
    return spark.read.format("workbook").option("paths", "\n".join(paths)).load()


def read_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, sheet, sheet_idx, row_idx, col_idx, value)`` of the filled cells."""
    rows = read_rows(spark, paths)
    return rows.select("file", "sheet", "sheet_idx", "row_idx", F.posexplode("values").alias("col_idx", "value")).where("value IS NOT NULL")


def header_rows(rows: DataFrame) -> DataFrame:
    """S3: ``(file, sheet, header_row)``.

    A header candidate "looks like a title" when the sheet has at least 3
    columns and the row right under the candidate holds exactly one filled
    cell. Row 0 is kept unless it looks like that; then rows 1, 2, 3 are
    tried in order and the first that does not is the header, else row 0.
    One aggregate, combined before its shuffle of a row for each sheet and task.
    """
    filled = F.size(F.array_compact("values"))
    s = rows.groupBy("file", "sheet").agg(
        F.max(F.size("values")).alias("ncols"), F.max("row_idx").alias("last_row"),
        *[F.max(F.when(F.col("row_idx") == i, filled)).alias(str(i)) for i in range(1, 5)])

    def titled(h: int):
        return (F.col("ncols") >= 3) & (F.col("last_row") > h) & (F.coalesce(F.col(str(h + 1)), F.lit(0)) == 1)

    pick = F.when(~titled(0), 0)
    for h in (1, 2, 3):
        pick = pick.when(~titled(h), h)
    return s.select("file", "sheet", pick.otherwise(0).alias("header_row"))


def read_workbooks(spark: SparkSession, paths: list[str], catalog: Catalog = DEFAULT_CATALOG):
    """S2 + S3 + S6 + S7: workbooks → standard raw frame and column mapping.

    The sheet rows are written once (Python parses each workbook once). From
    them come the header rows and the layout of each sheet, a row for each
    sheet; the records are one projection of the written rows.
    """
    rows = materialize(read_rows(spark, paths), "workbook-rows")
    source = F.concat_ws("#", "file", "sheet").alias("source")
    heads = header_rows(rows)
    at_head = rows.where("row_idx <= 3").join(heads.withColumnRenamed("header_row", "row_idx"), ["file", "sheet", "row_idx"])
    headers = at_head.select(source, F.posexplode("values").alias("pos", "header")).where("header IS NOT NULL")
    mapping = materialize(map_columns(headers, catalog), "workbook-layouts")  # a row for each column of a sheet
    places = mapping.where(F.col("status") == "matched").groupBy("source").agg(
        *[F.max(F.when(F.col("target") == t, F.col("pos"))).alias(f"_{t}") for t in catalog.standard_columns])
    sheets = heads.select("file", "sheet", "header_row", source).join(places, "source").drop("source")
    records = rows.join(sheets, ["file", "sheet"]).where(F.col("row_idx") > F.col("header_row")).select(
        F.struct("file", "sheet_idx", "row_idx").alias("_seq"), F.element_at(F.split("file", "/"), -1).alias("_source_file"),
        F.col("sheet").alias("_source_sheet"), *[F.get("values", F.col(f"_{t}")).alias(t) for t in catalog.standard_columns])
    records = records.where(F.coalesce(*catalog.standard_columns).isNotNull())
    return to_standard(records, catalog, seq_col="_seq"), mapping


# ------------------------------------------------------------- writing ----
# Workbooks are written by Spark tasks: rows are cut into bounded blocks,
# every block becomes one workbook written by one task under a name fixed by
# its content (group + block), so a retried task overwrites the same file.

_SHEET_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R_NS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


@lru_cache(20_000)
def _col_letters(i: int) -> str:
    s, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


#: Styles of typed cells: text, amounts, dates.
_FORMATS = ["General", "#,##0.00;[Red]-#,##0.00", "[$-804]yyyy\\-mm\\-dd"]
_AMOUNT, _DAY = re.compile(r"-?(?:0|[1-9][0-9]{0,13})(?:\.[0-9]{1,6})?"), re.compile(r"(19[1-9][0-9]|20[0-9]{2})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])")


def _typed(v: str) -> str | None:
    """Style and value of a cell that holds an amount or a day; None for other text."""
    if _AMOUNT.fullmatch(v):
        return f' s="1"><v>{v}</v></c>'
    if m := _DAY.fullmatch(v):
        import datetime as dt
        try:
            return f' s="2"><v>{(dt.date(*map(int, m.groups())) - dt.date(1899, 12, 30)).days}</v></c>'
        except ValueError:
            return None
    return None


def xlsx_bytes_to(target, sheets: list[tuple[str, list[list[str | None]]]], typed: bool = False, positions: bool = True) -> None:
    """Write a minimal workbook: inline strings, empty cells left out.

    With ``typed``, amounts and days are numbers with a format. Without ``positions``, rows and cells
    don't say where they stand, and empty cells are written.
    """
    from xml.sax.saxutils import escape

    def attr(v: str) -> str:
        return escape(v, {'"': "&quot;"})

    def cell(r: int, c: int, v: str | None) -> str:
        at = f' r="{_col_letters(c)}{r + 1}"' if positions else ""
        if v is None or v == "":
            return "" if positions else "<c/>"
        return f"<c{at}" + (typed and _typed(v) or f' t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')

    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        entries = "".join(f'<sheet name="{attr(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {_SHEET_NS} {_R_NS}><sheets>{entries}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
                       for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   f"{rels}</Relationships>")
        own = "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{attr(code)}"/>' for i, code in enumerate(_FORMATS) if i)
        styles = "".join(f'<xf numFmtId="{164 + i if i else 0}"/>' for i in range(len(_FORMATS)))
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet {_SHEET_NS}><numFmts>{own}</numFmts><cellXfs>{styles}</cellXfs></styleSheet>')
        for i, (_, rows) in enumerate(sheets):
            parts = [f'<?xml version="1.0"?><worksheet {_SHEET_NS}><sheetData>']
            for r, row in enumerate(rows):
                cells = "".join(cell(r, c, v) for c, v in enumerate(row))
                parts.append(f'<row r="{r + 1}">{cells}</row>' if positions else f"<row>{cells}</row>")
            parts.append("</sheetData></worksheet>")
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", "".join(parts))


def write_workbooks(df: DataFrame, path: str, layouts: dict[str, tuple[list[str], list[str]]],
                    group_col: str, block_col: str, order_col: str = "_seq",
                    extra_sheets: dict[str, list[tuple[str, list[list[str | None]]]]] | None = None,
                    data_sheet: dict[str, str] | None = None, typed: bool = False, bare: tuple[str, ...] = ()) -> list[str]:
    """Write ``df`` as workbooks, one per ``(group, block)``; returns the paths.

    ``layouts[group] = (columns, headers)``: which columns go to the data
    sheet, under which header texts. ``extra_sheets[group]`` are added after
    the data sheet. Rows keep ``order_col`` order inside a workbook, and file
    names sort like ``(group, block)``. The caller bounds a block's size. With
    ``typed``, amounts and days are numbers; groups of ``bare`` leave out positions.
    """
    extra_sheets = extra_sheets or {}
    data_sheet = data_sheet or {}
    base = path.rstrip("/")
    cols = sorted({c for cs, _ in layouts.values() for c in cs})
    work = (df.select(F.col(group_col).cast("string").alias("_g"), F.col(block_col).cast("long").alias("_b"),
                      F.col(order_col).alias("_o"), *cols)
            .repartition("_g", "_b").sortWithinPartitions("_g", "_b", "_o"))

    def write_part(batches):
        import pandas as pd

        from pyspark import TaskContext

        ctx = TaskContext.get()
        attempt = f"{ctx.partitionId()}-{ctx.attemptNumber()}-{ctx.taskAttemptId()}" if ctx else "local"
        fs, root = _filesystem(base)
        fs.create_dir(f"{root}/_attempts", recursive=True)
        out: list[str] = []

        def flush(key, parts):
            g, b = key
            block = pd.concat(parts)
            columns, headers = layouts[g]
            body = block[columns].astype(object)
            rows = [list(headers)] + body.where(body.notna(), None).values.tolist()
            name = f"{g}-{b:012d}.xlsx"
            buf = io.BytesIO()
            xlsx_bytes_to(buf, [(data_sheet.get(g, "Sheet1"), rows)] + list(extra_sheets.get(g, [])), typed, g not in bare)
            # write under an attempt-specific name, then move into place: a
            # retried or speculative attempt never exposes a partial file
            tmp = f"{root}/_attempts/{name}.{attempt}"
            with fs.open_output_stream(tmp) as f:
                f.write(buf.getvalue())
            fs.move(tmp, f"{root}/{name}")
            out.append(f"{base}/{name}")

        # rows arrive sorted by (group, block, order): hold one block at a time
        key, parts = None, []
        for pdf in batches:
            for (g, b), part in pdf.groupby(["_g", "_b"], sort=False):
                k = (g, int(b))
                if k != key and parts:
                    flush(key, parts)
                    parts = []
                key = k
                parts.append(part)
        if parts:
            flush(key, parts)
        yield pd.DataFrame({"path": out})

    written = work.mapInPandas(write_part, "path string")
    # one row per workbook comes back to the driver (the file list)
    return sorted(r["path"] for r in written.collect())
