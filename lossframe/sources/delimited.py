"""Delimited text files → one standard raw frame + ingest report.

* Charset: a file is UTF-8 if all its lines are valid UTF-8, else GBK; a file
  that is neither fails.
* Cells: doubled quotes stand for a quote, quoted cells may hold line breaks.
  Files in which some line has an odd number of quotes are cut into records by
  ``records``, all others at line ends; both in parallel.
* Header: the first record of each file. Files are identified by their full
  path and read in groups of equal header, charset and cutting; headers are
  mapped once for each distinct layout, and the groups ``unionByName``-ed.
* Input order: ``_seq`` is the struct (path, block start, row id), so "first in
  input order" is exact, without a limit, a join or a scan of its own.

Only one row for each file (path, header, charset) reaches the driver, which
Spark's own file listing already holds there.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import DEFAULT_CATALOG, Catalog
from ..operators.clean import to_standard
from .headers import map_columns
from .records import ends_open, read_records

@dataclass
class FileInfo:
    path: str
    header: str
    charset: str
    broken: bool  # records may go over line ends


def _decoded(raw: bytes, charset: str) -> str:
    return raw.decode(charset).lstrip("\ufeff")


def _odd_quotes(line) -> F.Column:
    # a quote is no part of another character in UTF-8 or GBK, so bytes are counted
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    return F.when(line.contains('"'), quotes % 2 == 1).otherwise(False)


def _file_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("value").cast("binary").alias("raw"), F.is_valid_utf8("value").alias("ok"), _odd_quotes(F.col("value")).alias("odd"),
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("bs"), F.monotonically_increasing_id().alias("id"))


def _file_kinds(lines: DataFrame) -> DataFrame:
    """``(path, header, ok, broken, bad)``: the first line of each file and what kinds of lines it has.

    The kinds are few and gathered as a set; beside a text, the least of each flag would sort all lines.
    """
    start = F.when(F.col("bs") == 0, F.col("id"))
    gbk = F.when(~F.col("ok"), F.decode("raw", "GBK").contains("\ufffd"))  # fails, or marks what GBK cannot read
    kind = F.struct("ok", "odd", F.coalesce(gbk, F.lit(False)).alias("bad"))
    kinds = lines.groupBy("path").agg(F.min_by(F.when(start.isNotNull(), F.col("raw")), start).alias("header"), F.collect_set(kind).alias("kinds"))
    return kinds.select("path", "header", F.forall("kinds", lambda k: k["ok"]).alias("ok"), F.exists("kinds", lambda k: k["odd"]).alias("broken"),
                        F.exists("kinds", lambda k: k["bad"]).alias("bad"))


def inspect_files(spark: SparkSession, paths: list[str]) -> list[FileInfo]:
    """Header, charset and cutting of each file, from one aggregate over the lines."""
    lines = _file_lines(spark, paths)
    found = _file_kinds(lines).orderBy("path").collect()
    if bad := [r["path"] for r in found if r["bad"]]:
        raise ValueError(f"neither UTF-8 nor GBK: {bad[0]}")
    out = []
    for r in found:
        charset = "UTF-8" if r["ok"] else "GBK"
        header = _decoded(bytes(r["header"] or b""), charset)
        if ends_open(bytes(r["header"] or b""), False):
            header = _decoded(_long_header(lines, r["path"]), charset)
        out.append(FileInfo(r["path"], header.rstrip("\r\n"), charset, bool(r["broken"])))
    return out


def _long_header(lines: DataFrame, path: str) -> bytes:
    """The first record of a file whose first line ends inside a quoted cell, read on until that cell closes."""
    own = lines.where((F.col("path") == path)).orderBy("bs", "id").select("raw")
    most = 64
    while True:
        got, is_open = b"", False
        rows = own.limit(most).collect()
        for line in rows:
            got += bytes(line["raw"]) + b"\n"
            is_open = ends_open(bytes(line["raw"]), is_open)
            if not is_open:
                return got
        if len(rows) < most:
            raise ValueError(f"a quote in the header is never closed: {path}")
        most *= 8


def split_header(record: str) -> list[str]:
    return next(csv.reader([record] if "\n" not in record else record.splitlines(keepends=True)), []) if record else []


def headers_frame(spark: SparkSession, layouts: list[str]) -> DataFrame:
    """``(source, pos, header)`` for every column of every distinct layout; ``source`` is its number."""
    rows = [(str(n), i, h) for n, layout in enumerate(layouts) for i, h in enumerate(split_header(layout))]
    return spark.createDataFrame(rows, "source STRING, pos INT, header STRING")


def input_order(*first) -> F.Column:
    """Position in the input: what comes first, then file, block and row."""
    return F.struct(*first, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


@dataclass
class IngestResult:
    frame: DataFrame        # standard raw shape; ``_seq`` is the struct of ``input_order``
    columns: DataFrame      # (source, pos, header, target, status), one source for each distinct layout
    files: list[FileInfo]
    empty_sources: list[str]  # paths without any known column
    unknown: DataFrame      # their records, a row for each


_CELLS = {"quote": '"', "escape": '"'}


def _line_cells(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """``(cells, path, _seq)`` of files whose records end at line ends."""
    df = spark.read.options(**_CELLS, header=True, encoding=charset, inferSchema=False).csv(paths)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("cells"), F.col("_metadata.file_name").alias("path"), input_order().alias("_seq"))


def _broken_cells(spark: SparkSession, paths: list[str], charset: str, width: int) -> DataFrame:
    """``(cells, path, _seq)`` of files with line breaks in quoted cells."""
    rows = read_records(spark, paths).where("NOT (block = 0 AND row = 0)")
    text = F.decode("record", charset)
    # where lines end in \r\n, so do those inside cells, which Spark's reader makes \n
    text = F.when(text.endswith("\r"), F.regexp_replace(F.regexp_replace(text, r"\r\z", ""), "\r\n", "\n")).otherwise(text)
    cells = F.from_csv(text, ", ".join(f"c{i} string" for i in range(width)), {**_CELLS, "multiLine": "true"})
    return rows.where(F.length(F.btrim(text)) > 0).select(cells.alias("cells"), "path", F.struct("path", "block", "row").alias("_seq"))


def read_delimited(spark: SparkSession, paths: list[str], catalog: Catalog = DEFAULT_CATALOG) -> IngestResult:
    """S1 + S6 + S7: read every file, map headers, union in standard shape."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # GBK is none of Spark's own charsets
    files = inspect_files(spark, paths)
    layouts = list(dict.fromkeys(f.header for f in files))
    mapping = map_columns(headers_frame(spark, layouts), catalog)
    targets: dict[str, dict[int, str]] = {}
    for r in mapping.where(F.col("status") == "matched").collect():  # one row for each column of a layout
        targets.setdefault(layouts[int(r["source"])], {})[r["pos"]] = r["target"]
    groups: dict[tuple[str, str, bool], list[str]] = {}
    for f in files:
        groups.setdefault((f.header, f.charset, f.broken), []).append(f.path)
    frames, empty, unknown = [], [], spark.createDataFrame([], "path string")
    for (header, charset, broken), group in groups.items():
        df = _broken_cells(spark, group, charset, len(split_header(header))) if broken else _line_cells(spark, group, charset)
        if header not in targets:
            empty += group
            unknown = unknown.unionByName(df.select("path"))
            continue
        df = df.select(*[F.col(f"cells.`{df.schema['cells'].dataType.names[i]}`").alias(t) for i, t in sorted(targets[header].items()) if i < len(df.schema["cells"].dataType)],
                       "_seq", F.substring_index("path", "/", -1).alias("_source_file"))
        stem = F.col("_source_file").substr(F.lit(1), F.length("_source_file") - F.length(F.substring_index("_source_file", ".", -1)) - 1)
        df = df.withColumn("_source_sheet", F.when(F.col("_source_file").contains("."), stem).otherwise(F.col("_source_file")))
        frames.append(to_standard(df, catalog, seq_col="_seq"))
    if not frames:
        frames = [spark.createDataFrame([], catalog.raw_schema())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return IngestResult(out, mapping, files, empty, unknown)


def _report_parts(result: IngestResult, catalog: Catalog) -> DataFrame:
    cols = result.columns
    # distinct targets matched and distinct unmapped header names, over all layouts
    unmapped = F.when(F.col("status") == "unmapped", F.col("header"))
    counts = cols.agg(F.count_distinct(F.when(F.col("status") == "matched", F.col("target"))).alias("matched"),
                      F.count_distinct(unmapped).alias("unmapped"), F.array_sort(F.collect_set(unmapped)).alias("unmapped_headers"))
    present = result.frame.agg(F.count(F.lit(1)).alias("rows_out"), *[F.count(c).alias(c) for c in catalog.required_fields])
    missing = F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in catalog.required_fields]))
    unread = result.unknown.agg(F.count(F.lit(1)).alias("unknown")).withColumn("_k", F.lit(1))
    return counts.withColumn("_k", F.lit(1)).join(
        present.select("rows_out", missing.alias("missing_required")).withColumn("_k", F.lit(1)), "_k").join(unread, "_k").withColumn(
        "rows_read", F.col("rows_out") + F.col("unknown"))


def ingest_report(result: IngestResult, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """One-row template comparison: rows read (those of sources without any
    known column too) and rows out, matched / unmapped column counts, matched rate, required fields missing or all-null in the union."""
    return _report_parts(result, catalog).select(
        "rows_read", "rows_out", "matched", "unmapped",
        F.round(F.col("matched") / F.greatest(F.col("matched") + F.col("unmapped"), F.lit(1)), 4).alias("matched_rate"),
        F.array_join("missing_required", ",").alias("missing_required"))


def ingest_issues(result: IngestResult, catalog: Catalog = DEFAULT_CATALOG, samples: int = 10) -> DataFrame:
    """``(level, code, count, samples)``: sources without any known column,
    required fields missing, unknown columns (first ``samples`` in name order)."""
    parts = _report_parts(result, catalog)
    empty = result.columns.sparkSession.createDataFrame([(len(result.empty_sources),)], "n int")
    row = lambda level, code, n, said: F.struct(
        F.lit(level).alias("level"), F.lit(code).alias("code"), n.cast("long").alias("count"), said.alias("samples"))
    issues = F.array(row("error", "SHEET_EMPTY", F.col("n"), F.lit("")),
                     row("error", "MISSING_REQUIRED_FIELD", F.size("missing_required"), F.array_join("missing_required", ",")),
                     row("warning", "UNMAPPED_COLUMN", F.col("unmapped"), F.array_join(F.slice("unmapped_headers", 1, samples), ",")))
    return parts.join(empty.withColumn("_k", F.lit(1)), "_k").select(F.inline(issues)).where(F.col("count") > 0)
