"""Records of delimited files whose quoted cells hold line breaks, cut in parallel.

A line of such a file may start inside a quoted cell, and whether it does
depends on all that stands before it. But a block of a file is a function of
that one bit: whether it ends inside a cell, if it starts outside or inside.
So each block finds its function on its own, a running composition over the
blocks of a file (a row for each block) gives every block its start, and then
each block cuts its own records. A record that goes over the end of a block
leaves a piece in each block it touches; those pieces alone are put together.

A quote opens a cell only at its start, a doubled quote stands for a quote, and
what follows a closing quote belongs to the cell up to the next comma, as in
Spark's own reader. Records end at ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_INSIDE = re.compile(rb'(?:[^"]|"")*+')
_OPENS = re.compile(rb'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]|"")*+\Z')
#: A whole record; the first piece of one, that the block's end cuts; a further piece, and a further piece that ends it.
WHOLE, FIRST, NEXT, LAST = range(4)


def ends_open(line: bytes, is_open: bool) -> bool:
    """Whether the line ends inside a quoted cell, given whether it starts inside one."""
    if b'"' not in line:
        return is_open
    at = 0
    if is_open:
        at = _INSIDE.match(line).end()
        if at == len(line):
            return True
        at = line.find(b",", at) + 1
        if not at:
            return False
    return _OPENS.match(line, at) is not None


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, pa.BinaryArray]]:
    """The lines of each block, in order and in runs, with the values of the ``columns``, which are equal in all lines of a block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in columns]
        # a block's lines stand together: a run ends where any key differs from that of the line before
        differs = reduce(pc.or_, [pc.not_equal(k[1:], k[:-1]) for k in keys])
        ends = [*(pc.indices_nonzero(differs).to_numpy() + 1).tolist(), batch.num_rows]
        for at, end in zip([0, *ends], ends):
            yield tuple(k[at].as_py() for k in keys), batch.column("raw")[at:end]


def _blocks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, Iterator[pa.BinaryArray]]]:
    for key, own in groupby(_runs(batches, *columns), key=lambda r: r[0]):
        yield key, (raw for _, raw in own)


def _quoted(raw: pa.BinaryArray) -> list[int]:
    """Where the lines with a quote are; no other line changes whether a cell is open."""
    return pc.indices_nonzero(pc.match_substring(raw, b'"')).to_pylist()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (path, block), runs in _blocks(batches, "path", "block"):
        outside, inside = False, True
        for raw in runs:
            for line in raw.take(pa.array(_quoted(raw), pa.int64())).to_pylist():
                outside, inside = ends_open(line, outside), ends_open(line, inside)
        yield pa.RecordBatch.from_pylist([{"path": path, "block": block, "outside": outside, "inside": inside}])


def open_blocks(lines: DataFrame) -> DataFrame:
    """``(path, block)`` of the blocks that start inside a quoted cell."""
    quoted = F.when(F.col("raw").contains(F.lit(b'"')), F.col("raw")).alias("raw")
    ends = lines.select(quoted, "path", "block").mapInArrow(_ends, "path string, block long, outside boolean, inside boolean")
    # A block whose end does not depend on its start sets the state; one that turns it around flips it; others keep it.
    so_far = Window.partitionBy("path").orderBy("block")
    flip = (F.col("outside") & ~F.col("inside")).cast("int")
    ends = ends.withColumn("flip", flip).withColumn("flips", F.sum("flip").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("set"), F.col("flips").alias("base")))
    ends = ends.withColumn("at", F.last(fixed, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    turned = (F.col("flips") - F.col("flip") - F.coalesce("at.base", F.lit(0))) % 2 == 1
    return ends.where(F.coalesce("at.set", F.lit(False)) != turned).select("path", "block")


_PIECES = pa.schema([("path", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("record", pa.binary())])


def _batch(path: str, block: int, rows: pa.Array, kind: int, records: pa.Array) -> pa.RecordBatch:
    n = len(records)
    return pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.repeat(pa.scalar(block, pa.int64()), n), rows, pa.repeat(pa.scalar(kind, pa.int32()), n), records], schema=_PIECES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (path, block, started), runs in _blocks(batches, "path", "block", "open"):
        held, first, is_open = [], 0, started
        continued = started  # the piece at hand began in an earlier block
        row = 0  # of the run's first line in its block
        for raw in runs:
            raw = raw.cast(pa.binary())
            single = np.ones(len(raw), bool)  # lines that are whole records
            joined: list[tuple[int, bytes]] = []
            last: list[tuple[int, bytes]] = []
            at = 0  # lines before it are dealt with
            for k in _quoted(raw):
                if is_open:
                    held += raw[at:k].to_pylist()
                    single[at:k] = False
                line = raw[k].as_py()
                opened = ends_open(line, is_open)
                if is_open or opened:
                    single[k] = False
                    if not is_open:
                        first = row + k
                    held.append(line)
                    if not opened:
                        (last if continued else joined).append((first, b"\n".join(held)))
                        held, continued = [], False
                is_open, at = opened, k + 1
            if is_open:
                held += raw[at:].to_pylist()
                single[at:] = False
            kept = np.flatnonzero(single)
            if len(kept):
                yield _batch(path, block, pa.array(kept + row, pa.int64()), WHOLE, raw if len(kept) == len(raw) else raw.take(pa.array(kept)))
            for kind, pieces in ((LAST, last), (WHOLE, joined)):
                if pieces:
                    yield _batch(path, block, pa.array([r for r, _ in pieces], pa.int64()), kind, pa.array([x for _, x in pieces], pa.binary()))
            row += len(raw)
        if held:
            yield _batch(path, block, pa.array([first], pa.int64()), NEXT if continued else FIRST, pa.array([b"\n".join(held)], pa.binary()))


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, block, row, record)``: the records of the files as bytes, the header's with block 0 and row 0 among them.

    ``row`` is the number of the record's first line in its block.
    """
    lines = _lines(spark, paths)
    # at most a row for each block that starts inside a cell; Spark's file listing holds one for each block on the driver
    starts = F.broadcast(open_blocks(lines).withColumn("open", F.lit(True)))
    cut = lines.join(starts, ["path", "block"], "left").select("raw", "path", "block", F.coalesce("open", F.lit(False)).alias("open"))
    pieces = cut.mapInArrow(_cut, "path string, block long, row long, kind int, record binary")
    from ..session import materialize

    pieces = materialize(pieces, "delimited-records")
    whole = pieces.where(F.col("kind") == WHOLE).drop("kind")
    # two pieces of a block at most; a record's pieces are in neighbouring blocks
    w = Window.partitionBy("path").orderBy("block", "row")
    begun = F.last(F.when(F.col("kind") == FIRST, F.struct("block", "row")), ignorenulls=True).over(w)
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("begun", begun).groupBy("path", "begun").agg(
        F.array_sort(F.collect_list(F.struct("block", "row", "record"))).alias("parts"))
    joined = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["record"], lambda a, x: F.concat(a, F.lit(b"\n"), x["record"]))
    return whole.unionByName(parts.select("path", F.col("begun.block").alias("block"), F.col("begun.row").alias("row"), joined.alias("record")))
