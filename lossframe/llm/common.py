"""Shared folder, sized joins and table access of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of one long key that a join may broadcast: 16 MB at most.
BROADCAST_ROWS = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``.

    Only a local master may leave that setting unset; the session then gets a
    temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Row groups of scratch tables: a task holds one while it writes, 128 MB by default.
ROW_GROUP_BYTES = 16 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of a narrow written table of ``rows`` rows if it fits; beyond that Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` does that for ASCII texts, and is much faster than ``translate``."""
    up = "".join(map(chr, range(65, 91)))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, up, up.lower())).otherwise(F.lower(text))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id gives 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def slices(parts: Iterator, rows: int = 1000) -> Iterator:
    """Series or frames of at most ``rows`` rows, from batches that Spark ends by bytes and rows."""
    for part in parts:
        for at in range(0, len(part), rows):
            yield part.iloc[at:at + rows].reset_index(drop=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
