"""Scratch tables are written in small row groups; the language trees score in small slabs."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lossframe.llm import language
from lossframe.llm.common import ROW_GROUP_BYTES, written


def test_scratch_tables_have_small_row_groups(spark):
    df = spark.range(60_000, numPartitions=1).select("id", F.concat(*[F.sha2(F.concat("id", F.lit(f" {i}")), 512) for i in range(5)]).alias("text"))  # 38 MB in one task
    path = written(df, "groups").inputFiles()[0].removeprefix("file:")
    files = glob.glob("/" + path.lstrip("/"))
    groups = [pq.ParquetFile(f).metadata.row_group(i).total_byte_size for f in files for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 1 and max(groups) <= 1.5 * ROW_GROUP_BYTES


def test_slabs_bound_what_a_worker_holds():
    assert language._SLAB <= 1 << 18
