"""Session helpers: local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session configured like the tests and bench expect."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName("lossframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # cleaning is CPU-bound per row: keep small local shuffles spread
        # over all cores instead of coalescing them into one or two tasks
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        # and split small files over all cores
        .config("spark.sql.files.openCostInBytes", "256KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOSSFRAME_DRIVER_MEMORY", "16g"))
        .config("spark.sql.legacy.javaCharsets", "true")
        # The cleaning projection is wide (13 metrics x ~10 string functions).
        # A generated method above HotSpot's 8000-byte limit is never JIT
        # compiled and runs interpreted; with this limit Spark falls back to
        # split, JIT-able projections for such a stage (1.5x faster here).
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder;
    we never replace it, and without it we refuse to write to a folder of one
    machine. Only a local session without one (tests) gets a fresh temporary
    folder, removed when the process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local(\[[^-]*\])?$", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = configured or tempfile.mkdtemp(prefix="lossframe-ckpt-")
    if not configured:
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/lossframe-scratch/{name}-{uuid.uuid4().hex[:12]}"


#: HotSpot never compiles a method whose bytecode is longer; such a stage runs interpreted.
_COMPILED_METHOD_BYTES = 8000
#: Most bytes of a file that one task of a wide write reads, and about those of a row group: a written
#: row takes some thirty times as much memory, and a write by partition sorts all rows of its task.
_TASK_BYTES = 16 << 20


@contextmanager
def wide_rows(spark: SparkSession):
    """Jobs run inside split wide projections into methods short enough to be compiled and read
    files in small parts, whatever the session sets."""
    limits = {"spark.sql.codegen.hugeMethodLimit": _COMPILED_METHOD_BYTES, "spark.sql.files.maxPartitionBytes": _TASK_BYTES}
    before = {key: spark.conf.get(key, None) for key in limits}
    for key, most in limits.items():
        if not (before[key] or "").isdigit() or int(before[key]) > most:
            spark.conf.set(key, most)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write a frame of wide rows and read it back."""
    with wide_rows(df.sparkSession):
        df.write.mode("overwrite").option("parquet.block.size", _TASK_BYTES).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df, name: str):
    """Cut lineage with one job: write ``df`` as Parquet under the shared
    checkpoint folder and read it back. (An eager ``checkpoint()`` runs the
    lineage twice: once to count, once more to write.) Survives executor
    loss: downstream stages re-read files, never recompute upstream."""
    return write_parquet(df, scratch_path(df.sparkSession, name))
