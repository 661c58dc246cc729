"""File listing through Hadoop's FileSystem (local, HDFS, object stores)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted fully qualified paths matching a glob pattern."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    statuses = fs.globStatus(path) or []
    return sorted(str(s.getPath().toString()) for s in statuses if s.isFile())


def rename(spark: SparkSession, old: str, new: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(old)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path, hadoop.Path(new)):
        raise OSError(f"cannot rename {old}")
