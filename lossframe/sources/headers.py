"""Header normalization, the alias table, and schema mapping.

Headers are data here: ``(source, pos, header)`` rows, one per column of
every input file or sheet. Mapping is a join with the alias table (built
from the catalog, so its size is bounded by the catalog) and a window per
(source, target) that keeps the first column claiming a target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import DEFAULT_CATALOG, Catalog
from ..functions.exprs import WHITESPACE

# Bracketed notes in full- or half-width brackets, shortest match.
_NOTE = r"[（(].*?[)）]"


def normalize_header(c: Column | str) -> Column:
    """Drop bracketed notes, every white-space character, ``_`` and
    ``-``; lower-case."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), _NOTE, "")
    return F.lower(F.translate(text, WHITESPACE + "_-", ""))


def alias_entries(catalog: Catalog = DEFAULT_CATALOG) -> list[tuple[str, str]]:
    """S5 candidates in precedence order (later entries win): field name,
    label, label before ``（``; metric name and label; configured aliases."""
    out: list[tuple[str, str]] = []
    for f in catalog.fields:
        out += [(f.name, f.name), (f.label, f.name), (f.label.split("（")[0], f.name)]
    for m in catalog.metrics.values():
        out += [(m.name, m.name), (m.label, m.name)]
    out += list(catalog.aliases.items())
    return out


def alias_table(spark: SparkSession, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """``(norm_key, target)``: one target per normalized key, the last
    configured entry winning; empty keys removed."""
    rows = [(i, k, t) for i, (k, t) in enumerate(alias_entries(catalog))]
    df = spark.createDataFrame(rows, "priority INT, raw_key STRING, target STRING")
    df = df.withColumn("norm_key", normalize_header("raw_key")).where(F.col("norm_key") != "")
    return df.groupBy("norm_key").agg(F.max_by("target", "priority").alias("target"))


def map_columns(headers: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """``(source, pos, header, target, status)``.

    ``status`` is ``matched`` for the first column (by position) mapping to
    a target within a source, ``unmapped`` for later duplicates and unknown
    headers.
    """
    aliases = F.broadcast(alias_table(headers.sparkSession, catalog))  # bounded by the catalog
    h = headers.withColumn("norm_key", normalize_header("header"))
    j = h.join(aliases, "norm_key", "left")
    w = Window.partitionBy("source", "target").orderBy("pos")
    j = j.withColumn("_r", F.when(F.col("target").isNotNull(), F.row_number().over(w)))
    matched = F.col("_r") == 1
    return j.select("source", "pos", "header",
                    F.when(matched, F.col("target")).alias("target"),
                    F.when(matched, F.lit("matched")).otherwise(F.lit("unmapped")).alias("status"))
