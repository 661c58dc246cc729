"""Q1–Q3: data-quality assertions as ``(check, ...)`` frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DEFAULT_CATALOG, Catalog


def dq_row_count(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Q1: rows out > 0 and not more than rows in."""
    a = raw.agg(F.count(F.lit(1)).alias("rows_in")).withColumn("_k", F.lit(1))
    b = clean.agg(F.count(F.lit(1)).alias("rows_out")).withColumn("_k", F.lit(1))
    return a.join(b, "_k").select("rows_in", "rows_out",
                                  ((F.col("rows_out") > 0) & (F.col("rows_out") <= F.col("rows_in"))).alias("passed"))


def dq_totals(results: dict[str, "object"]) -> DataFrame:
    """Q2: per analysis, record count and its smallest total; a negative
    total fails. ``results``: plan key → AnalysisResult."""
    parts = []
    for key, res in results.items():
        tot = res.totals
        vals = [F.col(c) for c in tot.columns]
        low = F.least(*vals) if len(vals) > 1 else (vals[0] if vals else F.lit(None).cast("double"))
        t = tot.select(low.cast("double").alias("min_total")).withColumn("_k", F.lit(1))
        n = res.records.agg(F.count(F.lit(1)).alias("records")).withColumn("_k", F.lit(1))
        parts.append(n.join(t, "_k").select(F.lit(key).alias("plan"), "records", "min_total",
                                           (F.coalesce(F.col("min_total"), F.lit(0.0)) >= 0).alias("passed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dq_metrics(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Q3: cleaned metrics are non-null and non-negative."""
    ms = [m for m in catalog.metric_names if m in clean.columns]
    row = clean.agg(*[F.count_if(F.col(m).isNull()).alias(f"n_{m}") for m in ms],
                    *[F.count_if(F.col(m) < 0).alias(f"g_{m}") for m in ms])
    long = row.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("nulls"), F.col(f"g_{m}").alias("negatives"))
        for m in ms])))
    return long.withColumn("passed", (F.col("nulls") == 0) & (F.col("negatives") == 0))
