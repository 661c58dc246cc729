"""C22 audit log and issues, from per-row change flags in one aggregate.

The source pipeline recounts after every step; here each step leaves a
boolean flag on the row and a single global aggregate counts them all
(plus the raw and output row counts), unpivoted to one row per step.
Steps with nothing affected are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

from .clean import CleanResult


def _cnt(cond: Column) -> Column:
    return F.count_if(cond)


def cleaning_audit(result: CleanResult) -> DataFrame:
    """``(step_no, step, field, action, affected, detail)``."""
    cat = result.catalog
    ann = result.annotated
    kept = F.col("_kept")
    metrics = cat.metric_names
    text = [f for f in cat.text_fields if f"_chg_{f}" in ann.columns]
    aggs = [F.count(F.lit(1)).alias("nonempty"), _cnt(~kept).alias("region_dropped"),
            _cnt(kept).alias("kept"), _cnt(kept & F.col("_fill_type")).alias("type_filled"),
            F.count("occur_date").alias("dates"), _cnt(F.col("_date_raw")).alias("dates_raw"),
            _cnt(kept & ~F.col("_hierarchy_ok")).alias("conflicts")]
    aggs += [_cnt(F.col(f"_chg_{f}")).alias(f"chg_{f}") for f in text]
    for m in metrics:
        aggs += [_cnt(F.col(f"_conv_{m}")).alias(f"conv_{m}"), _cnt(F.col(f"_fill_{m}")).alias(f"fill_{m}"),
                 _cnt(kept & F.col(f"_cap_{m}")).alias(f"cap_{m}"),
                 _cnt(kept & (F.col(f"_low_{m}") | F.col(f"_high_{m}"))).alias(f"bound_{m}")]
    counts = ann.agg(*aggs)
    rows_in = result.raw.agg(F.count(F.lit(1)).alias("rows_in"))
    rows_out = result.frame.agg(F.count(F.lit(1)).alias("rows_out"))
    joined = counts.withColumn("_k", F.lit(1)).join(rows_in.withColumn("_k", F.lit(1)), "_k") \
        .join(rows_out.withColumn("_k", F.lit(1)), "_k")

    def names_hit(prefix: str, names: list[str]) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{prefix}_{n}") > 0, F.lit(n)) for n in names])), ",")

    entries: list[Column] = []

    def add(no: int, step: str, field: Column | str, action: str, affected: Column, detail: Column | str = "", sub: int = 0):
        entries.append(F.struct(
            F.lit(no).alias("step_no"), F.lit(sub).alias("sub"), F.lit(step).alias("step"),
            (F.lit(field) if isinstance(field, str) else field).alias("field"),
            F.lit(action).alias("action"), affected.cast("long").alias("affected"),
            (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))

    add(1, "drop_empty_rows", "*", "drop rows with every data cell empty", F.col("rows_in") - F.col("nonempty"))
    add(2, "normalize_text", names_hit("chg", text), "remove white space, missing tokens to null",
        sum((F.col(f"chg_{f}") for f in text), F.lit(0)))
    add(3, "parse_dates", "occur_date", "parse with the configured formats", F.col("dates"),
        F.concat(F.lit("failed "), F.greatest(F.col("dates_raw") - F.col("dates"), F.lit(0)).cast("string")))
    add(4, "calendar_parts", "year/quarter/month/day", "derive calendar parts", F.col("dates"))
    for i, m in enumerate(metrics):
        add(5, "convert_units", m, "convert to the standard unit", F.col(f"conv_{m}"), sub=i)
    add(6, "fill_zero", names_hit("fill", metrics), "fill missing metrics with 0, counted in _imputed_metrics",
        sum((F.col(f"fill_{m}") for m in metrics), F.lit(0)))
    add(7, "drop_missing_region", ",".join(cat.required_region_fields), "drop rows without required region",
        F.col("region_dropped"))
    add(8, "fill_category", "disaster_type", "missing event type to the other category", F.col("type_filled"))
    for i, m in enumerate(metrics):
        add(9, "iqr_cap", m, "cap above Q3 + k*IQR per event type", F.col(f"cap_{m}"), sub=i)
    add(10, "clamp_bounds", "all metrics", "clamp to business bounds",
        sum((F.col(f"bound_{m}") for m in metrics), F.lit(0)))
    add(11, "hierarchy_check", "province/city/county codes", "code prefix and reference name check",
        F.col("conflicts"))
    add(12, "derive_dimensions", "season/per_capita_level", "derive custom dimensions", F.col("kept"))
    add(13, "dedupe_keep_first", ",".join(cat.rules.get("dedupe_on", [])), "keep the first row per business key",
        F.col("kept") - F.col("rows_out"))
    out = joined.select(F.inline(F.array(*entries)))
    return out.where(F.col("affected") > 0)


# Sample texts of a code that does not begin like its parent's, and of a name that the reference has otherwise.
PREFIX_SAMPLE = "%s(%s) 与上级 %s 前缀不符"
NAME_SAMPLE = "%s/%s 参照表记录为 %s"


def hierarchy_issue(result: CleanResult, samples: int = 8, each: int = 5) -> DataFrame:
    """C18 issue row: ``(level, code, count, samples)``.

    Samples name the parent code or the expected name: the first ``each`` rows in
    input order whose code differs from the province's, then from the city's,
    then rows whose name differs, ``samples`` in all (bounded top-k, never a
    collect of all conflicts).
    """
    rows = result.annotated.where(F.col("_kept"))
    bad = rows.where(~F.col("_hierarchy_ok"))
    county, code = F.coalesce("county", F.lit("")), F.col("county_code")
    kinds = []
    for parent, width in (("province_code", 2), ("city_code", 4)):
        up = X.normalize_code(parent)
        differs = F.substring(code, 1, width) != F.substring(up, 1, width)
        kinds.append((differs, F.format_string(PREFIX_SAMPLE, county, code, up), each))
    kinds.append((F.col("_name_bad"), F.format_string(NAME_SAMPLE, county, code, F.col("_ref_name")), samples))
    found = None
    for kind, (when, said, most) in enumerate(kinds):
        first = bad.where(when).select(F.lit(kind).alias("kind"), "_seq", said.alias("s")).orderBy("_seq").limit(most)
        found = first if found is None else found.unionByName(first)
    listed = F.slice(F.array_sort(F.collect_list(F.struct("kind", "_seq", "s"))), 1, samples)  # of 18 at most
    first = found.agg(F.array_join(F.transform(listed, lambda x: x["s"]), "; ").alias("samples"))
    count = bad.agg(F.count(F.lit(1)).alias("count"))
    out = count.withColumn("_k", F.lit(1)).join(first.withColumn("_k", F.lit(1)), "_k")
    return out.where(F.col("count") > 0).select(
        F.lit("warning").alias("level"), F.lit("HIERARCHY_CONFLICT").alias("code"), "count", "samples")


def cleaning_issues(result: CleanResult) -> DataFrame:
    """Issues: unparsable dates and hierarchy conflicts."""
    ann = result.annotated
    dates = ann.agg((F.count_if(F.col("_date_raw")) - F.count("occur_date")).alias("count")).where(F.col("count") > 0)
    dates = dates.select(F.lit("warning").alias("level"), F.lit("DATE_PARSE_FAILED").alias("code"),
                         "count", F.lit("").alias("samples"))
    return dates.unionByName(hierarchy_issue(result))
