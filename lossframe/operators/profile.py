"""Column profile, overview KPIs, unit-aware sums, filter hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DEFAULT_CATALOG, Catalog
from ..functions import exprs as X


def profile_columns(raw: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """P1 on the raw (text) frame: per column missing count/rate, distinct
    non-null values; for metrics also the numeric parse rate and the max of
    the parsed number before unit conversion.

    One unpivot to ``(field, value)`` and one pass: a two-level aggregate,
    first per ``(field, value)`` (combined map-side, so a value repeated on
    millions of rows leaves each map task as one row), then per field. The
    number is a function of the value, so each distinct value is parsed once,
    after the first level. No per-field set is held in one task.
    """
    cols = [c for c in raw.columns if c != "_seq"]
    metrics = set(catalog.metric_names)
    is_metric = F.col("field").isin(sorted(metrics))
    long = raw.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "field", "value")
    per_value = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("c"))
    per_value = per_value.withColumn("num", F.when(is_metric, X.parse_number("value")))
    out = per_value.groupBy("field").agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("num").isNotNull(), F.col("c"))), F.lit(0)).alias("parsed"), F.max("num").alias("max"), F.count("value").alias("distinct"))
    return out.select(
        "field", F.col("missing").cast("long").alias("missing"),
        F.round(F.col("missing") / F.greatest(F.col("n"), F.lit(1)), 4).alias("missing_rate"),
        F.coalesce(F.col("distinct"), F.lit(0)).cast("long").alias("distinct_values"),
        F.when(is_metric, F.round(F.col("parsed") / F.greatest(F.col("n"), F.lit(1)), 4)).alias("numeric_parse_rate"),
        F.when(is_metric, F.col("max")).alias("max"),
    )


def overview_kpis(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """One row of headline figures (one aggregate), of a cleaned frame or of
    a raw one, whose dates and quantities are then read first (P3). The mean is
    null for no rows; counts of flags that a raw frame lacks are left out."""
    metrics = [m for m in catalog.metric_names if m in clean.columns]
    types = dict(clean.dtypes)
    read = [X.parse_quantity(m, catalog.metric(m).units).alias(m) if types[m] == "string" else F.col(m) for m in metrics]
    date = X.parse_date("occur_date", catalog.rules["date_formats"]).alias("occur_date") if types["occur_date"] == "string" else F.col("occur_date")
    flags = [c for c in ("_imputed_metrics", "_hierarchy_ok") if c in types]
    clean = clean.select("disaster_type", "county", date, *read, *flags)
    n = F.count(F.lit(1))
    aggs = [n.alias("records"), F.count_distinct("disaster_type").alias("event_types"),
            F.count_distinct("county").alias("counties"),
            F.date_format(F.min("occur_date"), "yyyy-MM-dd").alias("period_start"),
            F.date_format(F.max("occur_date"), "yyyy-MM-dd").alias("period_end")]
    aggs += [F.round(F.coalesce(F.sum(m), F.lit(0.0)), 2).alias(f"total_{m}") for m in metrics]
    if "direct_economic_loss" in metrics:
        aggs.append(F.round(F.try_divide(F.coalesce(F.sum("direct_economic_loss"), F.lit(0.0)), n), 2).alias("mean_direct_loss"))
    if "_imputed_metrics" in flags:
        aggs.append(F.count_if(F.col("_imputed_metrics") > 0).alias("imputed_records"))
    if "_hierarchy_ok" in flags:
        aggs.append(F.count_if(~F.col("_hierarchy_ok")).alias("hierarchy_conflicts"))
    return clean.agg(*aggs)


def unit_aware_sum(raw: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Per metric, sum of number × unit factor over the raw text;
    unparsable cells ignored, an absent column gives 0."""
    values = [(X.parse_quantity(m, catalog.metric(m).units) if m in raw.columns else F.lit(None).cast("double")).alias(m)
              for m in catalog.metric_names]
    row = raw.select(*values).agg(*[F.round(F.coalesce(F.sum(m), F.lit(0.0)), 4).alias(m) for m in catalog.metric_names])
    return row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("total")) for m in catalog.metric_names])))


def filter_hints(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG, limit: int = 40) -> DataFrame:
    """P5: ``(dimension, n, values)`` for non-virtual dimensions with 1..limit
    distinct non-null values; values sorted as text, joined by ``|``.

    A sketch of each dimension's distinct values drops the wide ones before any
    value is shuffled: it is all but exact at such counts, and what it lets
    through, up to twice the limit, is counted exactly. Only dimensions within
    the limit collect their (at most ``limit``) values.
    """
    dims = [(name, d.field) for name, d in catalog.dimensions.items()
            if not d.is_virtual and d.field in clean.columns]
    sketch = clean.agg(*[F.approx_count_distinct(f, 0.02).alias(n) for n, f in dims])
    narrow = sketch.select(F.inline(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("about")) for n, _ in dims]))).where(F.col("about") <= 2 * limit)
    pairs = clean.select(*[F.col(f).cast("string").alias(n) for n, f in dims]).unpivot([], [n for n, _ in dims], "dimension", "value")
    pairs = pairs.join(F.broadcast(narrow.select("dimension")), "dimension")  # at most one row per dimension
    distinct = pairs.where(F.col("value").isNotNull()).distinct()
    sizes = distinct.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit)
    small = distinct.join(F.broadcast(sizes), "dimension")  # at most one row per dimension
    return small.groupBy("dimension", "n").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("hint_values"))
