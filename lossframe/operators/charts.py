"""V1–V6: chart-ready frames and geo matching (data only, no drawing).

Geo matching reads all groups, not a plan's first rows: a county beyond the
plan's limit has data. Joins carry no hints; Spark picks them by size. The
windows left run over category groups (years, types, levels), whose number
the dimensions bound, not the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import AMOUNT_UNIT, DEFAULT_CATALOG, Catalog
from ..operators.analyze import AnalysisResult, order_columns


def _with_pos(result: AnalysisResult, catalog: Catalog) -> DataFrame:
    """Records with their 1-based position in the result order."""
    req = result.request
    fields = [catalog.dimension(d).field for d in req.dimensions]
    keys = order_columns(req, catalog, fields, list(req.metrics))
    return result.records.withColumn("pos", F.row_number().over(Window.orderBy(*keys)))


def _numeric(c):
    """Null / NaN / non-numeric → 0.0."""
    v = F.col(c).try_cast("double") if isinstance(c, str) else c
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def chart_series(result: AnalysisResult, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """V2: one-dimension series ``(pos, category, value)``, first metric."""
    d0 = catalog.dimension(result.request.dimensions[0]).field
    m0 = result.request.metrics[0]
    return _with_pos(result, catalog).select("pos", F.col(d0).cast("string").alias("category"),
                                              _numeric(m0).alias("value"))


def chart_pivot(result: AnalysisResult, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """V1: categories × series grid in first-seen order, absent cells 0.0.

    ``pivot`` needs the series values: the distinct values of one category
    dimension.
    """
    d0, d1 = (catalog.dimension(d).field for d in result.request.dimensions[:2])
    m0 = result.request.metrics[0]
    recs = _with_pos(result, catalog).withColumn("_series", F.coalesce(F.col(d1).cast("string"), F.lit("None")))
    series = [r[0] for r in recs.groupBy("_series").agg(F.min("pos").alias("p")).orderBy("p").select("_series").collect()]
    cats = recs.groupBy(d0).agg(F.min("pos").alias("cat_pos"))
    wide = recs.groupBy(d0).pivot("_series", series).agg(F.first(_numeric(m0)))
    wide = wide.join(cats, d0)
    entries = [F.struct(F.lit(i + 1).alias("ser_pos"), F.lit(s).alias("series"),
                        F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias("value"))
               for i, s in enumerate(series)]
    return wide.select(F.col("cat_pos").cast("int").alias("cat_pos"), F.col(d0).cast("string").alias("category"),
                       F.inline(F.array(*entries)))


def chart_share(result: AnalysisResult) -> DataFrame:
    """V3: loss-structure slices in the amount unit, percent of the slices."""
    rows = result.records.where(F.col("unit") == AMOUNT_UNIT)
    total = F.sum("value").over(Window.partitionBy())
    return rows.select("pos", "loss_type", _numeric("value").alias("value"),
                       F.round(F.col("value") / F.when(total != 0, total) * 100, 2).alias("pct"))


def geo_dim(features: DataFrame) -> DataFrame:
    """One row per feature name: first centroid (by position) of those
    with a point, and the number of features with that name (> 1 = duplicate
    name)."""
    named = features.where(F.col("name").isNotNull() & (F.trim(F.col("name")) != ""))
    return named.groupBy(F.trim(F.col("name")).alias("name")).agg(
        F.min_by(F.struct("lon", "lat"), F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.col("pos"))).alias("_c"), F.count(F.lit(1)).alias("feature_count")
    ).select("name", F.col("_c.lon").alias("lon"), F.col("_c.lat").alias("lat"), "feature_count")


def geo_match(records: DataFrame, geo: DataFrame, name_col: str, value_col: str) -> DataFrame:
    """V4: values summed per matched feature name; names without data are
    left out (no-data is not zero)."""
    names = geo.select("name")
    r = records.select(F.trim(F.col(name_col).cast("string")).alias("name"), _numeric(value_col).alias("v"))
    return r.join(names, "name").groupBy("name").agg(F.round(F.sum("v"), 4).alias("value"))


def geo_unmatched(records: DataFrame, geo: DataFrame, name_col: str, value_col: str, limit: int = 10) -> DataFrame:
    """V4: of the groups whose name has no feature the ``limit`` largest, with their rank."""
    r = records.select(_numeric(value_col).alias("v"), F.col(name_col).cast("string").alias("record_name"),
                       F.coalesce(F.trim(F.col(name_col).cast("string")), F.lit("")).alias("name"))
    keys = [F.col("v").desc(), F.col("record_name").asc_nulls_last()]
    first = r.join(geo.select("name"), "name", "left_anti").orderBy(*keys).limit(limit)
    return first.select(F.row_number().over(Window.orderBy(*keys)).alias("pos"), "record_name")


def geo_missing(records: DataFrame, geo: DataFrame, name_col: str) -> DataFrame:
    """V4: feature names that have no data."""
    have = records.select(F.trim(F.col(name_col).cast("string")).alias("name")).where(F.col("name").isNotNull())
    return geo.select("name").join(have.distinct(), "name", "left_anti")


def geo_points(matched: DataFrame, geo: DataFrame) -> DataFrame:
    """V5: matched values with the feature centroid."""
    return matched.join(geo.select("name", "lon", "lat"), "name").select("name", "value", "lon", "lat")


def geo_scaled(matched: DataFrame) -> DataFrame:
    """V6: point size ``70 + 900·(v−min)/(max−min)``; 0.5 of the range when
    every value is equal."""
    ends = matched.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("_k", F.lit(1))
    span = F.col("hi") - F.col("lo")
    frac = F.when(span != 0, (F.col("value") - F.col("lo")) / span).otherwise(F.lit(0.5))
    return matched.withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k").select("name", "value", F.round(F.lit(70.0) + F.lit(900.0) * frac, 6).alias("size"))


def geo_summary(records: DataFrame, geo: DataFrame, name_col: str, value_col: str) -> DataFrame:
    """V4: one row: matched features with their least and largest value,
    features without data, names without a feature, duplicate feature names."""
    matched = geo_match(records, geo, name_col, value_col).agg(
        F.count(F.lit(1)).alias("matched"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    names = records.select(F.coalesce(F.trim(F.col(name_col).cast("string")), F.lit("")).alias("name")).distinct()
    unmatched = names.join(geo.select("name"), "name", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))
    missing = geo_missing(records, geo, name_col).agg(F.count(F.lit(1)).alias("missing"))
    twice = geo.agg(F.count_if(F.col("feature_count") > 1).alias("duplicates"))
    out = matched.withColumn("_k", F.lit(1))
    for part in (unmatched, missing, twice):
        out = out.join(part.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")
