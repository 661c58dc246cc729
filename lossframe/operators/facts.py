"""Report facts as small DataFrames.

Facts read all groups of the standard plans (their limits cut only the plans'
own output) and the totals. Windows run over years and event types; counties
are ranked by a distributed top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import AMOUNT_UNIT, DEFAULT_CATALOG, FLOOD_SEASON, PEOPLE_UNIT, Catalog
from ..functions.exprs import format_value
from ..operators.analyze import AnalysisResult
from ..plans.standard import PLANS_BY_KEY, run_plan, run_plans_shared

Results = dict[str, AnalysisResult]

LOSS = "direct_economic_loss"
_SHARE_FLOOR = 1e-9


def _ranked(records: DataFrame, key: str, by: str = LOSS) -> DataFrame:
    """Rank records by value desc, ties in their plan order (key asc)."""
    w = Window.orderBy(F.coalesce(F.col(by), F.lit(0.0)).desc(), F.col(key).asc_nulls_last())
    return records.withColumn("rank", F.row_number().over(w))


def _plan(clean: DataFrame, key: str, catalog: Catalog, results: Results | None) -> AnalysisResult:
    """The plan's result with all groups: from ``results`` of a shared scan, or by a scan of its own."""
    return results[key] if results else run_plan(clean, key, catalog, cut=False)


def fact_top_k(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG, k: int = 3, results: Results | None = None) -> DataFrame:
    """The k counties with the largest direct loss."""
    groups = _plan(clean, "county_ranking", catalog, results).groups
    recs = groups.orderBy(F.coalesce(F.col(LOSS), F.lit(0.0)).desc(), F.col("county").asc_nulls_last()).limit(k)
    return _ranked(recs, "county").select("rank", "county", F.col(LOSS).alias("value"))


def fact_peak_year(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """first/last year, peak year, its value and share of the years shown."""
    recs = run_plan(clean, "yearly_trend", catalog, cut=False).records.where(F.col("year").isNotNull())
    return recs.agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by("year", F.struct((-F.col(LOSS)).alias("v"), F.col("year").alias("y"))).alias("peak_year"),
        F.max(LOSS).alias("peak_value"),
        F.round(F.max(LOSS) / F.greatest(F.sum(LOSS), F.lit(_SHARE_FLOOR)) * 100, 2).alias("peak_share"),
    ).where(F.col("first_year").isNotNull())


def fact_yoy(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Last year against the one before, only with at least three years."""
    recs = run_plan(clean, "yearly_trend", catalog, cut=False).records.where(F.col("year").isNotNull())
    w = Window.orderBy("year")
    t = recs.select("year", F.col(LOSS).alias("recent"), F.lag(LOSS).over(w).alias("previous"),
                    F.count(F.lit(1)).over(Window.partitionBy()).alias("years"),
                    F.row_number().over(Window.orderBy(F.col("year").desc())).alias("_r"))
    return t.where((F.col("_r") == 1) & (F.col("years") >= 3)).select(
        F.col("year").alias("last_year"), "recent", "previous",
        F.when(F.col("recent") > F.col("previous"), F.lit("up")).otherwise(F.lit("down")).alias("direction"))


def fact_season_share(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG, results: Results | None = None) -> DataFrame:
    """Flood-season direct loss and its share of all seasons shown."""
    recs = _plan(clean, "by_season", catalog, results).records
    total = F.sum(F.coalesce(F.col(LOSS), F.lit(0.0)))
    out = recs.agg(F.max(F.when(F.col("season") == FLOOD_SEASON, F.col(LOSS))).alias("flood_value"),
                   total.alias("total"))
    return out.where(F.col("flood_value").isNotNull()).select(
        "flood_value", F.round(F.col("flood_value") / F.when(F.col("total") != 0, F.col("total"))
                               .otherwise(F.lit(_SHARE_FLOOR)) * 100, 2).alias("flood_share"))


def _plan_total(clean: DataFrame, key: str, catalog: Catalog) -> DataFrame:
    return run_plan(clean, key, catalog, cut=False).totals.select(F.col(LOSS).alias("total"))


def fact_county_concentration(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """The three leading counties and their combined share of the total."""
    top = fact_top_k(clean, catalog, 3)
    agg = top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "county"))),
                                           lambda x: x["county"]), ",").alias("counties"),
                  F.sum("value").alias("top_value"))
    total = _plan_total(clean, "county_ranking", catalog)
    return _concentration(agg, total)


def _concentration(agg: DataFrame, total: DataFrame) -> DataFrame:
    a = agg.withColumn("_k", F.lit(1))
    t = total.withColumn("_k", F.lit(1))
    return a.join(t, "_k").select(
        "counties", "top_value",
        F.round(F.col("top_value") / F.when(F.col("total") != 0, F.col("total")).otherwise(F.lit(_SHARE_FLOOR)) * 100, 2)
        .alias("share"))


def fact_type_share(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG, results: Results | None = None) -> DataFrame:
    """Every event type with its share of the untruncated total."""
    res = _plan(clean, "by_disaster_type", catalog, results)
    recs = res.records.withColumn("_k", F.lit(1))
    total = res.totals.select(F.col(LOSS).alias("total")).withColumn("_k", F.lit(1))
    return recs.join(total, "_k").select(
        "disaster_type", F.col(LOSS).alias("value"),
        F.round(F.col(LOSS) / F.when(F.col("total") != 0, F.col("total")).otherwise(F.lit(_SHARE_FLOOR)) * 100, 2)
        .alias("share"))


def fact_type_leaders(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG, k: int = 3, results: Results | None = None) -> DataFrame:
    """Leading event type and the next two, with shares."""
    shares = fact_type_share(clean, catalog, results)
    pos = F.array_position(F.array(*[F.lit(v) for v in catalog.dimension("disaster_type").order]), F.col("disaster_type"))
    ranked = shares.withColumn("_pos", F.when(pos > 0, pos).otherwise(F.lit(10**6))) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("value").desc(), F.col("_pos").asc(),
                                                               F.col("disaster_type").asc())))
    return ranked.where(F.col("rank") <= k).select("rank", "disaster_type", "value", "share")


def fact_loss_structure(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG, results: Results | None = None) -> DataFrame:
    """Largest amount item with its share, and the casualty total."""
    res = _plan(clean, "loss_structure", catalog, results)
    recs = res.records
    amount = recs.where(F.col("unit") == AMOUNT_UNIT)
    lead = amount.agg(
        F.min_by("loss_type", F.struct((-F.col("value")).alias("v"), F.col("pos").alias("p"))).alias("largest_type"),
        F.max("value").alias("largest_value"),
        F.min_by(F.col("share"), F.struct((-F.col("value")).alias("v"), F.col("pos").alias("p"))).alias("_share"))
    people = recs.agg(F.round(F.coalesce(F.sum(F.when(F.col("unit") == PEOPLE_UNIT, F.col("value"))), F.lit(0.0)), 2)
                      .alias("casualty_total"))
    return lead.withColumn("_k", F.lit(1)).join(people.withColumn("_k", F.lit(1)), "_k").select(
        "largest_type", "largest_value", F.round(F.coalesce(F.col("_share"), F.lit(0.0)) * 100, 2).alias("largest_share"),
        "casualty_total")


def fact_conclusion(clean: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """``(slot, label, value)`` conclusion facts from R5–R9, all from one scan."""
    keys = ("by_disaster_type", "county_ranking", "by_season", "loss_structure")
    results = run_plans_shared(clean, catalog, tuple(PLANS_BY_KEY[k] for k in keys), cut=False)
    lead = fact_type_leaders(clean, catalog, 1, results).select(F.lit("leading_type").alias("slot"),
                                                       F.col("disaster_type").alias("label"), F.col("share").alias("value"))
    top = fact_top_k(clean, catalog, 3, results).select(F.concat(F.lit("top_county_"), F.col("rank").cast("string")).alias("slot"),
                                                F.col("county").alias("label"), F.col("value"))
    flood = fact_season_share(clean, catalog, results).select(F.lit("flood_share").alias("slot"), F.lit(FLOOD_SEASON).alias("label"),
                                                     F.col("flood_share").alias("value"))
    struct = fact_loss_structure(clean, catalog, results).select(F.lit("structure_leader").alias("slot"),
                                                        F.col("largest_type").alias("label"),
                                                        F.col("largest_share").alias("value"))
    return lead.unionByName(top).unionByName(flood).unionByName(struct)


def fact_kpis(overview: DataFrame) -> DataFrame:
    """R12 + R13: the KPI row unpivoted with display strings."""
    numeric = [c for c, t in overview.dtypes if t in ("bigint", "int", "double")]
    long = overview.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("kpi"), F.col(c).cast("double").alias("value")) for c in numeric])))
    return long.select("kpi", "value", format_value("value").alias("display"))
