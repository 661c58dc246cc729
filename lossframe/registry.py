"""Registered queries (Spark) and their DuckDB counterparts.

``QUERIES[key](spark, sf_dir) -> DataFrame`` and ``ORACLES[key]() -> SQL``.
Keys follow the operator inventory. Column names are equal on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import DEFAULT_CATALOG as CAT
from .plans import duckdb_sql as D
from .plans.standard import STANDARD_PLANS, run_plan, run_plans_shared
from .tables import clean_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(key: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


# ------------------------------------------------------------ cleaning ----

CLEAN_COLS = [f.name for f in CAT.clean_schema().fields]


@register("clean_all", lambda: D.with_clean(f"SELECT {', '.join(CLEAN_COLS)} FROM clean"))
def q_clean_all(spark, sf):
    return clean_table(spark, sf)


# -------------------------------------------------------- standard plans ----

def _plan_query(plan):
    def q(spark, sf):
        return run_plan(clean_table(spark, sf), plan.key, CAT).records
    return q


def _plan_oracle(plan):
    def o():
        if plan.key == "loss_structure":
            return D.loss_structure_sql(CAT)
        return D.plan_sql(list(plan.dimensions), list(plan.metrics), plan.limit, CAT)
    return o


for _p in STANDARD_PLANS:
    register(f"plan_{_p.key}", _plan_oracle(_p))(_plan_query(_p))


# -------------------------------------------------- cleaning, step by step ----
# Spark side: the operators on the raw table / the annotated frame that
# ``clean`` builds (per-row flags). SQL side: slices of the same CTE chain.

from pyspark.sql import functions as F  # noqa: E402

from .functions import exprs as X  # noqa: E402
from .operators import clean as C  # noqa: E402
from .operators.audit import cleaning_audit, hierarchy_issue  # noqa: E402
from .tables import clean_result, raw_table  # noqa: E402

STD = CAT.standard_columns
METRICS = CAT.metric_names
TEXT = CAT.text_fields


def _ann(spark, sf):
    return clean_result(spark, sf).annotated


def _kept(spark, sf):
    return _ann(spark, sf).where(F.col("_kept"))


def _parsed(spark, sf):
    return C.parse_stage(C.drop_empty_rows(raw_table(spark, sf)))


def _per_metric_sql(source: str, expr_of) -> str:
    return " UNION ALL ".join(f"SELECT {D.q(m)} AS metric, CAST({expr_of(m)} AS BIGINT) AS n FROM {source}"
                              for m in METRICS)


def _per_metric_df(df, expr_of):
    row = df.agg(*[F.sum(expr_of(m).cast("long")).cast("long").alias(m) for m in METRICS])
    return row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in METRICS])))


register("null_tokens", lambda: D.with_clean(
    "SELECT _seq, " + ", ".join(f"CASE WHEN {D.missing(c)} THEN NULL ELSE {c} END AS {c}" for c in STD)
    + " FROM rawstd"))(lambda spark, sf: C.null_tokens(raw_table(spark, sf)).select("_seq", *STD))

register("drop_empty_rows", lambda: D.with_clean("SELECT _seq FROM p1"))(
    lambda spark, sf: C.drop_empty_rows(raw_table(spark, sf)).select("_seq"))

register("normalize_text", lambda: D.with_clean(f"SELECT _seq, {', '.join(TEXT)} FROM p1"))(
    lambda spark, sf: _parsed(spark, sf).select("_seq", *TEXT))

register("parse_dates", lambda: D.with_clean("SELECT _seq, occur_date FROM p1"))(
    lambda spark, sf: _parsed(spark, sf).select("_seq", "occur_date"))

register("calendar_parts", lambda: D.with_clean("SELECT _seq, year, quarter, month, day FROM p2"))(
    lambda spark, sf: _parsed(spark, sf).select("_seq", "year", "quarter", "month", "day"))


def _unit_name(text, units):
    expr = F.lit(None).cast("string")
    for u, _ in reversed(X.ordered_units(units)):
        expr = F.when(text.contains(u), F.lit(u)).otherwise(expr)
    return expr


@register("parse_quantity", lambda: D.with_clean(" UNION ALL ".join(
    f"SELECT _seq, {D.q(m)} AS metric, _num_{m} AS value, "
    + ("CASE " + " ".join(f"WHEN contains(_qt_{m}, {D.q(u)}) THEN {D.q(u)}" for u, _ in X.ordered_units(CAT.metric(m).units))
       + " END" if CAT.metric(m).units else "CAST(NULL AS VARCHAR)")
    + f" AS unit FROM p2 WHERE _num_{m} IS NOT NULL" for m in METRICS)))
def q_parse_quantity(spark, sf):
    # texts, then what they hold, then one row for each: no step is worked out inside the unpivot
    raw = C.drop_empty_rows(raw_table(spark, sf)).select("_seq", *[X.quantity_text(m).alias(m) for m in METRICS])
    read = raw.select("_seq", *[F.struct(X.number_of_text(F.col(m)).alias("value"), _unit_name(F.col(m), CAT.metric(m).units).alias("unit")).alias(m)
                                for m in METRICS])
    long = read.unpivot("_seq", METRICS, "metric", "cell")
    return long.select("_seq", "metric", "cell.value", "cell.unit").where(F.col("value").isNotNull())


register("convert_units", lambda: D.with_clean(_per_metric_sql("p2", lambda m: f"count_if(_conv_{m})")))(
    lambda spark, sf: _per_metric_df(_parsed(spark, sf), lambda m: F.col(f"_conv_{m}")))

register("imputed_count", lambda: D.with_clean(
    "SELECT _imputed_metrics, count(*) AS n FROM clean GROUP BY _imputed_metrics"))(
    lambda spark, sf: clean_table(spark, sf).groupBy("_imputed_metrics").agg(F.count(F.lit(1)).alias("n")))

register("fill_zero", lambda: D.with_clean(_per_metric_sql(
    "p2", lambda m: (f"count(*) - count({m})" if CAT.metric(m).fill == 0 else "0"))))(
    lambda spark, sf: _per_metric_df(_ann(spark, sf), lambda m: F.col(f"_fill_{m}")))

register("drop_missing_region", lambda: D.with_clean(
    "SELECT _seq FROM p2 WHERE NOT (" + " AND ".join(f"{c} IS NOT NULL" for c in CAT.required_region_fields) + ")"))(
    lambda spark, sf: _ann(spark, sf).where(~F.col("_kept")).select("_seq"))

register("fill_category", lambda: D.with_clean("SELECT _seq FROM p3 WHERE disaster_type IS NULL"))(
    lambda spark, sf: _kept(spark, sf).where(F.col("_fill_type")).select("_seq"))

register("clamp_low", lambda: D.with_clean(_per_metric_sql(
    "p3", lambda m: f"count_if(coalesce({m}, 0.0) < {float(CAT.metric(m).low)!r})")))(
    lambda spark, sf: _per_metric_df(_kept(spark, sf), lambda m: F.col(f"_low_{m}")))


@register("iqr_cap", lambda: D.with_clean(" UNION ALL ".join(
    f"SELECT _t AS disaster_type, {D.q(m)} AS metric, round(max(_ub_{m}), 4) AS upper_bound, "
    f"count_if(_cap_{m}) AS capped FROM p5 WHERE _n >= {CAT.rules['outlier']['min_group_size']} "
    f"AND _iqr_{m} > 0 GROUP BY _t" for m in METRICS)))
def q_iqr_cap(spark, sf):
    res = clean_result(spark, sf)
    capped = res.annotated.where(F.col("_kept")).groupBy("disaster_type").agg(
        *[F.count_if(F.col(f"_cap_{m}")).alias(f"_n_{m}") for m in METRICS])
    b = res.bounds.join(capped, res.bounds["_bt"] == capped["disaster_type"], "inner")
    long = b.select("disaster_type", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.round(F.col(f"_ub_{m}"), 4).alias("upper_bound"),
                 F.col(f"_n_{m}").cast("long").alias("capped")) for m in METRICS])))
    return long.where(F.col("upper_bound").isNotNull())


register("clamp_high", lambda: D.with_clean(_per_metric_sql("p5", lambda m: f"count_if(_high_{m})")))(
    lambda spark, sf: _per_metric_df(_kept(spark, sf), lambda m: F.col(f"_high_{m}")))

register("normalize_codes", lambda: D.with_clean("SELECT _seq, county_code FROM p6"))(
    lambda spark, sf: _kept(spark, sf).select("_seq", "county_code"))

register("hierarchy_prefix", lambda: D.with_clean("SELECT _seq FROM p6 WHERE _prefix_bad"))(
    lambda spark, sf: _kept(spark, sf).where(F.col("_prefix_bad")).select("_seq"))

register("hierarchy_name", lambda: D.with_clean("SELECT _seq FROM p6 WHERE _name_bad"))(
    lambda spark, sf: _kept(spark, sf).where(F.col("_name_bad")).select("_seq"))


def _hierarchy_samples_sql() -> str:
    """The first five rows against the province's code, five against the city's, then names; eight in all."""
    parts = [f"(SELECT {kind} AS kind, _seq, coalesce(county, '') || '(' || county_code || ') 与上级 ' || up || ' 前缀不符' AS said "
             f"FROM (SELECT *, {D.code_clean(parent)} AS up FROM p6) WHERE up IS NOT NULL AND substr(county_code, 1, {width}) <> substr(up, 1, {width}) "
             "ORDER BY _seq LIMIT 5)" for kind, parent, width in ((0, "province_code", 2), (1, "city_code", 4))]
    parts.append("(SELECT 2, _seq, county || '/' || county_code || ' 参照表记录为 ' || ref.name FROM p6 JOIN ref ON ref.code = county_code "
                 "WHERE _name_bad ORDER BY _seq LIMIT 8)")
    return f"(SELECT array_to_string(list(said ORDER BY kind, _seq)[1:8], '; ') FROM ({' UNION ALL '.join(parts)}))"


def _hierarchy_issue_sql() -> str:
    return (f"SELECT 'warning' AS level, 'HIERARCHY_CONFLICT' AS code, count(*) AS count, {_hierarchy_samples_sql()} AS samples "
            "FROM p6 WHERE NOT _hierarchy_ok HAVING count(*) > 0")


register("hierarchy_flag", lambda: D.with_clean(_hierarchy_issue_sql()))(
    lambda spark, sf: hierarchy_issue(clean_result(spark, sf)))

register("season_dim", lambda: D.with_clean("SELECT season, count(*) AS n FROM clean GROUP BY season"))(
    lambda spark, sf: clean_table(spark, sf).groupBy("season").agg(F.count(F.lit(1)).alias("n")))

register("per_capita_band", lambda: D.with_clean(
    "SELECT per_capita_level, count(*) AS n, coalesce(sum(direct_economic_loss), 0.0) AS direct_economic_loss "
    "FROM clean GROUP BY per_capita_level"))(
    lambda spark, sf: clean_table(spark, sf).groupBy("per_capita_level").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("direct_economic_loss"), F.lit(0.0)).alias("direct_economic_loss")))

register("dedupe_keep_first", lambda: D.with_clean("SELECT _seq FROM p7 WHERE _rn > 1"))(
    lambda spark, sf: _kept(spark, sf).select("_seq").join(clean_table(spark, sf).select("_seq"), "_seq", "left_anti"))


def _audit_sql() -> str:
    text_hit = "concat_ws(',', " + ", ".join(f"CASE WHEN sum(_chg_{f}::INT) > 0 THEN {D.q(f)} END" for f in TEXT) + ")"
    fill_hit = "concat_ws(',', " + ", ".join(
        f"CASE WHEN count(*) - count({m}) > 0 THEN {D.q(m)} END" for m in METRICS if CAT.metric(m).fill == 0) + ")"
    region = " AND ".join(f"{c} IS NOT NULL" for c in CAT.required_region_fields)
    rows = [
        f"SELECT 1 AS step_no, 0 AS sub, 'drop_empty_rows' AS step, '*' AS field, "
        f"'drop rows with every data cell empty' AS action, (SELECT count(*) FROM rawstd) - (SELECT count(*) FROM p1) AS affected, '' AS detail",
        f"SELECT 2, 0, 'normalize_text', {text_hit}, 'remove white space, missing tokens to null', "
        + " + ".join(f"sum(_chg_{f}::INT)" for f in TEXT) + ", '' FROM p1",
        "SELECT 3, 0, 'parse_dates', 'occur_date', 'parse with the configured formats', count(occur_date), "
        "'failed ' || CAST(greatest(count_if(_date_raw) - count(occur_date), 0) AS VARCHAR) FROM p1",
        "SELECT 4, 0, 'calendar_parts', 'year/quarter/month/day', 'derive calendar parts', count(occur_date), '' FROM p1",
    ]
    rows += [f"SELECT 5, {i}, 'convert_units', {D.q(m)}, 'convert to the standard unit', count_if(_conv_{m}), '' FROM p2"
             for i, m in enumerate(METRICS)]
    rows.append(f"SELECT 6, 0, 'fill_zero', {fill_hit}, 'fill missing metrics with 0, counted in _imputed_metrics', "
                + " + ".join(f"(count(*) - count({m}))" for m in METRICS if CAT.metric(m).fill == 0) + ", '' FROM p2")
    rows.append(f"SELECT 7, 0, 'drop_missing_region', {D.q(','.join(CAT.required_region_fields))}, "
                f"'drop rows without required region', count_if(NOT ({region})), '' FROM p2")
    rows.append("SELECT 8, 0, 'fill_category', 'disaster_type', 'missing event type to the other category', "
                "count_if(disaster_type IS NULL), '' FROM p3")
    rows += [f"SELECT 9, {i}, 'iqr_cap', {D.q(m)}, 'cap above Q3 + k*IQR per event type', count_if(_cap_{m}), '' FROM p5"
             for i, m in enumerate(METRICS)]
    rows.append("SELECT 10, 0, 'clamp_bounds', 'all metrics', 'clamp to business bounds', "
                + " + ".join(f"count_if(_v1_{m} <> coalesce({m}_raw, 0.0) OR _high_{m})" for m in METRICS) + ", '' FROM p5x")
    rows.append("SELECT 11, 0, 'hierarchy_check', 'province/city/county codes', 'code prefix and reference name check', "
                "count_if(NOT _hierarchy_ok), '' FROM p6")
    rows.append("SELECT 12, 0, 'derive_dimensions', 'season/per_capita_level', 'derive custom dimensions', count(*), '' FROM p6")
    rows.append(f"SELECT 13, 0, 'dedupe_keep_first', {D.q(','.join(CAT.rules['dedupe_on']))}, "
                "'keep the first row per business key', count_if(_rn > 1), '' FROM p7")
    body = " UNION ALL ".join(rows)
    p5x = "p5x AS (SELECT p5.*, " + ", ".join(f"p4.{m} AS {m}_raw" for m in METRICS) + " FROM p5 JOIN p4 USING (_seq))"
    return D.with_clean(f"SELECT * FROM ({body}) a WHERE affected > 0", extra_ctes=p5x)


def _cleaning_audit(spark, sf):
    clean_table(spark, sf)  # written once per session; the audit counts its rows
    return cleaning_audit(clean_result(spark, sf))


register("cleaning_audit", _audit_sql)(_cleaning_audit)


# ------------------------------------------- analysis: one entry point ----

from .operators.analyze import AnalysisRequest, aggregate, loss_structure, region_drill  # noqa: E402


def _req_query(req_factory, part="records"):
    def q(spark, sf):
        res = aggregate(clean_table(spark, sf), req_factory(), CAT)
        return res.meta() if part == "meta" else getattr(res, part)
    return q


def _reg_request(key, req_factory, sql_factory, part="records"):
    register(key, sql_factory)(_req_query(req_factory, part))


LOSS = "direct_economic_loss"
_reg_request("filter_eq",
             lambda: AnalysisRequest(["time_year"], [LOSS], {"disaster_type": "2-HIGH", "emergency_level": "no-such-level"}),
             lambda: D.plan_sql(["time_year"], [LOSS], 50, CAT, where="disaster_type = '2-HIGH'"))
_reg_request("filter_in",
             lambda: AnalysisRequest(["disaster_type"], [LOSS], {"emergency_level": ["F", "P"]}),
             lambda: D.plan_sql(["disaster_type"], [LOSS], 50, CAT, where="emergency_level IN ('F', 'P')"))
_reg_request("agg_group",
             lambda: AnalysisRequest(["region_province", "custom_season"], [LOSS, "affected_population", "deaths"], limit=None),
             lambda: D.plan_sql(["region_province", "custom_season"], [LOSS, "affected_population", "deaths"], None, CAT))
_reg_request("agg_global", lambda: AnalysisRequest([], METRICS, limit=None),
             lambda: D.plan_sql([], METRICS, None, CAT))
_reg_request("order_temporal", lambda: AnalysisRequest(["time_quarter", "disaster_type"], [LOSS], limit=12),
             lambda: D.plan_sql(["time_quarter", "disaster_type"], [LOSS], 12, CAT))
_reg_request("order_listed", lambda: AnalysisRequest(["custom_season", "region_province"], [LOSS], limit=None),
             lambda: D.plan_sql(["custom_season", "region_province"], [LOSS], None, CAT))
_reg_request("order_metric", lambda: AnalysisRequest(["region_city"], [LOSS], limit=10, ascending=True),
             lambda: D.plan_sql(["region_city"], [LOSS], 10, CAT, ascending=True))
_reg_request("sort_by", lambda: AnalysisRequest(["time_month"], [LOSS], limit=5, sort_by=LOSS),
             lambda: D.plan_sql(["time_month"], [LOSS], 5, CAT, sort_by=LOSS))
_reg_request("top_n", lambda: AnalysisRequest(["region_county"], [LOSS], limit=10),
             lambda: D.plan_sql(["region_county"], [LOSS], 10, CAT))
_reg_request("totals",
             lambda: AnalysisRequest(["region_county"], [LOSS, "affected_population"], {"custom_season": "汛期"}, limit=5),
             lambda: D.with_clean(f"SELECT round(coalesce(sum({LOSS}), 0.0), 4) AS {LOSS}, "
                                  "round(coalesce(sum(affected_population), 0.0), 4) AS affected_population "
                                  "FROM clean WHERE season = '汛期'"), part="totals")
_reg_request("result_meta",
             lambda: AnalysisRequest(["region_county"], [LOSS], {"custom_season": "汛期"}, limit=5),
             lambda: D.with_clean("SELECT 'rows_input' AS key, count(*) AS value FROM clean UNION ALL "
                                  "SELECT 'rows_after_filter', count(*) FROM clean WHERE season = '汛期' UNION ALL "
                                  "SELECT 'record_count', count(DISTINCT coalesce(county, chr(1))) FROM clean WHERE season = '汛期'"),
             part="meta")
register("loss_structure", lambda: D.loss_structure_sql(CAT, where="season = '汛期'"))(
    lambda spark, sf: aggregate(clean_table(spark, sf),
                                AnalysisRequest(["loss_structure"], [], {"custom_season": "汛期"}), CAT).records)

for _key, _dim in [("by_year", "time_year"), ("by_quarter", "time_quarter"), ("by_month", "time_month"),
                   ("by_day", "time_day"), ("by_province", "region_province"), ("by_city", "region_city"),
                   ("by_county", "region_county"), ("by_town", "region_town")]:
    _reg_request(_key, (lambda d=_dim: AnalysisRequest([d], [LOSS], limit=None)),
                 (lambda d=_dim: D.plan_sql([d], [LOSS], None, CAT)))


def _drill_sql():
    codes = ", ".join(f"{D.code_clean(c)} AS {c}" for c in ("province_code", "city_code")) + ", county_code"
    keys = ("province_code", "city_code", "county_code", "town")
    level = " + ".join(f"(1 - GROUPING({k}))" for k in keys)
    return D.with_clean(
        f"SELECT CAST(level AS INTEGER) AS level, {', '.join(keys)}, CASE level WHEN 4 THEN town WHEN 3 THEN n3 WHEN 2 THEN n2 WHEN 1 THEN n1 END AS name, "
        f"records, {LOSS}, affected_population FROM (SELECT {level} AS level, {', '.join(keys)}, min(province) AS n1, min(city) AS n2, min(county) AS n3, "
        f"count(*) AS records, coalesce(sum({LOSS}), 0.0) AS {LOSS}, coalesce(sum(affected_population), 0.0) AS affected_population "
        f"FROM (SELECT {codes}, province, city, county, town, {LOSS}, affected_population FROM clean) GROUP BY ROLLUP ({', '.join(keys)}))")


register("region_drill_by_code", _drill_sql)(lambda spark, sf: region_drill(clean_table(spark, sf), [LOSS, "affected_population"], CAT))


# ------------------------------------- profiling, facts, charts, quality ----

from .catalog import AMOUNT_UNIT, FLOOD_SEASON, PEOPLE_UNIT  # noqa: E402
from .operators import charts as V  # noqa: E402
from .operators import facts as R  # noqa: E402
from .operators import profile as P  # noqa: E402
from .operators import quality as Q  # noqa: E402
from .operators import questions as N  # noqa: E402
from .plans.standard import PLANS_BY_KEY  # noqa: E402
from .sources.fixtures import QUESTIONS_SQL, duckdb_sql, geo_features, questions, region_reference  # noqa: E402

RAW_COLS = STD + ["_source_file", "_source_sheet"]


def _recs(name, key):
    p = PLANS_BY_KEY[key]
    return D.records_cte(name, list(p.dimensions), list(p.metrics), None, CAT)  # all groups


# P1
def _profile_sql():
    parts = []
    for c in RAW_COLS:
        is_m = c in METRICS
        num = D.number_sql(c) if is_m else "NULL"
        parts.append(
            f"SELECT {D.q(c)} AS field, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
            f"round((count(*) - count({c})) / greatest(count(*), 1), 4) AS missing_rate, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, "
            + (f"round(count({num}) / greatest(count(*), 1), 4)" if is_m else "CAST(NULL AS DOUBLE)")
            + " AS numeric_parse_rate, " + (f"max({num})" if is_m else "CAST(NULL AS DOUBLE)") + " AS max FROM rawstd")
    return D.with_clean(" UNION ALL ".join(parts))


register("profile_columns", _profile_sql)(lambda spark, sf: P.profile_columns(raw_table(spark, sf).drop("_seq")))


# P2
def _overview_sql():
    tot = ", ".join(f"round(coalesce(sum({m}), 0.0), 2) AS total_{m}" for m in METRICS)
    return D.with_clean(
        "SELECT count(*) AS records, count(DISTINCT disaster_type) AS event_types, count(DISTINCT county) AS counties, "
        "strftime(min(occur_date), '%Y-%m-%d') AS period_start, strftime(max(occur_date), '%Y-%m-%d') AS period_end, "
        f"{tot}, round(coalesce(sum(direct_economic_loss), 0.0) / count(*), 2) AS mean_direct_loss, "
        "count_if(_imputed_metrics > 0) AS imputed_records, count_if(NOT _hierarchy_ok) AS hierarchy_conflicts FROM clean")


register("overview_kpis", _overview_sql)(lambda spark, sf: P.overview_kpis(clean_table(spark, sf)))

def _overview_raw_sql():
    tot = ", ".join(f"round(coalesce(sum({D.number_sql(m)} * {D.factor_sql(m, CAT.metric(m).units)}), 0.0), 2) AS total_{m}" for m in METRICS)
    loss = f"{D.number_sql(LOSS)} * {D.factor_sql(LOSS, CAT.metric(LOSS).units)}"
    when = D.date_sql("occur_date", CAT)
    return D.with_clean(
        "SELECT count(*) AS records, count(DISTINCT disaster_type) AS event_types, count(DISTINCT county) AS counties, "
        f"strftime(min({when}), '%Y-%m-%d') AS period_start, strftime(max({when}), '%Y-%m-%d') AS period_end, {tot}, "
        f"round(coalesce(sum({loss}), 0.0) / NULLIF(count(*), 0), 2) AS mean_direct_loss FROM rawstd")


register("overview_raw", _overview_raw_sql)(lambda spark, sf: P.overview_kpis(raw_table(spark, sf)))

_reg_request("agg_global_empty", lambda: AnalysisRequest([], [LOSS], {"region_county": ["no such county"]}),
             lambda: D.with_clean(f"SELECT sum({LOSS}) AS {LOSS} FROM clean WHERE county IN ('no such county') HAVING count(*) > 0"))

# P4
register("unit_aware_sum", lambda: D.with_clean(" UNION ALL ".join(
    f"SELECT {D.q(m)} AS metric, round(coalesce(sum({D.number_sql(m)} * {D.factor_sql(m, CAT.metric(m).units)}), 0.0), 4) "
    f"AS total FROM rawstd" for m in METRICS)))(lambda spark, sf: P.unit_aware_sum(raw_table(spark, sf)))


# P5
def _hints_sql():
    parts = []
    for name, d in CAT.dimensions.items():
        if d.is_virtual or not d.field:
            continue
        parts.append(f"SELECT {D.q(name)} AS dimension, count(*) AS n, string_agg(v, '|' ORDER BY v) AS hint_values "
                     f"FROM (SELECT DISTINCT CAST({d.field} AS VARCHAR) AS v FROM clean WHERE {d.field} IS NOT NULL) "
                     f"HAVING count(*) BETWEEN 1 AND 40")
    return D.with_clean(" UNION ALL ".join(parts))


register("filter_hints", _hints_sql)(lambda spark, sf: P.filter_hints(clean_table(spark, sf)))


# R1–R13
def _facts_sql(select: str, *ctes: str) -> str:
    return D.with_clean(select, extra_ctes=", ".join(ctes))


TOTAL_LOSS = f"(SELECT round(coalesce(sum({LOSS}), 0.0), 4) FROM clean)"

register("fact_top_k", lambda: _facts_sql(
    f"SELECT rank, county, value FROM (SELECT row_number() OVER (ORDER BY {LOSS} DESC, county ASC NULLS LAST) AS rank, "
    f"county, {LOSS} AS value FROM cr) WHERE rank <= 3", _recs("cr", "county_ranking")))(
    lambda spark, sf: R.fact_top_k(clean_table(spark, sf)))

register("fact_peak_year", lambda: _facts_sql(
    f"SELECT min(year) AS first_year, max(year) AS last_year, first(year ORDER BY {LOSS} DESC, year ASC) AS peak_year, "
    f"max({LOSS}) AS peak_value, round(max({LOSS}) / greatest(sum({LOSS}), 1e-9) * 100, 2) AS peak_share "
    "FROM yr WHERE year IS NOT NULL HAVING count(*) > 0", _recs("yr", "yearly_trend")))(
    lambda spark, sf: R.fact_peak_year(clean_table(spark, sf)))

register("fact_yoy", lambda: _facts_sql(
    "SELECT year AS last_year, recent, previous, CASE WHEN recent > previous THEN 'up' ELSE 'down' END AS direction "
    f"FROM (SELECT year, {LOSS} AS recent, lag({LOSS}) OVER (ORDER BY year) AS previous, count(*) OVER () AS years, "
    "row_number() OVER (ORDER BY year DESC) AS r FROM yr WHERE year IS NOT NULL) WHERE r = 1 AND years >= 3",
    _recs("yr", "yearly_trend")))(lambda spark, sf: R.fact_yoy(clean_table(spark, sf)))

register("fact_season_share", lambda: _facts_sql(
    "SELECT flood_value, round(flood_value / CASE WHEN total <> 0 THEN total ELSE 1e-9 END * 100, 2) AS flood_share "
    f"FROM (SELECT max(CASE WHEN season = {D.q(FLOOD_SEASON)} THEN {LOSS} END) AS flood_value, "
    f"sum(coalesce({LOSS}, 0.0)) AS total FROM se) WHERE flood_value IS NOT NULL", _recs("se", "by_season")))(
    lambda spark, sf: R.fact_season_share(clean_table(spark, sf)))

register("fact_county_concentration", lambda: _facts_sql(
    f"SELECT string_agg(county, ',' ORDER BY rank) AS counties, sum(value) AS top_value, "
    f"round(sum(value) / CASE WHEN {TOTAL_LOSS} <> 0 THEN {TOTAL_LOSS} ELSE 1e-9 END * 100, 2) AS share "
    f"FROM (SELECT row_number() OVER (ORDER BY {LOSS} DESC, county ASC NULLS LAST) AS rank, county, {LOSS} AS value "
    "FROM cr) WHERE rank <= 3", _recs("cr", "county_ranking")))(
    lambda spark, sf: R.fact_county_concentration(clean_table(spark, sf)))

_TYPE_SHARE = (f"SELECT disaster_type, {LOSS} AS value, round({LOSS} / CASE WHEN {TOTAL_LOSS} <> 0 THEN {TOTAL_LOSS} "
               f"ELSE 1e-9 END * 100, 2) AS share, pos FROM bt")
register("fact_type_share", lambda: _facts_sql(
    f"SELECT disaster_type, value, share FROM ({_TYPE_SHARE})", _recs("bt", "by_disaster_type")))(
    lambda spark, sf: R.fact_type_share(clean_table(spark, sf)))

_ORDER_ARR = "[" + ", ".join(D.q(v) for v in CAT.dimension("disaster_type").order) + "]"
register("fact_type_leaders", lambda: _facts_sql(
    f"SELECT rank, disaster_type, value, share FROM (SELECT *, row_number() OVER (ORDER BY value DESC, "
    f"coalesce(list_position({_ORDER_ARR}, disaster_type), 1000000) ASC, disaster_type ASC) AS rank FROM ({_TYPE_SHARE})) "
    "WHERE rank <= 3", _recs("bt", "by_disaster_type")))(lambda spark, sf: R.fact_type_leaders(clean_table(spark, sf)))

_LS_FACT = (f"SELECT first(loss_type ORDER BY value DESC, pos ASC) FILTER (WHERE unit = {D.q(AMOUNT_UNIT)}) AS largest_type, "
            f"max(value) FILTER (WHERE unit = {D.q(AMOUNT_UNIT)}) AS largest_value, "
            f"round(coalesce(first(share ORDER BY value DESC, pos ASC) FILTER (WHERE unit = {D.q(AMOUNT_UNIT)}), 0.0) * 100, 2) "
            f"AS largest_share, round(coalesce(sum(value) FILTER (WHERE unit = {D.q(PEOPLE_UNIT)}), 0.0), 2) AS casualty_total FROM ls")
register("fact_loss_structure", lambda: _facts_sql(_LS_FACT, D.ls_cte(CAT)))(
    lambda spark, sf: R.fact_loss_structure(clean_table(spark, sf)))


def _conclusion_sql():
    lead = (f"SELECT 'leading_type' AS slot, disaster_type AS label, share AS value FROM (SELECT *, row_number() OVER "
            f"(ORDER BY value DESC, coalesce(list_position({_ORDER_ARR}, disaster_type), 1000000) ASC, disaster_type ASC) "
            f"AS rank FROM ({_TYPE_SHARE})) WHERE rank = 1")
    top = (f"SELECT 'top_county_' || CAST(rank AS VARCHAR) AS slot, county AS label, value FROM (SELECT row_number() "
           f"OVER (ORDER BY {LOSS} DESC, county ASC NULLS LAST) AS rank, county, {LOSS} AS value FROM cr) WHERE rank <= 3")
    flood = (f"SELECT 'flood_share' AS slot, {D.q(FLOOD_SEASON)} AS label, round(flood_value / CASE WHEN total <> 0 "
             f"THEN total ELSE 1e-9 END * 100, 2) AS value FROM (SELECT max(CASE WHEN season = {D.q(FLOOD_SEASON)} "
             f"THEN {LOSS} END) AS flood_value, sum(coalesce({LOSS}, 0.0)) AS total FROM se) WHERE flood_value IS NOT NULL")
    struct = f"SELECT 'structure_leader' AS slot, largest_type AS label, largest_share AS value FROM ({_LS_FACT})"
    return _facts_sql(" UNION ALL ".join([lead, top, flood, struct]), _recs("bt", "by_disaster_type"),
                      _recs("cr", "county_ranking"), _recs("se", "by_season"), D.ls_cte(CAT))


register("fact_conclusion", _conclusion_sql)(lambda spark, sf: R.fact_conclusion(clean_table(spark, sf)))


def _fmt_sql(x: str) -> str:
    return (f"CASE WHEN abs({x}) >= 10000 THEN format('{{:,.0f}}', {x}) WHEN {x} = floor({x}) "
            f"THEN format('{{:,.0f}}', {x}) ELSE format('{{:,.2f}}', {x}) END")


def _kpis_sql():
    kpis = ["records", "event_types", "counties"] + [f"total_{m}" for m in METRICS] + [
        "mean_direct_loss", "imputed_records", "hierarchy_conflicts"]
    ov = _overview_sql().split("\n")[-1]
    body = " UNION ALL ".join(f"SELECT {D.q(k)} AS kpi, CAST({k} AS DOUBLE) AS value FROM ov" for k in kpis)
    return D.with_clean(f"SELECT kpi, value, {_fmt_sql('value')} AS display FROM ({body})", extra_ctes=f"ov AS ({ov})")


register("fact_kpis", _kpis_sql)(lambda spark, sf: R.fact_kpis(P.overview_kpis(clean_table(spark, sf))))

register("format_value", lambda: _facts_sql(
    f"SELECT disaster_type, {LOSS} AS value, {_fmt_sql(LOSS)} AS display FROM bt", _recs("bt", "by_disaster_type")))(
    lambda spark, sf: run_plan(clean_table(spark, sf), "by_disaster_type", CAT, cut=False).records.select(
        "disaster_type", F.col(LOSS).alias("value"), X.format_value(LOSS).alias("display")))


# V1–V6, S9, S10
register("chart_series", lambda: _facts_sql(
    f"SELECT pos, CAST(disaster_type AS VARCHAR) AS category, coalesce({LOSS}, 0.0) AS value FROM bt",
    _recs("bt", "by_disaster_type")))(
    lambda spark, sf: V.chart_series(run_plan(clean_table(spark, sf), "by_disaster_type", CAT, cut=False)))

register("chart_pivot", lambda: _facts_sql(
    "SELECT CAST(c.cat_pos AS INTEGER) AS cat_pos, CAST(c.category AS VARCHAR) AS category, CAST(s.ser_pos AS INTEGER) "
    "AS ser_pos, s.series, coalesce(m.v, 0.0) AS value FROM cats c CROSS JOIN sers s LEFT JOIN "
    "(SELECT disaster_type, coalesce(CAST(emergency_level AS VARCHAR), 'None') AS series, "
    f"first(coalesce({LOSS}, 0.0) ORDER BY pos) AS v FROM mx GROUP BY 1, 2) m "
    "ON m.disaster_type IS NOT DISTINCT FROM c.category AND m.series = s.series",
    _recs("mx", "type_level_matrix"),
    "cats AS (SELECT disaster_type AS category, min(pos) AS cat_pos FROM mx GROUP BY 1)",
    "sers AS (SELECT series, row_number() OVER (ORDER BY p) AS ser_pos FROM (SELECT coalesce(CAST(emergency_level AS "
    "VARCHAR), 'None') AS series, min(pos) AS p FROM mx GROUP BY 1))"))(
    lambda spark, sf: V.chart_pivot(run_plan(clean_table(spark, sf), "type_level_matrix", CAT, cut=False)))

register("chart_share", lambda: _facts_sql(
    f"SELECT pos, loss_type, value, round(value / NULLIF(sum(value) OVER (), 0) * 100, 2) AS pct FROM ls "
    f"WHERE unit = {D.q(AMOUNT_UNIT)}", D.ls_cte(CAT)))(
    lambda spark, sf: V.chart_share(run_plan(clean_table(spark, sf), "loss_structure", CAT)))

register("region_dim", lambda: D.region_sql())(lambda spark, sf: region_reference(spark, sf))

register("geo_dim", lambda: _facts_sql("SELECT name, lon, lat, feature_count FROM geo", D.geo_ctes()))(
    lambda spark, sf: V.geo_dim(geo_features(spark, sf)))


def _choropleth(spark, sf):
    groups = run_plan(clean_table(spark, sf), "county_choropleth", CAT, cut=False).groups
    return groups, V.geo_dim(geo_features(spark, sf))


_GEO_MATCHED = (f"SELECT trim(county) AS name, round(sum(coalesce({LOSS}, 0.0)), 4) AS value FROM ch "
                "WHERE trim(county) IN (SELECT name FROM geo) GROUP BY trim(county)")
register("geo_match", lambda: _facts_sql(_GEO_MATCHED, _recs("ch", "county_choropleth"), D.geo_ctes()))(
    lambda spark, sf: V.geo_match(*_choropleth(spark, sf), "county", LOSS))

register("geo_unmatched", lambda: _facts_sql(
    f"SELECT row_number() OVER (ORDER BY coalesce({LOSS}, 0.0) DESC, county ASC NULLS LAST) AS pos, CAST(county AS VARCHAR) AS record_name "
    f"FROM ch WHERE coalesce(trim(county), '') NOT IN (SELECT name FROM geo) ORDER BY pos LIMIT 10",
    _recs("ch", "county_choropleth"), D.geo_ctes()))(
    lambda spark, sf: V.geo_unmatched(*_choropleth(spark, sf), "county", LOSS))

register("geo_missing", lambda: _facts_sql(
    "SELECT name FROM geo WHERE name NOT IN (SELECT trim(county) FROM ch WHERE county IS NOT NULL)",
    _recs("ch", "county_choropleth"), D.geo_ctes()))(
    lambda spark, sf: V.geo_missing(*_choropleth(spark, sf), "county"))


def _matched(spark, sf):
    recs, geo = _choropleth(spark, sf)
    return V.geo_match(recs, geo, "county", LOSS), geo


register("geo_points", lambda: _facts_sql(
    f"SELECT m.name, m.value, g.lon, g.lat FROM ({_GEO_MATCHED}) m JOIN geo g USING (name)",
    _recs("ch", "county_choropleth"), D.geo_ctes()))(lambda spark, sf: V.geo_points(*_matched(spark, sf)))

register("geo_scaled", lambda: _facts_sql(
    "SELECT name, value, round(70.0 + 900.0 * CASE WHEN max(value) OVER () - min(value) OVER () <> 0 THEN "
    "(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) ELSE 0.5 END, 6) AS size "
    f"FROM ({_GEO_MATCHED})", _recs("ch", "county_choropleth"), D.geo_ctes()))(
    lambda spark, sf: V.geo_scaled(_matched(spark, sf)[0]))


register("geo_summary", lambda: _facts_sql(
    f"SELECT (SELECT count(*) FROM ({_GEO_MATCHED})) AS matched, (SELECT min(value) FROM ({_GEO_MATCHED})) AS min_value, "
    f"(SELECT max(value) FROM ({_GEO_MATCHED})) AS max_value, (SELECT count(DISTINCT coalesce(trim(county), '')) FROM ch "
    "WHERE coalesce(trim(county), '') NOT IN (SELECT name FROM geo)) AS unmatched, (SELECT count(*) FROM geo WHERE name NOT IN "
    "(SELECT trim(county) FROM ch WHERE county IS NOT NULL)) AS missing, (SELECT count(*) FROM geo WHERE feature_count > 1) AS duplicates",
    _recs("ch", "county_choropleth"), D.geo_ctes()))(
    lambda spark, sf: V.geo_summary(*_choropleth(spark, sf), "county", LOSS))


# Q1–Q3
register("dq_row_count", lambda: D.with_clean(
    "SELECT (SELECT count(*) FROM rawstd) AS rows_in, (SELECT count(*) FROM clean) AS rows_out, "
    "(SELECT count(*) FROM clean) > 0 AND (SELECT count(*) FROM clean) <= (SELECT count(*) FROM rawstd) AS passed"))(
    lambda spark, sf: Q.dq_row_count(raw_table(spark, sf), clean_table(spark, sf)))


def _dq_totals_sql():
    parts = []
    for p in STANDARD_PLANS:
        if p.key == "loss_structure":
            parts.append(
                "SELECT 'loss_structure' AS plan, CAST(count(*) AS BIGINT) AS records, least("
                f"round(coalesce(sum(value) FILTER (WHERE unit = {D.q(AMOUNT_UNIT)}), 0.0), 2), "
                f"round(coalesce(sum(value) FILTER (WHERE unit = {D.q(PEOPLE_UNIT)}), 0.0), 2)) AS min_total FROM ls")
            continue
        fields = [CAT.dimension(d).field for d in p.dimensions]
        groups = f"(SELECT count(*) FROM (SELECT 1 FROM clean GROUP BY {', '.join(fields)}))"
        tots = [f"round(coalesce(sum({m}), 0.0), 4)" for m in p.metrics]
        low = f"least({', '.join(tots)})" if len(tots) > 1 else tots[0]
        parts.append(f"SELECT {D.q(p.key)} AS plan, CAST(least({groups}, {p.limit}) AS BIGINT) AS records, "
                     f"CAST({low} AS DOUBLE) AS min_total FROM clean")
    body = " UNION ALL ".join(parts)
    return D.with_clean(f"SELECT plan, records, min_total, coalesce(min_total, 0.0) >= 0 AS passed FROM ({body})",
                        extra_ctes=D.ls_cte(CAT))


def _dq_totals(spark, sf):
    clean = clean_table(spark, sf)
    results = run_plans_shared(clean, CAT)
    for res in results.values():
        if res.is_structure:
            res.totals = res.totals.select("amount_total", "casualty_total")
    return Q.dq_totals(results)


register("dq_totals", _dq_totals_sql)(_dq_totals)

register("dq_metrics", lambda: D.with_clean(" UNION ALL ".join(
    f"SELECT {D.q(m)} AS metric, count_if({m} IS NULL) AS nulls, count_if({m} < 0) AS negatives, "
    f"count_if({m} IS NULL) = 0 AND count_if({m} < 0) = 0 AS passed FROM clean" for m in METRICS)))(
    lambda spark, sf: Q.dq_metrics(clean_table(spark, sf)))


# N1, N2
def _tag_sql(metric_limit: int):
    text = "coalesce(text, '')"

    def any_of(words):
        return "(" + " OR ".join(f"contains({text}, {D.q(w)})" for w in words) + ")"
    structure = any_of(N.DIMENSION_RULES[0][1])
    dims = []
    for name, words in N.DIMENSION_RULES:
        cond = any_of(words) + (f" AND NOT {structure}" if name == "disaster_type" else "")
        dims.append(f"CASE WHEN {cond} THEN {D.q(name)} END")
    dim_list = f"list_filter([{', '.join(dims)}], lambda x: x IS NOT NULL)"
    mets = ", ".join(f"CASE WHEN {any_of(words)} THEN [{', '.join(D.q(m) for m in ms)}] ELSE []::VARCHAR[] END"
                     for words, ms in N.METRIC_RULES)
    met_list = f"flatten([{mets}])"
    first_type = "coalesce(" + ", ".join(f"CASE WHEN contains({text}, {D.q(w)}) THEN {D.q(w)} END" for w in N.TYPE_KEYWORDS) + ")"
    first_level = "coalesce(" + ", ".join(f"CASE WHEN contains({text}, {D.q(w)}) THEN {D.q(w)} END" for w in N.LEVEL_KEYWORDS) + ")"
    return (f"SELECT conv_id, turn, array_to_string(CASE WHEN len({dim_list}) = 0 THEN [{D.q(N.DEFAULT_DIMENSION)}] "
            f"ELSE {dim_list}[1:2] END, '|') AS dims, array_to_string(CASE WHEN len({met_list}) = 0 THEN "
            f"[{D.q(N.DEFAULT_METRIC)}] ELSE {met_list}[1:{metric_limit}] END, '|') AS metrics, "
            f"{first_type} AS filter_type, {first_level} AS filter_level FROM ({duckdb_sql(QUESTIONS_SQL)})")


def _tagged(spark, sf):
    return N.tag_questions(questions(spark, sf))


register("tag_questions", lambda: _tag_sql(3))(
    lambda spark, sf: _tagged(spark, sf).select("conv_id", "turn", F.array_join("dims", "|").alias("dims"),
                                                F.array_join("metrics", "|").alias("metrics"), "filter_type", "filter_level"))
register("sanitize_plans", lambda: f"SELECT conv_id, turn, dims, metrics FROM ({_tag_sql(2)})")(
    lambda spark, sf: N.sanitize_plans(_tagged(spark, sf)).select(
        "conv_id", "turn", F.array_join("dims", "|").alias("dims"), F.array_join("metrics", "|").alias("metrics")))


# ------------------------------------------------------- sources and sinks ----

from .sources import headers as H  # noqa: E402
from .sources import writers as W  # noqa: E402
from .sources.delimited import ingest_issues, ingest_report  # noqa: E402
from .session import scratch_path  # noqa: E402
from .tables import csv_ingest  # noqa: E402


def _norm_sql(c: str) -> str:
    ws = D.WS_SQL[:-1] + " || '_-')"
    return f"lower(translate(regexp_replace(coalesce({c}, ''), {D.q(r'[（(].*?[)）]')}, '', 'g'), {ws}, ''))"


def _alias_sql() -> str:
    rows = ", ".join(f"({i}, {D.q(k)}, {D.q(t)})" for i, (k, t) in enumerate(H.alias_entries(CAT)))
    return (f"al0 AS (SELECT * FROM (VALUES {rows}) v(priority, raw_key, target)), "
            f"al AS (SELECT {_norm_sql('raw_key')} AS norm_key, arg_max(target, priority) AS target FROM al0 "
            f"WHERE {_norm_sql('raw_key')} <> '' GROUP BY 1)")


def _notes_sql() -> str:
    return "('c', 0, '列名'), ('c', 1, '说明')"


def _headers_sql() -> str:
    lab, ali = W.label_layout(), W.alias_layout()
    present = [c for c in STD]
    a = [lab[c] for c in present] + ["乡镇代码"]
    b = [ali[c] for c in present]
    rows = [f"('a', {i}, {D.q(h)})" for i, h in enumerate(a)] + [f"('b', {i}, {D.q(h)})" for i, h in enumerate(b)]
    return f"hd AS (SELECT * FROM (VALUES {', '.join(rows)}, {_notes_sql()}) v(source, pos, header))"


def _mapping_sql() -> str:
    return (f"mp AS (SELECT source, pos, header, CASE WHEN rn = 1 THEN target END AS target, "
            f"CASE WHEN rn = 1 THEN 'matched' ELSE 'unmapped' END AS status FROM (SELECT hd.*, al.target, "
            f"CASE WHEN al.target IS NOT NULL THEN row_number() OVER (PARTITION BY source, al.target ORDER BY pos) END AS rn "
            f"FROM hd LEFT JOIN al ON al.norm_key = {_norm_sql('header')}))")


register("src_csv", lambda: D.with_clean(
    "SELECT " + ", ".join(f"NULLIF({c}, '') AS {c}" for c in STD) + " FROM rawstd"))(
    lambda spark, sf: csv_ingest(spark, sf).frame.select(*STD))

_BUSINESS = [c for c in CLEAN_COLS if c not in ("_seq", "_source_file", "_source_sheet")]
register("union_sources", lambda: D.with_clean(f"SELECT {', '.join(_BUSINESS)} FROM clean"))(
    lambda spark, sf: C.clean(csv_ingest(spark, sf).frame, CAT, reference=region_reference(spark, sf)).frame.select(*_BUSINESS))


def _ingest_report_sql() -> str:
    req = CAT.required_fields
    missing = "concat_ws(',', " + ", ".join(f"CASE WHEN count(NULLIF({c}, '')) = 0 THEN {D.q(c)} END" for c in req) + ")"
    return D.with_clean(
        # the notes file holds one row, and none without reports
        f"SELECT (SELECT count(*) + least(count(*), 1) FROM rawstd) AS rows_read, (SELECT count(*) FROM rawstd) AS rows_out, m.matched, m.unmapped, "
        f"round(m.matched / greatest(m.matched + m.unmapped, 1), 4) AS matched_rate, "
        f"(SELECT {missing} FROM rawstd) AS missing_required FROM (SELECT count(DISTINCT target) FILTER (WHERE status = 'matched') "
        f"AS matched, count(DISTINCT header) FILTER (WHERE status = 'unmapped') AS unmapped FROM mp) m",
        extra_ctes=f"{_headers_sql()}, {_alias_sql()}, {_mapping_sql()}")


def _ingest_issues_body() -> str:
    req = CAT.required_fields
    missing = "concat_ws(',', " + ", ".join(f"CASE WHEN count(NULLIF({c}, '')) = 0 THEN {D.q(c)} END" for c in req) + ")"
    return (
        "SELECT * FROM (SELECT 'error' AS level, 'SHEET_EMPTY' AS code, (SELECT count(*) FROM (SELECT source FROM mp GROUP BY source "
        "HAVING count(target) = 0)) AS count, '' AS samples UNION ALL "
        f"SELECT 'error', 'MISSING_REQUIRED_FIELD', len(string_split(NULLIF(m, ''), ',')), m FROM (SELECT {missing} AS m FROM rawstd) UNION ALL "
        "SELECT 'warning', 'UNMAPPED_COLUMN', count(*), array_to_string(list(header ORDER BY header)[1:10], ',') "
        "FROM (SELECT DISTINCT header FROM mp WHERE status = 'unmapped')) WHERE count > 0")


def _ingest_issues_sql() -> str:
    return D.with_clean(_ingest_issues_body(), extra_ctes=f"{_headers_sql()}, {_alias_sql()}, {_mapping_sql()}")


register("ingest_issues", _ingest_issues_sql)(lambda spark, sf: ingest_issues(csv_ingest(spark, sf, pinned=False), CAT))

register("ingest_report", _ingest_report_sql)(lambda spark, sf: ingest_report(csv_ingest(spark, sf, pinned=False), CAT))


def _sink_clean(spark, sf):
    path = scratch_path(spark, "sink_clean")
    W.write_clean(clean_table(spark, sf), path)
    return spark.read.parquet(path).select(*CLEAN_COLS)


register("sink_clean", lambda: D.with_clean(f"SELECT {', '.join(CLEAN_COLS)} FROM clean"))(_sink_clean)


def _quality_log(spark, sf):
    res = clean_result(spark, sf)
    path = scratch_path(spark, "quality_log")
    W.write_quality_log(cleaning_audit(res), res.issues(), path, ingest_issues(csv_ingest(spark, sf, pinned=False), CAT))
    return spark.read.parquet(f"{path}/issues")


register("quality_log", lambda: D.with_clean(
    "SELECT 'warning' AS level, 'DATE_PARSE_FAILED' AS code, count_if(_date_raw) - count(occur_date) AS count, '' AS samples "
    "FROM p1 HAVING count_if(_date_raw) - count(occur_date) > 0 UNION ALL "
    f"{_hierarchy_issue_sql()} UNION ALL SELECT * FROM ({_ingest_issues_body()})",
    extra_ctes=f"{_headers_sql()}, {_alias_sql()}, {_mapping_sql()}"))(_quality_log)


# ------------------------------------------------------------ workbooks ----
# The raw reports written as workbooks by Spark tasks, read back
# through the workbook data source (one input partition per workbook).

from .sources.workbook import header_rows, read_rows  # noqa: E402
from .tables import (WORKBOOK_BLOCK_ROWS, WORKBOOK_COVER_SHEET, WORKBOOK_DATA_SHEET,  # noqa: E402
                     WORKBOOK_NOTES_SHEET, WORKBOOK_PLAIN_SHEET, workbook_group_sql, workbook_ingest,
                     workbook_inputs)


def _header_detect(spark, sf):
    return header_rows(read_rows(spark, workbook_inputs(spark, sf))).groupBy("sheet", "header_row").agg(F.count(F.lit(1)).alias("workbooks"))


def _header_detect_sql() -> str:
    blocks = (f"wb AS (SELECT DISTINCT {workbook_group_sql()} AS grp, CAST(floor(_seq / {WORKBOOK_BLOCK_ROWS}) AS BIGINT) AS blk "
              "FROM rawstd)")
    parts = [(WORKBOOK_DATA_SHEET, 0, "a"), (WORKBOOK_COVER_SHEET, 1, "a"), (WORKBOOK_NOTES_SHEET, 0, "a"),
             (WORKBOOK_PLAIN_SHEET, 0, "b")]
    sel = " UNION ALL ".join(
        f"SELECT {D.q(sheet)} AS sheet, {hdr} AS header_row, count(*) AS workbooks FROM wb WHERE grp = '{g}' HAVING count(*) > 0"
        for sheet, hdr, g in parts)
    return D.with_clean(sel, extra_ctes=blocks)


register("header_detect", _header_detect_sql)(_header_detect)

register("src_workbook", lambda: D.with_clean(
    "SELECT " + ", ".join(f"NULLIF({c}, '') AS {c}" for c in STD) + " FROM rawstd "
    "WHERE coalesce(" + ", ".join(f"NULLIF({c}, '')" for c in STD) + ") IS NOT NULL"))(  # a row without any cell is not in a sheet

    lambda spark, sf: workbook_ingest(spark, sf)[0].select(*STD))
