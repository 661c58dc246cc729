"""Loss-report fixture derived from the TPC-H-style driver tables.

One SQL text serves Spark and DuckDB: table names are ``{placeholders}``.
Spark fills them with DataFrames (``spark.sql(text, orders=df, ...)``), so
no global temp views are created; DuckDB gets the plain view names. The
view carries every kind of dirt the cleaning chain must handle (unit
suffixes, thousands separators, null tokens, negatives, outliers, four
date styles, bad dates, U+3000 padding, null type/county, wrong names,
wrong code prefixes, trailing ``.0`` codes, zero population, an all-null
metric and exact duplicate rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("orders", "customer", "nation", "region", "lineitem")

INCIDENTS_RAW_SQL = """
WITH li AS (
  SELECT l_orderkey,
         CAST(sum(l_quantity) AS BIGINT) AS qty,
         CAST(floor(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END)) AS BIGINT) AS infra,
         CAST(floor(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END)) AS BIGINT) AS agri,
         CAST(floor(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END)) AS BIGINT) AS housing
  FROM {lineitem} GROUP BY l_orderkey),
b AS (
  SELECT o_orderkey AS k, concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-',
                                 lpad(CAST(day(o_orderdate) AS STRING), 2, '0')) AS ymd, o_orderpriority AS pri, o_orderstatus AS st, o_orderdate AS d,
         CAST(floor(o_totalprice) AS BIGINT) AS v,
         30 + (c_custkey * 7919 + o_orderkey * 31) % 260000 AS n,
         c_custkey % 100 AS cc, n_nationkey AS nk, n_name, r_name,
         lpad(CAST(r_regionkey + 10 AS STRING), 2, '0') AS pcode,
         lpad(CAST(n_nationkey + 10 AS STRING), 2, '0') AS ncode,
         qty, infra, agri, housing
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  LEFT JOIN li ON l_orderkey = o_orderkey),
r AS (
  SELECT k AS seq, concat('R', CAST(k AS STRING)) AS record_id,
    CASE WHEN k % 73 = 0 THEN NULL WHEN k % 31 = 0 THEN concat('　', pri, ' ') ELSE pri END AS disaster_type,
    CASE WHEN k % 503 = 0 THEN 'unknown'
         WHEN k % 37 = 5 THEN concat(ymd, ' 08:30') WHEN k % 37 = 6 THEN concat(replace(ymd, '-', '/'), ' 08:30:15')
         WHEN k % 37 = 7 THEN replace(ymd, '-', '.') WHEN k % 37 = 8 THEN concat(CAST(year(d) AS STRING), '年', CAST(month(d) AS STRING), '月')
         WHEN k % 37 = 9 THEN substr(ymd, 1, 7) WHEN k % 37 = 10 THEN replace(substr(ymd, 1, 7), '-', '/') WHEN k % 37 = 11 THEN substr(ymd, 1, 4)
         WHEN k % 37 = 12 THEN '44927' WHEN k % 37 = 13 THEN '20:15' WHEN k % 37 = 14 THEN concat(ymd, 'T23:59:59')
         WHEN k % 16 = 0 THEN concat(CAST(year(d) AS STRING), '年', CAST(month(d) AS STRING), '月', CAST(day(d) AS STRING), '日')
         WHEN k % 20 = 1 THEN concat(CAST(year(d) AS STRING), '/', CAST(month(d) AS STRING), '/', CAST(day(d) AS STRING))
         WHEN k % 20 = 2 THEN concat(CAST(year(d) AS STRING), lpad(CAST(month(d) AS STRING), 2, '0'), lpad(CAST(day(d) AS STRING), 2, '0'))
         ELSE concat(CAST(year(d) AS STRING), '-', lpad(CAST(month(d) AS STRING), 2, '0'), '-', lpad(CAST(day(d) AS STRING), 2, '0')) END AS occur_date,
    st AS emergency_level, r_name AS province, pcode AS province_code, n_name AS city, concat(pcode, ncode) AS city_code,
    CASE WHEN k % 1009 = 0 THEN NULL WHEN k % 89 = 0 THEN 'WrongName' ELSE concat('C', CAST(nk AS STRING), '-', CAST(cc AS STRING)) END AS county,
    CASE WHEN k % 97 = 0 THEN concat('9999', lpad(CAST(cc AS STRING), 2, '0'))
         WHEN k % 41 = 0 THEN concat(pcode, ncode, lpad(CAST(cc AS STRING), 2, '0'), '.0')
         ELSE concat(pcode, ncode, lpad(CAST(cc AS STRING), 2, '0')) END AS county_code,
    CASE WHEN k % 59 = 0 THEN concat('T"', CAST(k % 7 AS STRING), '", x') WHEN k % 61 = 0 THEN concat('T', chr(10), CAST(k % 7 AS STRING))
         ELSE concat('T', CAST(k % 7 AS STRING)) END AS town,
    concat(pcode, ncode, lpad(CAST(cc AS STRING), 2, '0'), lpad(CAST(k % 7 AS STRING), 3, '0')) AS town_code,
    CASE WHEN k % 4 <> 0 THEN concat('V', CAST(k % 11 AS STRING)) END AS village, CASE WHEN k % 4 = 1 THEN CAST(k % 11 AS STRING) END AS village_code,
    CASE WHEN k % 17 = 1 THEN '-' WHEN k % 17 = 2 THEN NULL WHEN k % 17 = 3 THEN ''
         WHEN k % 401 = 0 THEN '-120' WHEN k % 997 = 5 THEN '999999999'
         WHEN k % 50 = 7 THEN CAST(v * 20 AS STRING)
         WHEN k % 12 = 0 THEN concat(CAST(CAST(floor(v / 10000) AS BIGINT) AS STRING), '亿元')
         WHEN k % 13 = 5 THEN concat(CAST(v AS STRING), '万元')
         WHEN k % 19 = 4 THEN concat(CAST(v * 10000 AS STRING), '元')
         WHEN k % 29 = 4 AND v >= 1000 THEN concat(CAST(CAST(floor(v / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(v % 1000 AS STRING), 3, '0'))
         ELSE CAST(v AS STRING) END AS direct_economic_loss,
    CASE WHEN k % 211 = 0 THEN '0' WHEN k % 307 = 0 THEN '-120' WHEN k % 8 = 0 THEN concat(CAST(n AS STRING), '人')
         WHEN k % 9 = 0 THEN concat(CAST(CAST(floor(n / 10000) AS BIGINT) AS STRING), '万人') ELSE CAST(n AS STRING) END AS affected_population,
    CAST(k % 27 AS STRING) AS deaths, CAST(k % 91 AS STRING) AS injured, CAST(k % 3 AS STRING) AS missing,
    CASE WHEN k % 5 = 0 THEN CAST(k % 401 AS STRING) || '人' ELSE CAST(k % 401 AS STRING) END AS evacuated,
    CASE WHEN k % 6 <> 0 THEN CAST(k % 13 AS STRING) END AS collapsed_houses, CAST(k % 53 AS STRING) AS damaged_houses,
    CASE WHEN k % 23 = 1 THEN CAST(infra AS STRING) || '元' ELSE CAST(infra AS STRING) END AS infrastructure_loss, CAST(agri AS STRING) AS agriculture_loss, CAST(housing AS STRING) AS housing_loss,
    CASE WHEN k % 16 = 3 THEN CAST(qty * 15 AS STRING) || '亩' WHEN k % 16 = 4 THEN CAST(qty AS STRING) || '公顷'
         WHEN k % 16 = 5 THEN CAST(qty AS STRING) || '千公顷' WHEN k % 16 = 6 THEN CAST(qty AS STRING) || '万亩' ELSE CAST(qty AS STRING) END AS affected_crop_area,
    CASE WHEN k % 5 = 0 THEN CAST(qty AS STRING) || '公顷' END AS destroyed_crop_area
  FROM b)
SELECT * FROM r UNION ALL
SELECT seq + 1000000000 AS seq, {columns} FROM r WHERE seq % 300 = 0 UNION ALL
SELECT seq + 2000000000 AS seq, {nulls} FROM r WHERE seq % 500 = 0
"""

# Columns of the view after ``seq``; rows repeated whole and rows without any value list them.
INCIDENT_COLUMNS = ("record_id disaster_type occur_date emergency_level province province_code city city_code county county_code town town_code "
                    "village village_code direct_economic_loss affected_population deaths injured missing evacuated collapsed_houses damaged_houses "
                    "infrastructure_loss agriculture_loss housing_loss affected_crop_area destroyed_crop_area").split()
INCIDENTS_RAW_SQL = INCIDENTS_RAW_SQL.replace("{columns}", ", ".join(INCIDENT_COLUMNS)).replace(
    "{nulls}", ", ".join(f"CAST(NULL AS STRING) AS {c}" for c in INCIDENT_COLUMNS))

# Questions: the conversations' texts, with words of the tagging rules added
# by conv_id and turn, so that every rule, cut and filter occurs.
QUESTION_WORDS = ("结构 占比 构成 比重 汛期 季节 等级 级别 响应 年份 每年 逐年 趋势 年际 季度 月份 月度 逐月 日 逐日 县 县域 区县 市 市州 乡 镇 村落 灾种 灾害类型 "
                  "哪类灾害 人口 人 伤亡 面积 农作物 房屋 倒房 洪涝 干旱 地震 地质灾害 风雹 低温冷冻 雪灾 森林火灾 特别重大 重大 较大 一般 无").split()


def _word(pick: str) -> str:
    return f"CASE ({pick}) % {len(QUESTION_WORDS)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(QUESTION_WORDS)) + " END"


QUESTIONS_SQL = ("SELECT conv_id, turn, text || ' ' || " + _word("conv_id * 7 + turn") + " || ' ' || " + _word("conv_id * 3 + turn * 5 + 31")
                 + " || ' ' || " + _word("conv_id * 11 + turn * 13 + 8") + " AS text FROM {conversations}")

# Administrative reference: level 1 = region (province), level 2 = nation
# (city), level 3 = nation × customer bucket (county), by the same rule the
# fixture uses before dirt is injected.
REGION_DIM_SQL = """
SELECT DISTINCT 1 AS level, lpad(CAST(r_regionkey + 10 AS STRING), 2, '0') AS code, r_name AS name
FROM {region}
UNION ALL
SELECT DISTINCT 2 AS level,
       lpad(CAST(r_regionkey + 10 AS STRING), 2, '0') || lpad(CAST(n_nationkey + 10 AS STRING), 2, '0') AS code,
       n_name AS name
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT DISTINCT 3 AS level,
       lpad(CAST(r_regionkey + 10 AS STRING), 2, '0') || lpad(CAST(n_nationkey + 10 AS STRING), 2, '0')
         || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') AS code,
       'C' || CAST(n_nationkey AS STRING) || '-' || CAST(c_custkey % 100 AS STRING) AS name
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Map features at county level: one per county name except every tenth
# bucket (so that unmatched and missing sets are non-empty), plus a second
# feature for some names (duplicate names, first centroid wins).
GEO_FEATURES_SQL = """
WITH c AS (
  SELECT DISTINCT n_nationkey AS nk, c_custkey % 100 AS cc
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey)
SELECT CAST(nk * 100 + cc AS BIGINT) AS pos,
       'C' || CAST(nk AS STRING) || '-' || CAST(cc AS STRING) AS name,
       CAST(100.0 + nk * 0.25 + cc * 0.01 AS DOUBLE) AS lon, CAST(25.0 + cc * 0.05 AS DOUBLE) AS lat
FROM c WHERE cc % 10 <> 0
UNION ALL
SELECT CAST(100000 + nk * 100 + cc AS BIGINT) AS pos,
       'C' || CAST(nk AS STRING) || '-' || CAST(cc AS STRING) AS name,
       CAST(101.0 + nk * 0.25 AS DOUBLE) AS lon, CAST(26.0 + cc * 0.05 AS DOUBLE) AS lat
FROM c WHERE cc % 45 = 1
"""


def duckdb_sql(template: str) -> str:
    """The template with plain table names, for DuckDB."""
    names = {t: t for t in ("orders", "customer", "nation", "region", "lineitem", "conversations")}
    return template.format(**names)


def read_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet") for name in names}


def incidents_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loss-report rows (all text) with ``seq`` as input order."""
    return spark.sql(INCIDENTS_RAW_SQL, **read_tables(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, text)`` question table."""
    return spark.sql(QUESTIONS_SQL, **read_tables(spark, sf_dir, ("conversations",)))


def region_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(level INT, code STRING, name STRING)`` administrative reference."""
    t = read_tables(spark, sf_dir, ("customer", "nation", "region"))
    return spark.sql(REGION_DIM_SQL, **t)


def geo_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, name, lon, lat)`` map features, ``pos`` = position in the file."""
    t = read_tables(spark, sf_dir, ("customer", "nation"))
    return spark.sql(GEO_FEATURES_SQL, **t)
