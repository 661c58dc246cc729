"""Keyword tagging of a question table into analysis requests.

Runs over any table with a text column: every rule is a ``contains`` test,
so the whole job is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import DEFAULT_CATALOG, Catalog

# Keyword rules in rule order (order fixes output order).
DIMENSION_RULES: list[tuple[str, list[str]]] = [
    ("loss_structure", ["结构", "占比", "构成", "比重"]),
    ("custom_season", ["汛期", "季节"]),
    ("emergency_level", ["等级", "级别", "响应"]),
    ("time_year", ["年份", "每年", "逐年", "趋势", "年际"]),
    ("time_quarter", ["季度"]),
    ("time_month", ["月份", "月度", "逐月"]),
    ("time_day", ["日", "逐日"]),
    ("region_county", ["县", "县域", "区县"]),
    ("region_city", ["市", "市州"]),
    ("region_town", ["乡", "镇", "村落"]),
    ("disaster_type", ["灾种", "灾害类型", "哪类灾害"]),   # only when loss_structure did not fire
]
METRIC_RULES: list[tuple[list[str], list[str]]] = [
    (["人口", "人", "伤亡"], ["affected_population", "deaths"]),
    (["面积", "农作物"], ["affected_crop_area"]),
    (["房屋", "倒房"], ["collapsed_houses"]),
]
TYPE_KEYWORDS = ["洪涝", "干旱", "地震", "地质灾害", "风雹", "低温冷冻", "雪灾", "森林火灾"]
LEVEL_KEYWORDS = ["特别重大", "重大", "较大", "一般"]
DEFAULT_METRIC = "direct_economic_loss"
DEFAULT_DIMENSION = "time_year"


def _any(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.coalesce(text.contains(w), F.lit(False))
    return cond


def _first(text: Column, words: list[str]) -> Column:
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words], F.lit(None).cast("string"))


def tag_questions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``dims`` (≤2), ``metrics`` (≤3), ``filter_type``, ``filter_level``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    structure = _any(text, DIMENSION_RULES[0][1])
    dims = []
    for name, words in DIMENSION_RULES:
        cond = _any(text, words)
        if name == "disaster_type":
            cond = cond & ~structure
        dims.append(F.when(cond, F.lit(name)))
    dim_arr = F.array_compact(F.array(*dims))
    metrics = F.flatten(F.array(*[F.when(_any(text, words), F.array(*[F.lit(m) for m in ms]))
                                  .otherwise(F.array().cast("array<string>")) for words, ms in METRIC_RULES]))
    metrics = F.when(F.size(metrics) == 0, F.array(F.lit(DEFAULT_METRIC))).otherwise(metrics)
    dim_arr = F.when(F.size(dim_arr) == 0, F.array(F.lit(DEFAULT_DIMENSION))).otherwise(dim_arr)
    return df.select("*", F.slice(dim_arr, 1, 2).alias("dims"), F.slice(metrics, 1, 3).alias("metrics"),
                     _first(text, TYPE_KEYWORDS).alias("filter_type"), _first(text, LEVEL_KEYWORDS).alias("filter_level"))


def sanitize_plans(tagged: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Keep registered names (order kept), defaults, at most 2 + 2."""
    dims = F.array_intersect(F.col("dims"), F.array(*[F.lit(d) for d in catalog.dimensions]))
    mets = F.array_intersect(F.col("metrics"), F.array(*[F.lit(m) for m in catalog.metrics]))
    dims = F.when(F.size(dims) == 0, F.array(F.lit(DEFAULT_DIMENSION))).otherwise(dims)
    mets = F.when(F.size(mets) == 0, F.array(F.lit(DEFAULT_METRIC))).otherwise(mets)
    return tagged.withColumn("dims", F.slice(dims, 1, 2)).withColumn("metrics", F.slice(mets, 1, 2))
