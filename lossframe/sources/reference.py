"""Readers of region names and map features, both from JSON files.

A region file maps codes to names, by kind of region (``provinces``,
``cities``, ``counties``, ``towns``); a feature file is a GeoJSON collection.
Both become rows by exploding what Spark's JSON reader gives; a file that is
not there gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import list_files

# Kinds of regions in a region file with their level and the digits of their codes.
REGION_KINDS = {"provinces": (1, 2), "cities": (2, 4), "counties": (3, 6), "towns": (4, 9)}
_FEATURES = ("features array<struct<properties: struct<name: string, centroid: array<double>, center: array<double>, adcode: string, level: string>, "
             "geometry: struct<type: string>>>")


def read_regions(spark: SparkSession, path: str, kinds: dict[str, tuple[int, int]] = REGION_KINDS) -> DataFrame:
    """``(level, code, name, parent_code)``, a row for each code of the file.

    The parent is the code's own beginning, as long as the codes of the level above;
    names are trimmed, blank ones are null.
    """
    schema = "level int, code string, name string, parent_code string"
    paths = list_files(spark, path)
    if not paths:
        return spark.createDataFrame([], schema)
    maps = spark.read.schema(", ".join(f"`{k}` map<string, string>" for k in kinds)).option("multiLine", True).json(paths)
    above = {level: width for level, width in kinds.values()}
    rows = None
    for kind, (level, _) in kinds.items():
        entry = maps.select(F.lit(level).alias("level"), F.explode(kind).alias("code", "name"))
        code = F.btrim("code")
        width = above.get(level - 1)
        parent = F.when(F.length(code) > width, F.left(code, F.lit(width))) if width else F.lit(None)
        name = F.btrim("name")
        entry = entry.select("level", code.alias("code"), F.when(name != "", name).alias("name"), parent.cast("string").alias("parent_code"))
        rows = entry if rows is None else rows.unionByName(entry)
    return rows


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, name, lon, lat)``, a row for each named feature; ``pos`` is its place in the file.

    The point is the centroid, or the center where there is no centroid; one with fewer than two numbers is none.
    """
    paths = list_files(spark, path)
    if not paths:
        return spark.createDataFrame([], "pos int, name string, lon double, lat double")
    found = spark.read.schema(_FEATURES).option("multiLine", True).json(paths).select(F.posexplode("features").alias("pos", "f"))
    p = F.col("f.properties")
    point = F.when(F.size(p["centroid"]) > 0, p["centroid"]).otherwise(p["center"])
    point = F.when(F.size(point) >= 2, point)
    name = F.btrim(p["name"])
    return found.where(name != "").select("pos", name.alias("name"), F.get(point, F.lit(0)).alias("lon"), F.get(point, F.lit(1)).alias("lat"))


def map_levels(spark: SparkSession, folder: str, names: dict[int, str]) -> DataFrame:
    """``(level, name, installed)``: which levels of the regions have a feature file in ``folder``."""
    rows = [(level, name, bool(list_files(spark, f"{folder.rstrip('/')}/{name}.json"))) for level, name in sorted(names.items())]
    return spark.createDataFrame(rows, "level int, name string, installed boolean")
