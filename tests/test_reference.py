"""Region and feature files; the region drill by code."""

import json

from lossframe.operators import charts
from lossframe.operators.analyze import region_drill
from lossframe.sources.reference import map_levels, read_features, read_regions


def test_regions(spark, tmp_path):
    path = tmp_path / "regions.json"
    path.write_text(json.dumps({"note": "x", "provinces": {"51": "四川省"}, "cities": {"5101": "成都市", "5103": " 自贡市 "},
                                "counties": {"510104": "锦江区", "510302": "", "510303": "市中区", "511102": "市中区"}}, ensure_ascii=False, indent=1), encoding="utf-8")
    got = {(r.level, r.code): (r.name, r.parent_code) for r in read_regions(spark, str(path)).collect()}
    assert got == {(1, "51"): ("四川省", None), (2, "5101"): ("成都市", "51"), (2, "5103"): ("自贡市", "51"), (3, "510104"): ("锦江区", "5101"),
                   (3, "510302"): (None, "5103"), (3, "510303"): ("市中区", "5103"), (3, "511102"): ("市中区", "5111")}
    none = read_regions(spark, str(tmp_path / "absent.json"))
    assert none.columns == ["level", "code", "name", "parent_code"] and none.isEmpty()


def test_features(spark, tmp_path):
    feature = lambda **p: {"type": "Feature", "properties": p, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4]]]}}
    collection = {"type": "FeatureCollection", "features": [
        feature(name="A", center=[1, 2]), feature(name=" A ", centroid=[3.5, 4], center=[9, 9]), feature(name="B", centroid=[], center=[5, 6]),
        feature(name="C", centroid=[7]), feature(name=""), feature(centroid=[1, 1]), {"type": "Feature", "properties": None, "geometry": None}, feature(name="D", centroid=None)]}
    (tmp_path / "map_county.json").write_text(json.dumps(collection, indent=1), encoding="utf-8")
    features = read_features(spark, str(tmp_path / "map_county.json"))
    assert [tuple(r) for r in features.orderBy("pos").collect()] == [(0, "A", 1.0, 2.0), (1, "A", 3.5, 4.0), (2, "B", 5.0, 6.0), (3, "C", None, None), (7, "D", None, None)]
    dim = {r["name"]: (r.lon, r.lat, r.feature_count) for r in charts.geo_dim(features).collect()}
    assert dim == {"A": (1.0, 2.0, 2), "B": (5.0, 6.0, 1), "C": (None, None, 1), "D": (None, None, 1)}
    assert read_features(spark, str(tmp_path / "absent.json")).isEmpty()
    assert [tuple(r) for r in map_levels(spark, str(tmp_path), {3: "map_county", 2: "map_city"}).collect()] == [(2, "map_city", False), (3, "map_county", True)]


def test_drill_keeps_regions_of_one_name_apart(spark):
    rows = [("51", "5101", "510104", "四川省", "成都市", "市中区", "城关镇", 1.0), ("51.0", "5111", "511102", "四川省", "乐山市", "市中区", "城关镇", 2.0),
            ("51", "5111", "511102", "四川", "乐山市", "市中区", "其他", 4.0), (None, None, None, None, None, "市中区", None, 8.0)]
    df = spark.createDataFrame(rows, "province_code string, city_code string, county_code string, province string, city string, county string, town string, deaths double")
    got = {(r.level, r.province_code, r.city_code, r.county_code, r.town): (r["name"], r.records, r.deaths) for r in region_drill(df, ["deaths"]).collect()}
    assert got[0, None, None, None, None] == (None, 4, 15.0)
    assert got[1, "51", None, None, None] == ("四川", 3, 7.0) and got[1, None, None, None, None] == (None, 1, 8.0)
    assert got[3, "51", "5101", "510104", None] == ("市中区", 1, 1.0) and got[3, "51", "5111", "511102", None] == ("市中区", 2, 6.0)
    assert got[4, "51", "5111", "511102", "城关镇"] == ("城关镇", 1, 2.0) and got[4, "51", "5101", "510104", "城关镇"] == ("城关镇", 1, 1.0)
    assert got[3, None, None, None, None] == ("市中区", 1, 8.0) and got[4, None, None, None, None] == (None, 1, 8.0)
