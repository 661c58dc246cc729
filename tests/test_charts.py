from lossframe.operators import charts


def test_geo_dim_takes_the_first_feature_with_a_point(spark):
    features = spark.createDataFrame(
        [(0, "a", None, None), (1, "a", 1.0, 2.0), (2, " a", 3.0, 4.0), (3, "b", None, None), (4, "c", None, 5.0), (5, "c", 6.0, 7.0), (6, " ", 1.0, 1.0)],
        "pos long, name string, lon double, lat double")
    got = {r.name: (r.lon, r.lat, r.feature_count) for r in charts.geo_dim(features).collect()}
    assert got == {"a": (1.0, 2.0, 3), "b": (None, None, 1), "c": (6.0, 7.0, 2)}
