"""Golden rows for the column expressions (one per edge-case decision)."""

from pyspark.sql import functions as F

from lossframe.catalog import DEFAULT_CATALOG as CAT
from lossframe.functions import exprs as X


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"c {dtype}")
    return df.select(expr(F.col("c")).alias("r")).first()["r"]


def test_normalize_text_unicode_space(spark):
    assert one(spark, X.normalize_text, "　洪 涝 ") == "洪涝"
    assert one(spark, X.normalize_text, " - ") is None
    assert one(spark, X.normalize_text, "不详") is None


def test_quantity_examples(spark):
    money = CAT.metric("direct_economic_loss").units
    people = CAT.metric("affected_population").units
    area = CAT.metric("affected_crop_area").units
    q = lambda units: (lambda c: X.parse_quantity(c, units))
    assert one(spark, q(money), "3.2亿元") == 32000.0
    assert one(spark, q(people), "1,234人") == 1234.0
    assert one(spark, q(people), "-") is None
    assert one(spark, q(money), "12.5") == 12.5
    assert one(spark, X.parse_number, "10-20") == 10.0
    assert one(spark, X.parse_number, "1e5") == 1.0
    assert one(spark, X.parse_number, "万元") is None
    assert one(spark, q(area), "5千公顷") == 5.0
    assert abs(one(spark, q(area), "5公顷") - 0.005) < 1e-12
    assert one(spark, q(people), "１２3人") == 123.0


def test_dates(spark):
    fmts = CAT.rules["date_formats"]
    p = lambda c: X.parse_date(c, fmts)
    for text in ["2021-03-05", "2021-3-5", "2021年3月5日", "2021/3/5", "20210305"]:
        assert str(one(spark, p, text)) == "2021-03-05 00:00:00"
    assert str(one(spark, p, "2021-03")) == "2021-03-01 00:00:00"
    assert one(spark, p, "unknown") is None
    assert X.java_pattern("%Y%m%d") == "yyyyMMdd"


def test_season_and_band(spark):
    assert one(spark, lambda c: X.season(c, [5, 6, 7, 8, 9]), None, "int") == "非汛期"
    bins, labels = CAT.rules["per_capita_loss_bins"], CAT.rules["per_capita_loss_labels"]
    df = spark.createDataFrame([(5.0, 0.0), (200000.0, 1.0), (0.5, 1.0), (0.49, 1.0)], "l double, p double")
    got = [r[0] for r in df.select(X.per_capita_band("l", "p", bins, labels)).collect()]
    assert got == ["无受灾人口", "无受灾人口", "0.5-2万元", "低于0.5万元"]


def test_codes_and_format(spark):
    assert one(spark, X.normalize_code, "510104.0") == "510104"
    assert one(spark, X.format_value, 12345.678, "double") == "12,346"
    assert one(spark, X.format_value, 12.0, "double") == "12"
    assert one(spark, X.format_value, 12.345, "double") == "12.35"


def test_date_times_serials_and_times(spark):
    import datetime as dt
    d = lambda c: X.parse_date(c, CAT.rules["date_formats"])
    assert one(spark, d, "2021/5/3 08:30") == dt.datetime(2021, 5, 3, 8, 30)
    assert one(spark, d, "2021-05-03T23:59:59") == dt.datetime(2021, 5, 3, 23, 59, 59)
    assert one(spark, d, "2021年5月3日 8:30") == dt.datetime(2021, 5, 3, 8, 30)
    assert one(spark, d, "44927") is None and one(spark, d, "20:15") is None and one(spark, d, "2021.5.3") == dt.datetime(2021, 5, 3)
