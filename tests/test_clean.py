"""Cleaning chain invariants and small golden cases."""

from pyspark.sql import functions as F

from lossframe.catalog import DEFAULT_CATALOG as CAT
from lossframe.operators.clean import clean, dedupe_keep_first, to_standard


def _raw(spark, rows):
    cols = ["seq", "disaster_type", "occur_date", "province", "county", "county_code", "province_code",
            "city_code", "direct_economic_loss", "affected_population"]
    return to_standard(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)).withColumn(
        "seq", F.col("seq").cast("long")))


def test_iqr_cap_rules(spark):
    # group A: 8 rows, 7 values 1..7 and one extreme → capped; group B: 7 rows → untouched;
    # group C: 8 rows, seven equal and one extreme → IQR 0 → untouched
    rows = []
    for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 1000]):
        rows.append((str(i), "A", "2021-01-0%d" % (i + 1), "P", f"A{i}", None, None, None, str(v), "10"))
    for i, v in enumerate([1, 2, 3, 4, 5, 6, 1000]):
        rows.append((str(100 + i), "B", "2021-02-0%d" % (i + 1), "P", f"B{i}", None, None, None, str(v), "10"))
    for i, v in enumerate([5, 5, 5, 5, 5, 5, 5, 1000]):
        rows.append((str(200 + i), "C", "2021-03-0%d" % (i + 1), "P", f"C{i}", None, None, None, str(v), "10"))
    res = clean(_raw(spark, rows))
    got = {r["county"]: r["direct_economic_loss"] for r in res.frame.collect()}
    assert got["A7"] == 6.25 + 1.5 * (6.25 - 2.75)   # pandas: Q1 = 2.75, Q3 = 6.25
    assert got["B6"] == 1000.0
    assert got["C7"] == 1000.0


def test_drop_region_fill_type_imputed(spark):
    rows = [("1", None, "2021-05-01", "P", "X", None, None, None, "-", "0"),
            ("2", "洪涝", "bad", "P", None, None, None, None, "5", "1"),
            ("3", "洪涝", "2021-06-01", "P", "Y", "510104.0", "51", "5101", "1,000", "-120")]
    res = clean(_raw(spark, rows))
    out = {r["county"]: r for r in res.frame.collect()}
    assert set(out) == {"X", "Y"}                      # null county dropped
    assert out["X"]["disaster_type"] == "其他"
    assert out["X"]["direct_economic_loss"] == 0.0 and out["X"]["_imputed_metrics"] == 1
    assert out["X"]["season"] == "汛期" and out["X"]["per_capita_level"] == "无受灾人口"
    assert out["Y"]["affected_population"] == 0.0      # low clamp
    assert out["Y"]["county_code"] == "510104" and out["Y"]["_hierarchy_ok"] is True


def test_dedupe_keeps_first_with_null_keys(spark):
    df = spark.createDataFrame([(3, None, "b"), (1, None, "a"), (2, "x", "c")], "_seq long, disaster_type string, v string")
    out = dedupe_keep_first(df, CAT).orderBy("_seq").collect()
    assert [(r["_seq"], r["v"]) for r in out] == [(1, "a"), (2, "c")]


def test_fixture_chain_counts(spark, sf):
    from lossframe.tables import clean_result, clean_table, raw_table
    raw_n = raw_table(spark, sf).count()
    clean_df = clean_table(spark, sf)
    n = clean_df.count()
    assert 0 < n <= raw_n
    bad = clean_df.where(F.greatest(*[F.col(m).isNull() | (F.col(m) < 0) for m in CAT.metric_names])).count()
    assert bad == 0
    audit = {r["step"] for r in clean_result(spark, sf).audit().collect()}
    assert {"normalize_text", "parse_dates", "dedupe_keep_first", "iqr_cap"} <= audit
