"""Results of several plans from one scan; counts of a result from one scan; nothing parsed or shuffled twice."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lossframe.operators import facts, profile, quality
from lossframe.operators.analyze import AnalysisRequest, aggregate
from lossframe.plans.standard import STANDARD_PLANS, run_plan, run_plans_shared
from lossframe.tables import clean_table, raw_table


@pytest.fixture(scope="module")
def clean(spark, sf):
    return clean_table(spark, sf)


def plan_of(df):
    spark, out = df.sparkSession, io.StringIO()
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        with redirect_stdout(out):
            df.explain()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    return out.getvalue()


def rows(df):
    return sorted(map(repr, df.collect()))


def test_shared_results_equal_single_ones(clean):
    shared = run_plans_shared(clean)
    assert list(shared) == [p.key for p in STANDARD_PLANS]
    for key, res in shared.items():
        one = run_plan(clean, key)
        assert tuple(res.totals.first()) == pytest.approx(tuple(one.totals.first()), nan_ok=True)
        got, want = res.records.collect(), one.records.collect()
        assert len(got) == len(want) and [r[0] for r in got] == [r[0] for r in want]


def test_shared_results_of_no_rows(clean):
    shared = run_plans_shared(clean.where("year < 0"))
    assert quality.dq_totals({k: r for k, r in shared.items() if not r.is_structure}).where("records > 0 or min_total <> 0 or not passed").isEmpty()
    assert shared["loss_structure"].records.count() > 0


def test_one_scan_for_facts_and_counts(clean):
    scans = [line for line in plan_of(facts.fact_conclusion(clean)).splitlines() if "FileScan" in line]
    assert scans and all("_g_county" in line for line in scans)  # all facts read the written groups, none the cleaned rows
    res = aggregate(clean, AnalysisRequest(["region_county"], ["deaths"], {"time_year": [1995, 1996], "disaster_type": "2-HIGH"}))
    assert plan_of(res.meta()).count("FileScan") == 1
    counts = {r.key: r.value for r in res.meta().collect()}
    assert counts == {"rows_input": clean.count(), "rows_after_filter": res.filtered.count(), "record_count": res.groups.count()}
    for request in (AnalysisRequest([], ["deaths"], {"time_year": [1800]}), AnalysisRequest([], ["deaths"]), AnalysisRequest(["time_year"], []),
                    AnalysisRequest(["loss_structure"], [], {"disaster_type": "2-HIGH"})):
        res = aggregate(clean, request)
        assert {r.key: r.value for r in res.meta().collect()} == {
            "rows_input": clean.count(), "rows_after_filter": res.filtered.count(), "record_count": res.groups.count()}


def test_values_are_parsed_after_they_are_counted(spark, sf):
    """Below the first aggregate of the profile no number is read."""
    text = plan_of(profile.profile_columns(raw_table(spark, sf).drop("_seq")))
    first_exchange = text.rindex("Exchange hashpartitioning(field")
    number = [word for word in ("regexp", "RegExp", "double") if word in text[:first_exchange]]
    assert number and not any(word in text[first_exchange:] for word in number)


def test_wide_dimensions_are_not_shuffled_for_hints(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("string").alias("disaster_type"), F.col("id").cast("string").alias("county"),
                                  F.when(F.col("id") % 2 == 0, F.col("id") % 40).cast("int").alias("year"), (F.col("id") % 41).cast("int").alias("month"))
    got = {r.dimension: (r.n, r.hint_values) for r in profile.filter_hints(df).collect()}
    assert got["disaster_type"] == (7, "|".join(map(str, range(7)))) and got["time_year"][0] == 20
    assert not {"region_county", "time_month"} & set(got)
