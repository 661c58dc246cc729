"""Aggregation entry point: filters, ordering, limits, loss structure."""

import pytest

from lossframe.operators.analyze import AnalysisRequest, aggregate
from lossframe.plans.standard import STANDARD_PLANS, run_all_shared, run_plan


@pytest.fixture(scope="module")
def clean(spark, sf):
    from lossframe.tables import clean_table
    return clean_table(spark, sf)


def test_ten_plans_non_empty_non_negative(clean):
    assert len(STANDARD_PLANS) == 10
    for p in STANDARD_PLANS:
        res = run_plan(clean, p.key)
        assert res.records.count() > 0
        tot = res.totals.first()
        assert all(v is None or v >= 0 for v in tot.asDict().values())


def test_filters(clean):
    res = aggregate(clean, AnalysisRequest(["time_year"], ["direct_economic_loss"],
                                           {"disaster_type": "no-such", "time_year": "1995"}))
    assert res.ignored_filters == ["disaster_type=no-such (no matching rows)"]
    assert [r["year"] for r in res.records.collect()] == [1995]
    empty = aggregate(clean, AnalysisRequest(["time_year"], ["direct_economic_loss"], {"disaster_type": ["no-such"]}))
    assert empty.records.count() == 0


def test_unknown_names_raise(clean):
    with pytest.raises(KeyError):
        aggregate(clean, AnalysisRequest(["nope"], ["direct_economic_loss"]))


def test_custom_dimensions(clean):
    seasons = {r["season"] for r in run_plan(clean, "by_season").records.collect()}
    assert seasons <= {"汛期", "非汛期"} and seasons
    ls = run_plan(clean, "loss_structure").records.collect()
    assert len(ls) == 5
    assert abs(sum(r["share"] for r in ls if r["share"] is not None) - 1.0) < 1e-3


def test_shared_scan_equals_single_plans(clean):
    shared = run_all_shared(clean)
    for p in STANDARD_PLANS:
        a = run_plan(clean, p.key).records
        b = shared[p.key]
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect())), p.key


def test_order_temporal_nulls_last(clean):
    years = [r["year"] for r in run_plan(clean, "yearly_trend").records.collect()]
    non_null = [y for y in years if y is not None]
    assert non_null == sorted(non_null) and (years[-1] is None or None not in years)


def test_global_aggregate_of_no_rows(clean):
    res = aggregate(clean, AnalysisRequest([], ["direct_economic_loss"], {"disaster_type": ["no-such"]}))
    assert res.records.count() == 0
    assert aggregate(clean, AnalysisRequest([], ["direct_economic_loss"])).records.count() == 1


def test_virtual_filter_is_skipped_and_labels(clean):
    res = aggregate(clean, AnalysisRequest(["time_year"], ["direct_economic_loss"], {"loss_structure": "x"}), labels=True)
    assert not res.ignored_filters and res.filtered.count() == clean.count()
    assert res.records.columns == [c["label"] for c in res.columns]


def test_overview_of_raw_and_of_nothing(spark, sf, clean):
    from lossframe.operators.profile import overview_kpis
    from lossframe.tables import raw_table
    raw = overview_kpis(raw_table(spark, sf)).first()
    assert raw.records == raw_table(spark, sf).count() and raw.period_start < raw.period_end and raw.total_direct_economic_loss > 0
    none = overview_kpis(clean.limit(0)).first()
    assert none.records == 0 and none.mean_direct_loss is None


def test_facts_use_all_groups(clean):
    """A map shows every county with data, however many the plan's own output has."""
    assert run_plan(clean, "county_choropleth", cut=False).records.count() == clean.select("county").distinct().count()
    assert run_plan(clean, "county_choropleth").records.count() <= 200
