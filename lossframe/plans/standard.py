"""The ten standard analyses and a shared-scan runner for them.

Each plan is an ``AnalysisRequest``. ``run_plan`` evaluates one; the
shared-scan runner answers every non-virtual plan from one
``GROUPING SETS`` aggregate (one scan, one shuffle) and splits the result
by ``grouping_id``, which tells a real null key from a rolled-up one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DEFAULT_CATALOG, Catalog
from ..operators.analyze import AnalysisRequest, AnalysisResult, aggregate, loss_structure, order_columns, structure_groups
from ..session import materialize


@dataclass(frozen=True)
class Plan:
    key: str
    title: str
    dimensions: tuple[str, ...]
    metrics: tuple[str, ...]
    limit: int = 40

    def request(self, cut: bool = True) -> AnalysisRequest:
        return AnalysisRequest(list(self.dimensions), list(self.metrics), limit=self.limit if cut else None)


# The standard plan list (keys, dimensions, metrics, limits).
STANDARD_PLANS: tuple[Plan, ...] = (
    Plan("by_disaster_type", "Direct loss by event type", ("disaster_type",), ("direct_economic_loss",)),
    Plan("yearly_trend", "Direct loss by year", ("time_year",), ("direct_economic_loss",)),
    Plan("yearly_trend_by_type", "Direct loss by year and type", ("time_year", "disaster_type"), ("direct_economic_loss",), 100),
    Plan("county_ranking", "Direct loss by county", ("region_county",), ("direct_economic_loss",), 20),
    Plan("loss_structure", "Loss structure", ("loss_structure",), ()),
    Plan("county_choropleth", "Direct loss by county (map)", ("region_county",), ("direct_economic_loss",), 200),
    Plan("county_heatmap", "Direct loss by county (heat points)", ("region_county",), ("direct_economic_loss",), 200),
    Plan("by_season", "Flood vs non-flood season", ("custom_season",), ("direct_economic_loss", "affected_population")),
    Plan("per_capita_level", "Per-capita loss bands", ("custom_per_capita",), ("direct_economic_loss",)),
    Plan("type_level_matrix", "Type × emergency level", ("disaster_type", "emergency_level"), ("direct_economic_loss",), 100),
)

PLANS_BY_KEY = {p.key: p for p in STANDARD_PLANS}


def run_plan(clean_df: DataFrame, key: str, catalog: Catalog = DEFAULT_CATALOG, cut: bool = True) -> AnalysisResult:
    """A plan's result; ``cut=False`` keeps all groups, for facts, charts and maps drawn from it."""
    return aggregate(clean_df, PLANS_BY_KEY[key].request(cut), catalog)


def run_plans_shared(clean_df: DataFrame, catalog: Catalog = DEFAULT_CATALOG, plans: tuple[Plan, ...] = STANDARD_PLANS,
                     pin: bool = True, cut: bool = True) -> dict[str, AnalysisResult]:
    """Results of all plans, their totals too, from one ``GROUPING SETS`` aggregate.

    With ``pin`` that aggregate runs once, here, and is written to the
    checkpoint folder (its size is the number of groups, not rows); records,
    totals and the loss structure read that small table instead of re-running
    the scan and shuffle. The empty set holds the totals.
    """
    grouped = [p for p in plans if not any(catalog.dimension(d).is_virtual for d in p.dimensions)]
    fields = sorted({catalog.dimension(d).field for p in grouped for d in p.dimensions})
    metrics = {m for p in grouped for m in p.metrics}
    if len(grouped) < len(plans):
        metrics |= {m for _, ms in structure_groups(catalog, clean_df.columns) for m in ms}
    sets = [()]
    for p in grouped:
        s = tuple(sorted(catalog.dimension(d).field for d in p.dimensions))
        if s not in sets:
            sets.append(s)
    set_sql = ", ".join("(" + ", ".join(f"`{f}`" for f in s) + ")" for s in sets)
    select = [f"`{f}`" for f in fields] + [f"grouping(`{f}`) AS `_g_{f}`" for f in fields] + [f"coalesce(sum(`{m}`), 0D) AS `{m}`" for m in sorted(metrics)]
    shared = clean_df.sparkSession.sql(f"SELECT {', '.join(select)} FROM {{df}} GROUP BY GROUPING SETS ({set_sql})", df=clean_df)
    if pin:
        shared = materialize(shared, "plan-groups")

    def of(own: list[str]) -> DataFrame:
        cond = F.lit(True)
        for f in fields:
            cond = cond & (F.col(f"_g_{f}") == (0 if f in own else 1))
        return shared.where(cond)

    # one row, of zeros for no rows at all
    sums = of([]).agg(*[F.coalesce(F.max(m), F.lit(0.0)).alias(m) for m in sorted(metrics)])
    out: dict[str, AnalysisResult] = {}
    for p in plans:
        req = p.request(cut)
        if p not in grouped:
            out[p.key] = loss_structure(clean_df, catalog, request=req, sums=sums)
            continue
        own = [catalog.dimension(d).field for d in p.dimensions]
        groups = of(own).select(*own, *p.metrics)
        records = groups.orderBy(*order_columns(req, catalog, own, list(p.metrics)))
        out[p.key] = AnalysisResult(req, records.limit(p.limit) if cut else records, sums.select(*[F.round(m, 4).alias(m) for m in p.metrics]), groups,
                                    clean_df, clean_df, [], [], group_fields=own)
    return out


def run_all_shared(clean_df: DataFrame, catalog: Catalog = DEFAULT_CATALOG, plans: tuple[Plan, ...] = STANDARD_PLANS, pin: bool = True) -> dict[str, DataFrame]:
    """Ordered, limited record frames of all plans from one scan."""
    return {k: r.records for k, r in run_plans_shared(clean_df, catalog, plans, pin).items()}
