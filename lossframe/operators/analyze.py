"""One aggregation entry point: dimensions × metrics with filters, order, limit.

``aggregate(clean_df, AnalysisRequest(...))`` builds a lazy plan:
filter → group-by (partial + final hash aggregate) → order → limit
(``TakeOrderedAndProject``), plus a totals aggregate that the limit does not
touch. A virtual dimension (loss structure) short-circuits to
``loss_structure``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import AMOUNT_UNIT, DEFAULT_CATALOG, PEOPLE_UNIT, Catalog


@dataclass
class AnalysisRequest:
    dimensions: list[str]
    metrics: list[str]
    filters: dict[str, Any] = field(default_factory=dict)
    limit: int | None = 50      # None: every group, no top-n cut
    sort_by: str | None = None
    ascending: bool = False


@dataclass
class AnalysisResult:
    request: AnalysisRequest
    records: DataFrame          # ordered, limited
    totals: DataFrame           # one row, metric → rounded sum over all filtered rows
    groups: DataFrame           # all groups, before order and limit
    filtered: DataFrame
    source: DataFrame
    ignored_filters: list[str]
    columns: list[dict[str, Any]]
    is_structure: bool = False
    predicate: Column | None = None  # of the filters in force
    group_fields: list[str] | None = None  # None: the number of groups does not depend on rows,
    structure: list | None = None          # but is that of these loss groups, or none without metrics

    def meta(self) -> DataFrame:
        """``(key, value)`` rows: rows in, rows after filter, groups; one scan, with
        the rows of each group counted before and after the filters."""
        kept = self.predicate if self.predicate is not None else F.lit(True)
        counts = [F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("kept")]
        by = self.source.groupBy(*self.group_fields).agg(*counts) if self.group_fields else self.source.agg(*counts)
        groups = F.count_if(F.col("kept") > 0) if self.group_fields is not None else F.lit(len(self.structure or []))
        total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), groups.cast("long").alias("groups"))
        return total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("long").alias("value"))
                                               for k, c in (("rows_input", "n"), ("rows_after_filter", "kept"), ("record_count", "groups"))])))


# ------------------------------------------------------------- filters ----

def _filter_field(key: str, catalog: Catalog) -> tuple[str | None, bool]:
    """(field, is_virtual) for a filter key that names a dimension or field."""
    if key in catalog.dimensions:
        d = catalog.dimensions[key]
        return d.field, d.is_virtual
    return key, False


def apply_filters(df: DataFrame, filters: dict[str, Any], catalog: Catalog = DEFAULT_CATALOG
                  ) -> tuple[DataFrame, list[str], Column | None]:
    """A1–A3: equality / IN filters, applied in order.

    A scalar that matches no row of the already-filtered data is ignored and
    reported (one ``limit(1)`` probe each); a list/tuple/set is an IN filter
    and is never ignored; virtual-dimension filters are skipped. The
    literal is compared as the column's type (``"2021"`` matches year 2021).
    The probe reads one matching row at most, and the filters that stay are
    plain comparisons, so they prune partitions and reach the scan. Also
    returns the filters in force as one predicate.
    """
    data = df
    predicate: Column | None = None

    def add(condition: Column) -> None:
        nonlocal data, predicate
        data = data.where(condition)
        predicate = condition if predicate is None else predicate & condition

    ignored: list[str] = []
    for key, value in filters.items():
        name, virtual = _filter_field(key, catalog)
        if virtual:
            continue
        if name is None or name not in data.columns:
            ignored.append(f"{key}={value} (no such field)")
            continue
        column = F.col(name)
        if isinstance(value, (list, tuple, set)):
            add(column.isin(list(value)))
            continue
        same = column == F.lit(value).try_cast(dict(data.dtypes)[name])  # a typed literal is pushed into the scan
        if data.where(same).isEmpty():
            ignored.append(f"{key}={value} (no matching rows)")
            continue
        add(same)
    return data, ignored, predicate


# ------------------------------------------------------------ ordering ----

def order_columns(request: AnalysisRequest, catalog: Catalog, dim_fields: list[str],
                  metric_cols: list[str]) -> list[Column]:
    """A7/A8 ordering as sort keys, ending with every group key so ties are
    deterministic (the group-by's own key order)."""
    keys: list[Column] = []
    labels = catalog.labels

    def resolve(name: str) -> str | None:
        for dim, f in zip(request.dimensions, dim_fields):
            if name in (dim, f, labels.get(dim)):
                return f
        for m in metric_cols:
            if name in (m, labels.get(m)):
                return m
        return None

    if request.sort_by:
        target = resolve(request.sort_by)
        if target is not None:
            c = F.coalesce(F.col(target), F.lit(0)) if target in metric_cols else F.col(target)
            keys.append(c.asc_nulls_last() if request.ascending else c.desc_nulls_last())
    if dim_fields:
        first = catalog.dimension(request.dimensions[0])
        f0 = F.col(dim_fields[0])
        if first.kind == "temporal":
            keys.append(f0.asc_nulls_last())
        elif first.order:
            pos = F.array_position(F.array(*[F.lit(v) for v in first.order]), f0.cast("string"))
            keys.append(F.when(pos > 0, pos).otherwise(F.lit(len(first.order) + 1)).asc())
        elif metric_cols:
            m0 = F.coalesce(F.col(metric_cols[0]), F.lit(0))
            keys.append(m0.asc() if request.ascending else m0.desc())
    keys += [F.col(f).asc_nulls_last() for f in dim_fields]
    return keys


# ----------------------------------------------------------- aggregate ----

def aggregate(df: DataFrame, request: AnalysisRequest, catalog: Catalog = DEFAULT_CATALOG,
              labels: bool = False) -> AnalysisResult:
    """The single group-by entry point.

    Group keys keep nulls; the sum of an all-null group is 0. With
    ``labels=True`` output columns carry display labels (A6).
    """
    dims = [catalog.dimension(n) for n in request.dimensions]      # A12: unknown → KeyError
    metrics = [catalog.metric(n) for n in request.metrics]
    filtered, ignored, predicate = apply_filters(df, request.filters, catalog)

    if any(d.is_virtual for d in dims):
        out = loss_structure(df, catalog, request=request, filtered=filtered, ignored=ignored)
        out.predicate = predicate
        return out

    dim_fields = [d.field for d in dims]
    metric_cols = [m.name for m in metrics]
    sums = [F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in metric_cols]
    if not metric_cols:
        groups = filtered.select(*dim_fields).limit(0)
    elif dim_fields:
        groups = filtered.groupBy(*dim_fields).agg(*sums)
    else:  # no record for no rows
        groups = filtered.agg(*sums, F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0).drop("_n")
    keys = order_columns(request, catalog, dim_fields, metric_cols)
    records = groups.orderBy(*keys) if keys else groups
    if request.limit is not None:
        records = records.limit(request.limit)
    totals = filtered.agg(*[F.round(F.coalesce(F.sum(m), F.lit(0.0)), 4).alias(m) for m in metric_cols]) \
        if metric_cols else filtered.agg(F.count(F.lit(1)).alias("rows")).select()
    columns = [{"key": f, "role": "dimension", "label": d.label} for d, f in zip(dims, dim_fields)]
    columns += [{"key": m.name, "role": "metric", "label": m.label, "unit": m.unit} for m in metrics]
    if labels:
        mapping = {d.field: d.label for d in dims} | {m.name: m.label for m in metrics}
        records = records.select(*[F.col(c).alias(mapping.get(c, c)) for c in records.columns])
        totals = totals.select(*[F.col(c).alias(mapping.get(c, c)) for c in totals.columns])
    return AnalysisResult(request, records, totals, groups, filtered, df, ignored, columns, predicate=predicate,
                          group_fields=dim_fields if metric_cols else None)


def structure_groups(catalog: Catalog, columns: list[str]) -> list[tuple]:
    """(loss group, its metrics that are present) of the groups with any."""
    groups = [(g, [m for m in g.metrics if m in columns]) for g in catalog.loss_groups]
    return [(g, ms) for g, ms in groups if ms]


def loss_structure(df: DataFrame, catalog: Catalog = DEFAULT_CATALOG, request: AnalysisRequest | None = None,
                   filtered: DataFrame | None = None, ignored: list[str] | None = None, sums: DataFrame | None = None) -> AnalysisResult:
    """One row per loss group: ``pos, loss_type, value, unit, share``.

    ``value`` = sum over the group's metrics, rounded to 4 places; ``share``
    only within the amount unit (万元), null elsewhere or when the amount
    total is 0. Direct loss and its parts are all amounts, so shares
    double-count by design of the groups. ``sums``, one row of the metrics'
    sums, spares the scan.
    """
    request = request or AnalysisRequest(["loss_structure"], [])
    filtered = df if filtered is None else filtered
    groups = structure_groups(catalog, filtered.columns)
    needed = sorted({m for _, ms in groups for m in ms})
    if sums is None:
        sums = filtered.agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in needed])
    rows = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(g.name).alias("loss_type"),
                 F.round(sum((F.col(m) for m in ms[1:]), F.col(ms[0])), 4).alias("value"),
                 F.lit(g.unit).alias("unit"))
        for i, (g, ms) in enumerate(groups)
    ])
    long = sums.select(F.inline(rows))
    amount_total = F.sum(F.when(F.col("unit") == AMOUNT_UNIT, F.col("value"))).over(Window.partitionBy())
    share = F.when((F.col("unit") == AMOUNT_UNIT) & (amount_total != 0), F.round(F.col("value") / amount_total, 4))
    records = long.select("pos", "loss_type", "value", "unit", share.alias("share"))
    totals = long.agg(
        F.round(F.coalesce(F.sum(F.when(F.col("unit") == AMOUNT_UNIT, F.col("value"))), F.lit(0.0)), 2).alias("amount_total"),
        F.round(F.coalesce(F.sum(F.when(F.col("unit") == PEOPLE_UNIT, F.col("value"))), F.lit(0.0)), 2).alias("casualty_total"),
    )
    columns = [{"key": "loss_type", "role": "dimension"}, {"key": "value", "role": "metric"}]
    return AnalysisResult(request, records, totals, records, filtered, df, ignored or [], columns, is_structure=True, structure=groups)


#: Levels of the region drill with the columns that qualify them.
DRILL_KEYS = ("province_code", "city_code", "county_code", "town")
_DRILL_NAMES = ("province", "city", "county", "town")


def region_drill(df: DataFrame, metrics: list[str], catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """A15 by code: ``(level, province_code, city_code, county_code, town, name, records, <metrics>)`` for all levels.

    One ``ROLLUP`` over the codes, so that counties and towns of the same name
    stay apart. ``level`` tells which codes a row has (0 all, 4 a town); a
    region without a code keeps a row of its own under its parent. ``name`` is
    the least of the names its rows carry.
    """
    from ..functions import exprs as X

    for m in metrics:
        catalog.metric(m)
    codes = [X.normalize_code(c).alias(c) for c in DRILL_KEYS[:-1]]
    rows = df.select(*codes, *_DRILL_NAMES, *metrics)
    level = sum((1 - F.grouping(c).cast("int") for c in DRILL_KEYS), F.lit(0))
    names = [F.min(n).alias(f"_name{i}") for i, n in enumerate(_DRILL_NAMES[:-1], 1)]
    out = rows.rollup(*DRILL_KEYS).agg(level.alias("level"), *names, F.count(F.lit(1)).alias("records"),
                                       *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in metrics])
    name = F.when(F.col("level") == 4, F.col("town"))
    for i in (3, 2, 1):
        name = name.when(F.col("level") == i, F.col(f"_name{i}"))
    return out.select("level", *DRILL_KEYS, name.alias("name"), "records", *metrics)
