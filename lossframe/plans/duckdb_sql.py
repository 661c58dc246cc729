"""DuckDB SQL for the same queries: the independent check of every Spark plan.

``clean_cte()`` spells the cleaning chain in plain SQL over the fixture
view (window quantiles, ``row_number`` keep-first) — a different
formulation from the Spark operators, so agreement means something. Each
query's SQL is ``WITH <clean chain> SELECT ...``.
"""

from __future__ import annotations

from ..catalog import (AMOUNT_UNIT, DEFAULT_CATALOG, FLOOD_SEASON, NO_POPULATION_BAND, NON_FLOOD_SEASON,
                       NULL_TOKENS, OTHER_CATEGORY, PEOPLE_UNIT, Catalog)
from ..functions.exprs import WHITESPACE, ordered_units
from ..sources.fixtures import GEO_FEATURES_SQL, INCIDENT_COLUMNS, INCIDENTS_RAW_SQL, REGION_DIM_SQL, duckdb_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def trim_ws(c: str) -> str:
    return f"trim({c}, {WS_SQL})"


def missing(c: str) -> str:
    tokens = ", ".join(q(t) for t in NULL_TOKENS)
    return f"({c} IS NULL OR lower({trim_ws(c)}) IN ({tokens}))"


def text_clean(c: str) -> str:
    return f"CASE WHEN {missing(c)} THEN NULL ELSE translate({c}, {WS_SQL}, '') END"


def code_clean(c: str) -> str:
    return f"CASE WHEN {missing(c)} THEN NULL ELSE {trim_ws(f'regexp_replace({c}, ' + q(r'\.0$') + ', ' + q('') + ')')} END"


# Spelt out here on their own, beside the configured date formats.
_TIMES = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M",
          "%Y.%m.%d %H:%M:%S", "%Y.%m.%d %H:%M", "%Y年%m月%d日 %H:%M:%S", "%Y年%m月%d日 %H:%M"]


def date_sql(c: str, catalog: Catalog) -> str:
    t = trim_ws(c)
    tries = ", ".join(f"try_strptime({t}, {q(fmt)})" for fmt in (*catalog.rules["date_formats"], *_TIMES))
    return f"CASE WHEN {missing(c)} THEN NULL ELSE coalesce({tries}) END"


def raw_cte() -> str:
    """Fixture rows in the raw standard shape."""
    return f"raw0 AS ({duckdb_sql(INCIDENTS_RAW_SQL)})"


def clean_cte(catalog: Catalog = DEFAULT_CATALOG) -> str:
    """CTE chain ending in ``clean`` (the cleaned, de-duplicated table)."""
    rules = catalog.rules
    fixture_cols = set(INCIDENT_COLUMNS)
    std = catalog.standard_columns
    raw_sel = ["seq AS _seq"] + [
        (f"CAST({c} AS VARCHAR) AS {c}" if c in fixture_cols else f"CAST(NULL AS VARCHAR) AS {c}") for c in std
    ] + ["'fixture' AS _source_file", "'incidents_raw' AS _source_sheet"]
    nonempty = " OR ".join(f"{c} IS NOT NULL" for c in std)

    p1 = ["_seq", "_source_file", "_source_sheet", "occur_date IS NOT NULL AS _date_raw"]
    for f in catalog.fields:
        if f.name in catalog.text_fields:
            p1.append(f"{text_clean(f.name)} AS {f.name}")
            p1.append(f"({text_clean(f.name)}) IS DISTINCT FROM {f.name} AS _chg_{f.name}")
        elif f.name == "occur_date":
            p1.append(f"{date_sql('occur_date', catalog)} AS occur_date")
    for m in catalog.metric_names:
        p1.append(f"CASE WHEN {missing(m)} THEN NULL ELSE replace(replace({trim_ws(m)}, ',', ''), '，', '') END AS _qt_{m}")

    p2 = ["*", "CAST(year(occur_date) AS INTEGER) AS year", "CAST(quarter(occur_date) AS INTEGER) AS quarter",
          "CAST(month(occur_date) AS INTEGER) AS month", "CAST(day(occur_date) AS INTEGER) AS day"]
    for m in catalog.metric_names:
        num = (f"TRY_CAST(NULLIF(regexp_extract(translate(_qt_{m}, '０１２３４５６７８９', '0123456789'), "
               f"{q(r'-?\d+(?:\.\d+)?')}, 0), '') AS DOUBLE)")
        fac = "1.0"
        units = ordered_units(catalog.metric(m).units)
        if units:
            fac = "CASE " + " ".join(f"WHEN contains(_qt_{m}, {q(u)}) THEN {float(v)!r}" for u, v in units) + " ELSE 1.0 END"
        p2.append(f"{num} * {fac} AS {m}")
        p2.append(f"{num} AS _num_{m}")
        p2.append(f"({num} IS NOT NULL AND {fac} <> 1.0) AS _conv_{m}")

    region = " AND ".join(f"{c} IS NOT NULL" for c in catalog.required_region_fields) or "TRUE"
    rep = ", ".join(f"count({m}) > 0 AS _r_{m}" for m in catalog.metric_names)
    imputed = " + ".join(f"(CASE WHEN _r_{m} AND {m} IS NULL THEN 1 ELSE 0 END)" for m in catalog.metric_names)

    def filled(m: str) -> str:
        return f"coalesce({m}, 0.0)" if catalog.metric(m).fill == 0 else m

    def low(m: str, v: str) -> str:
        lo = catalog.metric(m).low
        return v if lo is None else f"(CASE WHEN {v} < {float(lo)!r} THEN {float(lo)!r} ELSE {v} END)"

    p4 = ["p3.*", f"CAST({imputed} AS INTEGER) AS _imputed_metrics",
          f"coalesce(disaster_type, {q(OTHER_CATEGORY)}) AS _t"]
    p4 += [f"{low(m, filled(m))} AS _v1_{m}" for m in catalog.metric_names]
    qs = ", ".join(f"quantile_cont(_v1_{m}, 0.25) AS _q1_{m}, quantile_cont(_v1_{m}, 0.75) AS _q3_{m}"
                   for m in catalog.metric_names)
    outlier = rules["outlier"]
    fac = float(outlier["iqr_factor"])
    minn = int(outlier["min_group_size"])
    p5 = []
    for m in catalog.metric_names:
        iqr = f"(_q3_{m} - _q1_{m})"
        ub = f"(_q3_{m} + {fac!r} * {iqr})"
        v2 = f"(CASE WHEN _n >= {minn} AND {iqr} > 0 AND _v1_{m} > {ub} THEN {ub} ELSE _v1_{m} END)"
        hi = catalog.metric(m).high
        v3 = v2 if hi is None else f"(CASE WHEN {v2} > {float(hi)!r} THEN {float(hi)!r} ELSE {v2} END)"
        p5.append(f"{v3} AS {m}")
        p5.append(f"(_n >= {minn} AND {iqr} > 0 AND _v1_{m} > {ub}) IS TRUE AS _cap_{m}")
        p5.append(f"{ub} AS _ub_{m}")
        p5.append(f"{iqr} AS _iqr_{m}")
        p5.append((f"({v2} > {float(hi)!r})" if hi is not None else "FALSE") + f" AS _high_{m}")
    code = code_clean("county_code")
    pc, cc = code_clean("province_code"), code_clean("city_code")
    conflict = (f"(({code}) IS NOT NULL AND ({pc}) IS NOT NULL AND substr(({code}), 1, 2) <> substr(({pc}), 1, 2))"
                f" OR (({code}) IS NOT NULL AND ({cc}) IS NOT NULL AND substr(({code}), 1, 4) <> substr(({cc}), 1, 4))"
                f" OR (({code}) IS NOT NULL AND county IS NOT NULL AND ref.name IS NOT NULL AND ref.name <> '' AND ref.name <> county)")
    months = ", ".join(str(x) for x in rules["season_rule"]["flood_season_months"])
    bins, labels = rules["per_capita_loss_bins"], rules["per_capita_loss_labels"]
    ratio = "(direct_economic_loss / NULLIF(affected_population, 0))"
    band = "CASE " + " ".join(
        f"WHEN {ratio} >= {float(lo)!r} AND {ratio} < {float(hi)!r} THEN {q(lab)}"
        for lo, hi, lab in zip(bins[:-1], bins[1:], labels)) + f" ELSE {q(NO_POPULATION_BAND)} END"
    keys = ", ".join(k for k in rules["dedupe_on"])
    final_cols = ["_seq"] + [f.name for f in catalog.fields] + catalog.metric_names + [
        "_source_file", "_source_sheet", "_imputed_metrics", "_hierarchy_ok"]
    p6_fields = []
    for f in catalog.fields:
        if f.name == "disaster_type":
            p6_fields.append("_t AS disaster_type")
        elif f.name == "county_code":
            p6_fields.append(f"{code} AS county_code")
        elif f.name == "season":
            p6_fields.append(f"CASE WHEN month IN ({months}) THEN {q(FLOOD_SEASON)} ELSE {q(NON_FLOOD_SEASON)} END AS season")
        elif f.name == "per_capita_level":
            p6_fields.append(f"{band} AS per_capita_level")
        else:
            p6_fields.append(f.name)
    return ",\n".join([
        raw_cte(),
        f"rawstd AS (SELECT {', '.join(raw_sel)} FROM raw0)",
        f"p1 AS (SELECT {', '.join(p1)} FROM rawstd WHERE {nonempty})",
        f"p2 AS (SELECT {', '.join(p2)} FROM p1)",
        f"rep AS (SELECT {rep} FROM p2)",
        f"p3 AS (SELECT p2.*, rep.* FROM p2, rep WHERE {region})",
        f"p4 AS (SELECT {', '.join(p4)} FROM p3)",
        f"qq AS (SELECT _t AS _qt, count(*) AS _n, {qs} FROM p4 GROUP BY _t)",
        f"p5 AS (SELECT p4.* EXCLUDE ({', '.join(catalog.metric_names)}), qq._n, {', '.join(p5)} FROM p4 LEFT JOIN qq ON p4._t = qq._qt)",
        f"ref AS (SELECT code, max(name) AS name FROM ({duckdb_sql(REGION_DIM_SQL)}) r WHERE level = 3 GROUP BY code)",
        f"p6 AS (SELECT _seq, {', '.join(p6_fields)}, {', '.join(catalog.metric_names)}, _source_file, _source_sheet, "
        f"_imputed_metrics, NOT coalesce({conflict}, FALSE) AS _hierarchy_ok, "
        f"(({code}) IS NOT NULL AND ({pc}) IS NOT NULL AND substr(({code}), 1, 2) <> substr(({pc}), 1, 2)) IS TRUE "
        f"OR (({code}) IS NOT NULL AND ({cc}) IS NOT NULL AND substr(({code}), 1, 4) <> substr(({cc}), 1, 4)) IS TRUE AS _prefix_bad, "
        f"(({code}) IS NOT NULL AND county IS NOT NULL AND ref.name IS NOT NULL AND ref.name <> '' AND ref.name <> county) IS TRUE AS _name_bad "
        f"FROM p5 LEFT JOIN ref ON ref.code = ({code}))",
        f"p7 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY _seq) AS _rn FROM p6)",
        f"clean AS (SELECT {', '.join(final_cols)} FROM p7 WHERE _rn = 1)",
    ])


def with_clean(select_sql: str, catalog: Catalog = DEFAULT_CATALOG, extra_ctes: str = "") -> str:
    extra = (",\n" + extra_ctes) if extra_ctes else ""
    return f"WITH {clean_cte(catalog)}{extra}\n{select_sql}"


# ------------------------------------------------------------ analyses ----

def plan_sql(dimensions: list[str], metrics: list[str], limit: int | None, catalog: Catalog = DEFAULT_CATALOG,
             where: str = "TRUE", round_digits: int | None = None, sort_by: str | None = None,
             ascending: bool = False) -> str:
    """Grouped sums, ordered like ``order_columns``, limited."""
    dims = [catalog.dimension(d) for d in dimensions]
    fields = [d.field for d in dims]
    def mexpr(m: str) -> str:
        e = f"coalesce(sum({m}), 0.0)"
        return f"round({e}, {round_digits})" if round_digits is not None else e
    sums = ", ".join(f"{mexpr(m)} AS {m}" for m in metrics)
    order = []
    if sort_by:
        order.append(f"coalesce(sum({sort_by}), 0.0) {'ASC' if ascending else 'DESC'}" if sort_by in metrics
                     else f"{sort_by} {'ASC' if ascending else 'DESC'} NULLS LAST")
    if dims:
        d0 = dims[0]
        if d0.kind == "temporal":
            order.append(f"{fields[0]} ASC NULLS LAST")
        elif d0.order:
            arr = "[" + ", ".join(q(v) for v in d0.order) + "]"
            order.append(f"CASE WHEN list_position({arr}, CAST({fields[0]} AS VARCHAR)) IS NULL THEN {len(d0.order) + 1} "
                         f"ELSE list_position({arr}, CAST({fields[0]} AS VARCHAR)) END ASC")
        elif metrics:
            order.append(f"coalesce(sum({metrics[0]}), 0.0) {'ASC' if ascending else 'DESC'}")
    order += [f"{f} ASC NULLS LAST" for f in fields]
    group = f"GROUP BY {', '.join(fields)}" if fields else ""
    order_sql = f"ORDER BY {', '.join(order)}" if order else ""
    sel = ", ".join(fields + [sums]) if fields else sums
    lim = f"LIMIT {limit}" if limit is not None else ""
    return with_clean(f"SELECT {sel} FROM clean WHERE {where} {group} {order_sql} {lim}", catalog)


def loss_structure_sql(catalog: Catalog = DEFAULT_CATALOG, where: str = "TRUE") -> str:
    parts = []
    for i, g in enumerate(catalog.loss_groups):
        expr = " + ".join(f"coalesce(sum({m}), 0.0)" for m in g.metrics)
        parts.append(f"SELECT {i} AS pos, {q(g.name)} AS loss_type, round({expr}, 4) AS value, {q(g.unit)} AS unit FROM clean WHERE {where}")
    body = " UNION ALL ".join(parts)
    return with_clean(
        "SELECT pos, loss_type, value, unit, CASE WHEN unit = " + q(AMOUNT_UNIT) +
        " AND sum(CASE WHEN unit = " + q(AMOUNT_UNIT) + " THEN value END) OVER () <> 0 THEN round(value / "
        "sum(CASE WHEN unit = " + q(AMOUNT_UNIT) + " THEN value END) OVER (), 4) END AS share FROM ls",
        catalog, extra_ctes=f"ls AS ({body})")


__all__ = ["clean_cte", "with_clean", "plan_sql", "loss_structure_sql", "q", "GEO_FEATURES_SQL",
           "PEOPLE_UNIT", "AMOUNT_UNIT"]


def order_sql(dimensions: list[str], metrics: list[str], catalog: Catalog = DEFAULT_CATALOG,
              sort_by: str | None = None, ascending: bool = False, grouped: bool = True) -> str:
    """ORDER BY keys of a plan (``grouped``: metric keys are ``sum(m)``)."""
    dims = [catalog.dimension(d) for d in dimensions]
    fields = [d.field for d in dims]
    msum = (lambda m: f"coalesce(sum({m}), 0.0)") if grouped else (lambda m: f"coalesce({m}, 0.0)")
    order = []
    if sort_by:
        order.append(f"{msum(sort_by)} {'ASC' if ascending else 'DESC'}")
    if dims:
        d0 = dims[0]
        if d0.kind == "temporal":
            order.append(f"{fields[0]} ASC NULLS LAST")
        elif d0.order:
            arr = "[" + ", ".join(q(v) for v in d0.order) + "]"
            pos = f"list_position({arr}, CAST({fields[0]} AS VARCHAR))"
            order.append(f"CASE WHEN {pos} IS NULL THEN {len(d0.order) + 1} ELSE {pos} END ASC")
        elif metrics:
            order.append(f"{msum(metrics[0])} {'ASC' if ascending else 'DESC'}")
    order += [f"{f} ASC NULLS LAST" for f in fields]
    return ", ".join(order)


def records_cte(name: str, dimensions: list[str], metrics: list[str], limit: int | None,
                catalog: Catalog = DEFAULT_CATALOG) -> str:
    """``name AS (...)``: a plan's records with ``pos`` (1-based order)."""
    fields = [catalog.dimension(d).field for d in dimensions]
    o = order_sql(dimensions, metrics, catalog)
    sums = ", ".join(f"coalesce(sum({m}), 0.0) AS {m}" for m in metrics)
    lim = f"LIMIT {limit}" if limit is not None else ""
    return (f"{name} AS (SELECT {', '.join(fields)}, {sums}, row_number() OVER (ORDER BY {o}) AS pos "
            f"FROM clean GROUP BY {', '.join(fields)} ORDER BY {o} {lim})")


def quantity_text_sql(c: str) -> str:
    return f"(CASE WHEN {missing(c)} THEN NULL ELSE replace(replace({trim_ws(c)}, ',', ''), '，', '') END)"


def number_sql(c: str) -> str:
    t = quantity_text_sql(c)
    return (f"TRY_CAST(NULLIF(regexp_extract(translate({t}, '０１２３４５６７８９', '0123456789'), "
            f"{q(r'-?\d+(?:\.\d+)?')}, 0), '') AS DOUBLE)")


def factor_sql(c: str, units: dict) -> str:
    t = quantity_text_sql(c)
    pairs = ordered_units(units)
    if not pairs:
        return "1.0"
    return "(CASE " + " ".join(f"WHEN contains({t}, {q(u)}) THEN {float(v)!r}" for u, v in pairs) + " ELSE 1.0 END)"


def ls_cte(catalog: Catalog = DEFAULT_CATALOG, where: str = "TRUE") -> str:
    parts = []
    for i, g in enumerate(catalog.loss_groups):
        expr = " + ".join(f"coalesce(sum({m}), 0.0)" for m in g.metrics)
        parts.append(f"SELECT {i} AS pos, {q(g.name)} AS loss_type, round({expr}, 4) AS value, {q(g.unit)} AS unit "
                     f"FROM clean WHERE {where}")
    body = " UNION ALL ".join(parts)
    a = q(AMOUNT_UNIT)
    return (f"ls0 AS ({body}), ls AS (SELECT pos, loss_type, value, unit, CASE WHEN unit = {a} AND "
            f"sum(CASE WHEN unit = {a} THEN value END) OVER () <> 0 THEN round(value / "
            f"sum(CASE WHEN unit = {a} THEN value END) OVER (), 4) END AS share FROM ls0)")


def geo_ctes() -> str:
    return (f"feats AS ({duckdb_sql(GEO_FEATURES_SQL)}), "
            "geo AS (SELECT trim(name) AS name, first(lon ORDER BY pos) AS lon, first(lat ORDER BY pos) AS lat, "
            "count(*) AS feature_count FROM feats WHERE name IS NOT NULL AND trim(name) <> '' GROUP BY trim(name))")


def region_sql() -> str:
    return duckdb_sql(REGION_DIM_SQL)
