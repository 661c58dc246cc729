"""Cleaning chain: raw text records → typed, standardized loss records.

Steps, in the order the source pipeline applies them:

C1  missing tokens → null           C12 lower-bound clamp
C2  drop all-null rows               C13 per-type IQR cap (upper side)
C3  text standardization             C14 upper-bound clamp
C4  multi-format date parse          C15 code normalization
C5  calendar parts                   C16 code-prefix hierarchy check
C6  quantity parse                   C17 code→name check against a reference
C7  unit conversion                  C18 ``_hierarchy_ok`` flag + issue
C8  imputation count per row         C19 flood season
C9  zero fill                        C20 per-capita loss band
C10 drop rows without required region fields
C11 null event type → "other"        C21 de-duplicate, keep first
C22 audit table (one aggregate)      C23 ``clean`` = all of the above

Row-local steps are one projection of native expressions. Whole-frame
dependencies (which metrics were reported at all, per-type quartiles) come
from two aggregates over the parsed metric columns; see ``quantiles.py``.
Written are the parsed rows and, by the caller, the cleaned ones; the flags
of each step are projections of the parsed rows and the bounds. Filters from later analyses never move below this
chain: quartiles, the reported-metric set and keep-first depend on the
whole frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import DEFAULT_CATALOG, OTHER_CATEGORY, Catalog
from ..functions import exprs as X
from ..session import materialize
from .quantiles import column_quantiles

DATE_FIELD = "occur_date"
TYPE_FIELD = "disaster_type"
#: Repeated keys that may be broadcast: about 100 bytes each.
BROADCAST_KEYS = 500_000


# ------------------------------------------------------------ raw shape ----

def to_standard(df: DataFrame, catalog: Catalog = DEFAULT_CATALOG, seq_col: str = "seq",
                source_file: str | Column | None = None, source_sheet: str | Column | None = None) -> DataFrame:
    """Project any frame onto the raw standard shape (all text, fixed order).

    Absent standard columns are null; ``seq_col`` becomes ``_seq``.
    """
    present = set(df.columns)

    def lit_or_col(v):
        if v is None:
            return F.lit(None).cast("string")
        return v if isinstance(v, Column) else F.lit(v)

    # a long, or a struct that orders the input
    seq = F.col(seq_col) if dict(df.dtypes)[seq_col].startswith("struct") else F.col(seq_col).cast("long")
    cols = [seq.alias("_seq")]
    for name in catalog.standard_columns:
        cols.append((F.col(name).cast("string") if name in present else F.lit(None).cast("string")).alias(name))
    cols.append((F.col("_source_file") if "_source_file" in present else lit_or_col(source_file)).alias("_source_file"))
    cols.append((F.col("_source_sheet") if "_source_sheet" in present else lit_or_col(source_sheet)).alias("_source_sheet"))
    return df.select(*cols)


# ----------------------------------------------------- row-local steps ----

def null_tokens(df: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Every standard text cell that is a missing token becomes null."""
    return df.select(*[X.null_if_missing(c).alias(c) if c in catalog.standard_columns else F.col(c) for c in df.columns])


def drop_empty_rows(df: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Drop rows whose data columns are all null (lineage not counted)."""
    data_cols = [c for c in catalog.standard_columns if c in df.columns]
    return df.na.drop(how="all", subset=data_cols)


def parse_stage(raw: DataFrame, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """C3–C7 as one projection, with per-row change flags for the audit.

    Output: typed standard columns + ``_chg_<text>``, ``_conv_<metric>``,
    ``_date_raw`` flags; non-standard columns (``_seq``, lineage, flags)
    pass through unchanged.
    """
    rules = catalog.rules
    standard = set(catalog.standard_columns)
    passthrough = [c for c in raw.columns if c not in standard]
    # stage 1: one regex pass per cell (text, trimmed date text, quantity text)
    s1: list[Column] = [F.col(c) for c in passthrough]
    for f in catalog.fields:
        name = f.name
        if name in catalog.text_fields:
            cleaned = X.normalize_text(name)
            s1.append(cleaned.alias(name))
            s1.append(X.changed(F.col(name), cleaned).alias(f"_chg_{name}"))
        elif name == DATE_FIELD:
            s1.append(F.when(~X.is_missing(name), X.trim_ws(name)).alias("_date_txt"))
            s1.append(F.col(name).isNotNull().alias("_date_raw"))
        elif f.dtype == "string":
            s1.append(F.col(name))
    # only cells that are more than digits are read as text (units without a letter could be digits)
    plain = {m for m in catalog.metric_names if all(any(ch.isalpha() for ch in u) for u in catalog.metric(m).units)}
    for m in catalog.metric_names:
        number = X.plain_integer(m) if m in plain else F.lit(None).cast("double")
        s1.append(number.alias(f"_int_{m}"))
        s1.append(F.when(number.isNull(), X.quantity_text(m)).alias(f"_qt_{m}"))
    df = raw.select(*s1)
    # stage 2: typed values from the prepared text
    s2: list[Column] = [F.col(c) for c in df.columns if not c.startswith(("_qt_", "_int_")) and c != "_date_txt"]
    s2.append(X.parse_date("_date_txt", rules["date_formats"]).alias(DATE_FIELD))
    for m in catalog.metric_names:
        text = F.col(f"_qt_{m}")  # null for digits alone, whose factor is 1, and missing cells
        s2.append(F.when(text.isNull(), F.col(f"_int_{m}")).otherwise(X.number_of_text(f"_qt_{m}")).alias(f"_num_{m}"))
        s2.append(F.when(text.isNull(), F.lit(1.0)).otherwise(X.factor_of_text(f"_qt_{m}", catalog.metric(m).units)).alias(f"_fac_{m}"))
    df = df.select(*s2)
    # stage 3: converted values, calendar parts
    s3: list[Column] = [F.col(c) for c in df.columns if not c.startswith(("_num_", "_fac_"))]
    for m in catalog.metric_names:
        num, fac = F.col(f"_num_{m}"), F.col(f"_fac_{m}")
        s3.append((num * fac).alias(m))
        s3.append((num.isNotNull() & (fac != F.lit(1.0))).alias(f"_conv_{m}"))
    d = F.col(DATE_FIELD)
    s3 += [F.year(d).alias("year"), F.quarter(d).alias("quarter"),
           F.month(d).alias("month"), F.dayofmonth(d).alias("day")]
    return df.select(*s3)


def _filled(catalog: Catalog, m: str) -> Column:
    """C9 value: zero fill when the metric's fill is 0 under zero_with_flag."""
    spec = catalog.metric(m)
    policy = catalog.rules.get("missing", {}).get("numeric_policy")
    if policy == "zero_with_flag" and spec.fill == 0:
        return F.coalesce(F.col(m), F.lit(0.0))
    return F.col(m)


def _low_clamped(catalog: Catalog, m: str, value: Column) -> Column:
    low = catalog.metric(m).low
    return value if low is None else F.when(value < F.lit(float(low)), F.lit(float(low))).otherwise(value)


# --------------------------------------------------- whole-frame stats ----

@dataclass
class FrameStats:
    reported: list[str]        # metrics with at least one value (C8)
    bounds: DataFrame | None   # per type: _ub_<metric> IQR upper caps (C13)


def frame_stats(parsed: DataFrame, catalog: Catalog = DEFAULT_CATALOG, kept: Column | None = None) -> FrameStats:
    """The whole-frame facts the chain needs, from two passes over the metric columns.

    The first aggregate counts each type's rows and each metric's reported
    values and sketches the filled, low-clamped values of the rows kept; the
    second finds the exact quartiles inside the sketches' brackets.
    """
    rules = catalog.rules
    kept = kept if kept is not None else F.lit(True)
    type_col = F.coalesce(F.col(TYPE_FIELD), F.lit(OTHER_CATEGORY))
    outlier = rules.get("outlier", {})
    counts = [F.count(m).alias(f"_nn_{m}") for m in catalog.metric_names]
    rows = parsed.withColumn("t", type_col)
    if outlier.get("method") != "iqr":
        return FrameStats(_reported(rows.agg(*counts), catalog), None)
    values = {m: F.when(kept, _low_clamped(catalog, m, _filled(catalog, m))) for m in catalog.metric_names}
    qs, groups = column_quantiles(rows, "t", values, [0.25, 0.75], [*counts, F.count_if(kept).alias("size")])
    reported = _reported(groups.agg(*[F.sum(f"_nn_{m}").alias(f"_nn_{m}") for m in catalog.metric_names]), catalog)

    factor = float(outlier.get("iqr_factor", 1.5))
    min_n = int(outlier.get("min_group_size", 8))
    sizes = groups.select("t", "size")
    iqr = F.col("q1") - F.col("q0")
    upper = F.when((F.col("size") >= min_n) & (iqr > 0), F.col("q1") + F.lit(factor) * iqr)
    per_metric = qs.join(sizes, "t").select("t", "m", upper.alias("ub"))
    wide = per_metric.groupBy("t").pivot("m", catalog.metric_names).agg(F.first("ub"))
    wide = wide.select(F.col("t").alias("_bt"), *[F.col(m).alias(f"_ub_{m}") for m in catalog.metric_names])
    return FrameStats(reported, materialize(wide, "iqr-bounds"))


def _reported(counts: DataFrame, catalog: Catalog) -> list[str]:
    """Metrics with at least one value, from one row of their counts."""
    row = counts.first()
    return [m for m in catalog.metric_names if row[f"_nn_{m}"]]


# ------------------------------------------------------------ the chain ----

def _county_reference(reference: DataFrame | None) -> DataFrame | None:
    """Level-3 code → name map, one row per code."""
    if reference is None:
        return None
    ref = reference
    if "level" in ref.columns:
        ref = ref.where(F.col("level") == 3)
    return materialize(ref.groupBy(F.col("code").alias("_ref_code")).agg(F.max("name").alias("_ref_name")), "county-reference")


@dataclass
class CleanResult:
    frame: DataFrame          # cleaned, de-duplicated records (lazy)
    annotated: DataFrame      # pre-filter rows with audit flags (lazy)
    reported: list[str]
    catalog: Catalog
    raw: DataFrame | None = None
    bounds: DataFrame | None = None

    def audit(self) -> DataFrame:
        from .audit import cleaning_audit
        return cleaning_audit(self)

    def issues(self) -> DataFrame:
        from .audit import cleaning_issues
        return cleaning_issues(self)


def clean(raw: DataFrame, catalog: Catalog = DEFAULT_CATALOG, reference: DataFrame | None = None) -> CleanResult:
    """C1–C23 on a ``to_standard``-shaped frame.

    Writes the parsed rows once, then runs the whole-frame statistics and the
    search for repeated keys over the columns they need of that table; the
    returned frames are lazy.
    """
    rules = catalog.rules
    data_cols = [c for c in catalog.standard_columns if c in raw.columns]
    nonempty = F.greatest(*[F.col(c).isNotNull() for c in data_cols]) if data_cols else F.lit(True)
    parsed = parse_stage(raw.withColumn("_nonempty", nonempty), catalog)

    region_ok = F.lit(True)
    if rules.get("missing", {}).get("region_policy") == "drop_row":
        for name in catalog.required_region_fields:
            region_ok = region_ok & F.col(name).isNotNull()
    parsed = parsed.withColumn("_kept", F.col("_nonempty") & region_ok)
    # The parse is the costly per-row work (string functions on every
    # cell). Write it once: the statistics pass reads only the metric
    # columns of this table, the annotation reads it again; no second parse.
    parsed = materialize(parsed, "parsed")

    stats = frame_stats(parsed.where(F.col("_nonempty")), catalog, kept=F.col("_kept"))
    annotated = _annotate(parsed, catalog, stats, reference)
    frame = dedupe_keep_first(
        annotated.where(F.col("_kept")).select(*[f.name for f in catalog.clean_schema().fields]), catalog
    )
    return CleanResult(frame=frame, annotated=annotated, reported=stats.reported, catalog=catalog,
                       raw=raw, bounds=stats.bounds)


def _annotate(parsed: DataFrame, catalog: Catalog, stats: FrameStats, reference: DataFrame | None) -> DataFrame:
    """C8–C20 on every non-empty row; ``_kept`` marks rows C10 keeps."""
    rules = catalog.rules
    df = parsed.where(F.col("_nonempty"))
    metrics = catalog.metric_names

    # C8 imputation count over the metrics that have any value at all
    if stats.reported:
        imputed = sum((F.col(m).isNull().cast("int") for m in stats.reported), F.lit(0))
    else:
        imputed = F.lit(0)
    # C9 fill flags, C11 category fill
    cols = [F.col(c) for c in df.columns if c not in set(metrics) | {TYPE_FIELD}]
    cols.append(imputed.cast("int").alias("_imputed_metrics"))
    for m in metrics:
        cols.append((F.col(m).isNull() & _filled(catalog, m).isNotNull()).alias(f"_fill_{m}"))
        cols.append(_low_clamped(catalog, m, _filled(catalog, m)).alias(f"_v1_{m}"))
        low = catalog.metric(m).low
        cols.append(((_filled(catalog, m) < F.lit(float(low))) if low is not None else F.lit(False)).alias(f"_low_{m}"))
    type_policy = rules.get("missing", {}).get("categorical_policy")
    if type_policy == "fill_其他":
        cols.append(F.coalesce(F.col(TYPE_FIELD), F.lit(OTHER_CATEGORY)).alias(TYPE_FIELD))
    else:
        cols.append(F.col(TYPE_FIELD))
    cols.append(F.col(TYPE_FIELD).isNull().alias("_fill_type"))
    df = df.select(*cols)

    # C13 per-type IQR cap (bounds: one written row per type)
    if stats.bounds is not None:
        df = df.join(stats.bounds, df[TYPE_FIELD] == F.col("_bt"), "left")
    cols = [F.col(c) for c in df.columns if not c.startswith("_v1_") and not c.startswith("_ub_") and c != "_bt"]
    for m in metrics:
        v1 = F.col(f"_v1_{m}")
        ub = F.col(f"_ub_{m}") if stats.bounds is not None else F.lit(None).cast("double")
        capped = ub.isNotNull() & (v1 > ub)
        v2 = F.when(capped, ub).otherwise(v1)
        high = catalog.metric(m).high
        over = (v2 > F.lit(float(high))) if high is not None else F.lit(False)
        v3 = F.when(over, F.lit(float(high))).otherwise(v2) if high is not None else v2
        cols += [v3.alias(m), capped.alias(f"_cap_{m}"), over.alias(f"_high_{m}")]
    df = df.select(*cols)

    # C15–C18 hierarchy checks
    hierarchy = rules.get("hierarchy", {})
    code = X.normalize_code("county_code")
    prefix_bad = F.lit(False)
    if hierarchy.get("check_code_prefix", True):
        for parent, width in (("province_code", 2), ("city_code", 4)):
            p = X.normalize_code(parent)
            mismatch = code.isNotNull() & p.isNotNull() & (F.substring(code, 1, width) != F.substring(p, 1, width))
            prefix_bad = prefix_bad | F.coalesce(mismatch, F.lit(False))
    df = df.withColumn("_prefix_bad", prefix_bad).withColumn("county_code", code)
    conflict = F.col("_prefix_bad")
    ref = _county_reference(reference) if hierarchy.get("check_name_against_reference", True) else None
    if ref is not None:
        df = df.join(ref, F.col("county_code") == F.col("_ref_code"), "left")
        wrong_name = (
            F.col("county_code").isNotNull() & F.col("county").isNotNull()
            & F.col("_ref_name").isNotNull() & (F.col("_ref_name") != "")
            & (F.col("_ref_name") != F.col("county"))
        )
        df = df.withColumn("_name_bad", F.coalesce(wrong_name, F.lit(False))).drop("_ref_code")
    else:
        df = df.withColumn("_name_bad", F.lit(False)).withColumn("_ref_name", F.lit(None).cast("string"))
    df = df.withColumn("_hierarchy_ok", ~(conflict | F.col("_name_bad")))

    # C19, C20 derived dimensions
    df = df.withColumn("season", X.season("month", rules["season_rule"]["flood_season_months"]))
    if {"direct_economic_loss", "affected_population"} <= set(metrics):
        df = df.withColumn("per_capita_level", X.per_capita_band(
            "direct_economic_loss", "affected_population",
            rules["per_capita_loss_bins"], rules["per_capita_loss_labels"]))
    return df


def dedupe_keep_first(df: DataFrame, catalog: Catalog = DEFAULT_CATALOG, order_col: str = "_seq") -> DataFrame:
    """One row per business key, the first in input order; null keys
    compare equal.

    Only keys and order are aggregated, combined before the shuffle, so a key
    with millions of copies reaches the reducer as one row per map task. Keys
    with more than one row are joined back, and all rows but their first go;
    the rows themselves are shuffled only if those keys are too many to
    broadcast, and then Spark splits hot ones.
    """
    keys = [k for k in catalog.rules.get("dedupe_on", []) if k in df.columns]
    if not keys:
        return df
    names = [f"_k{i}" for i in range(len(keys))]
    repeated = materialize(df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(order_col).alias("_at"))
                           .groupBy(*names).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1").drop("_copies"),
                           "repeated-keys")
    if repeated.count() <= BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return df.join(repeated, same, "left").where(F.col("_first").isNull() | (F.col(order_col) == F.col("_first"))).select(*df.columns)


def clean_frame(raw: DataFrame, catalog: Catalog = DEFAULT_CATALOG, reference: DataFrame | None = None) -> DataFrame:
    return clean(raw, catalog, reference).frame
