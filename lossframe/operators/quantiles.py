"""Exact grouped quantiles without gathering a group into one task.

``percentile`` keeps every distinct value of a group in one aggregation
buffer, and the final merge of a hot group runs in one task. Here the same
linear-interpolated quantile (numpy/pandas ``linear`` method) is found in two
passes over the rows (``column_quantiles``):

1. one aggregate keeps a mergeable sketch for each group and column, which
   brackets each wanted rank between two values;
2. one aggregate counts what lies below, at and above the brackets, and only
   the few values strictly inside them are shuffled, as a histogram.

The counts tell whether a bracket holds its ranks; one that doesn't is opened to
all values, so the result is exact whatever the sketch's error. Ranks inside a
histogram are found by ``quantiles_from_ranked``: it is range-partitioned on
``(group, value)``, so a hot group is cut into many partitions by value
(``rank_histogram``); per partition and group there are subtotals (at most
partitions + groups rows), whose prefix sums give each partition's rank offset;
a running count inside each (partition, group) gives every distinct value its
rank interval. Every window is bounded by one range partition or by the
partition count. The partitioned histogram is written once (lineage cut) so
partition ids are stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _lerp(lo: Column, hi: Column, t: Column) -> Column:
    """numpy's linear interpolation (stable form for t ≥ 0.5)."""
    diff = hi - lo
    return F.when(t >= 0.5, hi - diff * (1 - t)).otherwise(lo + diff * t)


def histogram(df: DataFrame, group_cols: Sequence[str], value_col: str, weight_col: str | None = None) -> DataFrame:
    """``(group, value) → _c`` counts of the non-null values."""
    weight = F.col(weight_col) if weight_col else F.lit(1)
    return (
        df.where(F.col(value_col).isNotNull())
        .groupBy(*group_cols, value_col)
        .agg(F.sum(weight).cast("long").alias("_c"))
    )


def rank_histogram(hist: DataFrame, group_cols: Sequence[str], value_col: str,
                   num_partitions: int | None = None) -> DataFrame:
    """Range-partition a histogram by (group, value), tag and pin partition ids.

    Without ``num_partitions`` the partition count is left to adaptive
    execution: it coalesces only adjacent ranges (up to the advisory size),
    so partition ids still follow (group, value) order, and the count
    follows the data size instead of a fixed number.
    """
    keys = [F.col(c).asc_nulls_first() for c in group_cols] + [F.col(value_col).asc_nulls_first()]
    ranged = hist.repartitionByRange(num_partitions, *keys) if num_partitions else hist.repartitionByRange(*keys)
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    return materialize(ranged, "ranked-histogram")


def quantiles_from_ranked(ranked: DataFrame, group_cols: Sequence[str], value_col: str,
                          probs: Sequence[float], weight_col: str = "_c") -> DataFrame:
    """Quantiles from a ``rank_histogram`` output (rows may be filtered).

    Returns ``group_cols + [_n, q0, q1, ...]``; ``_n`` = number of values.
    """
    g = list(group_cols)
    ranked = ranked.where(F.col(value_col).isNotNull() & (F.col(weight_col) > 0))
    ptot = ranked.groupBy("_pid", *g).agg(F.sum(weight_col).alias("_pc"))
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ptot = ptot.select(
        "_pid", *g,
        F.coalesce(F.sum("_pc").over(before), F.lit(0)).alias("_off"),
        F.sum("_pc").over(Window.partitionBy(*g)).alias("_n"),
    )
    running = Window.partitionBy("_pid", *g).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    cum = ranked.withColumn("_lc", F.sum(weight_col).over(running))
    cum = cum.join(ptot, on=["_pid", *g], how="inner")
    cum = cum.withColumn("_end", F.col("_off") + F.col("_lc")).withColumn("_start", F.col("_end") - F.col(weight_col))

    def holds(rank: Column) -> Column:
        return (F.col("_start") <= rank) & (rank < F.col("_end"))

    targets = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        targets.append((F.floor(pos), F.ceil(pos)))
    keep = None
    for lo, hi in targets:
        cond = holds(lo) | holds(hi)
        keep = cond if keep is None else keep | cond
    aggs = [F.first("_n").alias("_n")]
    for i, (lo, hi) in enumerate(targets):
        aggs.append(F.max(F.when(holds(lo), F.col(value_col))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(holds(hi), F.col(value_col))).alias(f"_hi{i}"))
    out = cum.where(keep).groupBy(*g).agg(*aggs)
    cols = [*g, "_n"]
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        cols.append(_lerp(F.col(f"_lo{i}"), F.col(f"_hi{i}"), pos - F.floor(pos)).alias(f"q{i}"))
    return out.select(*cols)


def group_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, probs: Sequence[float],
                    weight_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group (pandas ``quantile``)."""
    hist = histogram(df, group_cols, value_col, weight_col)
    ranked = rank_histogram(hist, group_cols, value_col, num_partitions)
    return quantiles_from_ranked(ranked, group_cols, value_col, probs)


#: Relative accuracy of the sketches: a bracket spans four parts of this many.
ACCURACY = 2000


def column_quantiles(df: DataFrame, by: str, values: dict[str, Column], probs: Sequence[float],
                     extra: Sequence[Column] = (), accuracy: int = ACCURACY) -> tuple[DataFrame, DataFrame]:
    """Quantiles of several columns for each group of ``by``, which has no nulls.

    Returns ``(by, m, q0, q1, ...)`` with a row for each group and column that has values, and one
    written row for each group with the aggregates ``extra``.
    """
    names, np = list(values), len(probs)
    rows = df.select(F.col(by), *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())])
    edges = [min(1.0, max(0.0, p + side * 2 / accuracy)) for p in probs for side in (-1, 1)]
    sketch = [F.percentile_approx(f"_v{i}", edges, accuracy).alias(f"_e{i}") for i in range(len(names))]
    source = df.select("*", *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())])
    groups = materialize(source.groupBy(by).agg(*sketch, *extra), "quantile-sketches")
    brackets = groups.select(by, *[f"_e{i}" for i in range(len(names))])
    places = [(i, j) for i in range(len(names)) for j in range(np)]
    while True:
        joined = rows.join(brackets, by)
        low = lambda i, j: F.col(f"_e{i}")[2 * j]
        high = lambda i, j: F.col(f"_e{i}")[2 * j + 1]
        v = lambda i: F.col(f"_v{i}")
        counted = joined.groupBy(by).agg(*[c for i, j in places for c in (
            F.count_if(v(i) < low(i, j)).alias(f"_lt{i}_{j}"), F.count_if(v(i) <= low(i, j)).alias(f"_le{i}_{j}"),
            F.count_if(v(i) > high(i, j)).alias(f"_gt{i}_{j}"), F.count_if(v(i) >= high(i, j)).alias(f"_ge{i}_{j}"))],
            *[F.count(v(i)).alias(f"_n{i}") for i in range(len(names))])
        long = materialize(counted.join(brackets, by).select(by, F.inline(F.array(*[F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"), low(i, j).alias("a"), high(i, j).alias("b"), F.col(f"_n{i}").alias("n"),
            *[F.col(f"_{c}{i}_{j}").alias(c) for c in ("lt", "le", "gt", "ge")]) for i, j in places]))).where("n > 0"), "quantile-brackets")
        prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("j") + 1)
        rank = prob * (F.col("n") - 1)
        missed = long.where((F.col("lt") > F.floor(rank)) | (F.col("n") - F.col("gt") <= F.ceil(rank)))
        if missed.isEmpty():
            break
        # open the brackets that miss their ranks; they hold all values now
        opened = missed.select(by, "i").distinct().groupBy(by).agg(F.collect_set("i").alias("_open"))  # as many as columns at most
        everything = F.expr(f"flatten(array_repeat(array(double('-infinity'), double('infinity')), {np}))")
        brackets = materialize(brackets.join(opened, by, "left").select(by, *[
            F.when(F.array_contains("_open", i), everything).otherwise(F.col(f"_e{i}")).alias(f"_e{i}") for i in range(len(names))]), "quantile-sketches")
    inside = {(i, j): (v(i) > low(i, j)) & (v(i) < high(i, j)) for i, j in places}
    some = None
    for c in inside.values():
        some = c if some is None else some | c
    entries = F.array(*[F.when(c, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v(i).alias("v"))) for (i, j), c in inside.items()])
    middle = joined.where(some).select(by, F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("x")).select(by, "x.*")
    middle = middle.groupBy(by, "i", "j", "v").agg(F.count(F.lit(1)).alias("_c"))
    # What lies beyond a bracket stands at its ends; all of it at one value if the bracket is one value.
    ends = long.select(by, "i", "j", F.inline(F.array(
        F.struct(F.col("a").alias("v"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.col("le")).alias("_c")),
        F.struct(F.col("b").alias("v"), F.when(F.col("a") == F.col("b"), F.lit(0)).otherwise(F.col("ge")).alias("_c"))))).where("_c > 0")
    ranked = rank_histogram(middle.unionByName(ends), [by, "i", "j"], "v")
    found = quantiles_from_ranked(ranked, [by, "i", "j"], "v", probs)
    out = found.groupBy(by, "i").agg(*[F.max(F.when(F.col("j") == j, F.col(f"q{j}"))).alias(f"q{j}") for j in range(np)])
    named = F.element_at(F.array(*[F.lit(m) for m in names]), F.col("i") + 1)
    return out.select(by, named.alias("m"), *[f"q{j}" for j in range(np)]), groups.drop(*[f"_e{i}" for i in range(len(names))])
