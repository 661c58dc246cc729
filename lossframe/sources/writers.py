"""Sinks: raw reports as delimited files (any header layout), cleaned
records as Parquet (partitioned by year) or CSV, audit and issue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DEFAULT_CATALOG, Catalog


def label_layout(catalog: Catalog = DEFAULT_CATALOG) -> dict[str, str]:
    """Template headers: field labels; metric labels with the unit in brackets."""
    out = {f.name: f.label for f in catalog.fields}
    out.update({m.name: f"{m.label}（{m.unit}）" for m in catalog.metrics.values()})
    return out


def alias_layout(catalog: Catalog = DEFAULT_CATALOG) -> dict[str, str]:
    """Alternative headers: the first configured alias of a field, else its
    technical name."""
    first: dict[str, str] = {}
    for alias, target in catalog.aliases.items():
        first.setdefault(target, alias)
    return {name: first.get(name, name) for name in catalog.standard_columns}


#: Rows of a written file of reports, about, and most files.
_FILE_ROWS, _MOST_FILES = 100_000, 1000


def in_order(df: DataFrame, key: str) -> DataFrame:
    """Rows in the order of ``key`` over and within partitions, nulls first.

    As ``orderBy``, which reads all columns once more to find the bounds of the
    partitions; those of a long are found here by a scan of the key alone.
    """
    if dict(df.dtypes)[key] != "bigint":
        return df.orderBy(key)
    most = [i / _MOST_FILES for i in range(1, _MOST_FILES)]
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx(key, most, 10 * _MOST_FILES).alias("keys")).first()
    files = min(-(-found["rows"] // _FILE_ROWS), _MOST_FILES)
    bounds = sorted({found["keys"][_MOST_FILES * i // files - 1] for i in range(1, files)}) if found["keys"] else []

    def part(low: int, high: int) -> str:
        """SQL text: the number of bounds below the key, which is ``low`` at least and ``high`` at most."""
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"IF(`{key}` > {bounds[mid]}L, {part(mid + 1, high)}, {part(low, mid)})"

    return df.repartitionById(len(bounds) + 1, F.expr(part(0, len(bounds)))).sortWithinPartitions(key)


def write_reports_csv(raw: DataFrame, path: str, layout: dict[str, str],
                      extra: dict[str, str] | None = None, encoding: str = "UTF-8") -> None:
    """Write raw reports (standard shape) as CSV with the given headers.

    Rows keep ``_seq`` order across and within the written files; cell text
    is written as is (no trimming, quotes doubled), so reading it back is
    lossless.
    """
    cols = [(c, h) for c, h in layout.items() if c in raw.columns] + [(c, h) for h, c in (extra or {}).items()]
    read = raw.select(*dict.fromkeys(["_seq", *[c for c, _ in cols]]))
    raw.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")  # GBK is none of Spark's own charsets
    (in_order(read, "_seq").select(*[F.col(c).alias(h) for c, h in cols]).write.mode("overwrite")
     .option("header", True).option("encoding", encoding).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_clean(clean: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cleaned records; Parquet partitioned by year (year filters prune
    files; rows are clustered by year first, a hot year split), or CSV whose
    files start with a byte order mark and a header."""
    if fmt == "parquet":
        clean.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)
    else:
        first, *rest = clean.columns
        clean.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_quality_log(audit: DataFrame, issues: DataFrame, path: str, ingest: DataFrame | None = None) -> None:
    """Audit steps and issues, those of the ingest too, as two small Parquet tables."""
    if ingest is not None:
        issues = ingest.unionByName(issues)
    audit.coalesce(1).write.mode("overwrite").parquet(f"{path}/audit")
    issues.coalesce(1).write.mode("overwrite").parquet(f"{path}/issues")
