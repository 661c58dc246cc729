"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Stages: build the raw loss-report table from the driver tables, clean it
(whole chain, written as a table), then every standard plan on the cleaned
table, the same plans from one shared GROUPING SETS scan, and the heavier
profiling / audit queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus

    from lossframe.registry import QUERIES
    from lossframe.session import get_spark
    from lossframe.plans.standard import STANDARD_PLANS, run_all_shared
    from lossframe.tables import clean_result, clean_table, raw_table

    spark = get_spark()
    timings: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"[bench] {name}: {timings[name]}s", file=sys.stderr)
        return out

    timed("build_raw_table", lambda: raw_table(spark, sf_dir).count())
    timed("clean_stats", lambda: clean_result(spark, sf_dir))
    rows = timed("clean_write", lambda: clean_table(spark, sf_dir).count())
    for plan in STANDARD_PLANS:
        key = f"plan_{plan.key}"
        timed(key, lambda k=key: QUERIES[k](spark, sf_dir).collect())

    def shared():
        clean = clean_table(spark, sf_dir)
        frames = run_all_shared(clean)
        return [f.collect() for f in frames.values()]
    timed("plans_shared_scan", shared)
    for key in ("cleaning_audit", "profile_columns", "overview_kpis", "filter_hints", "by_county",
                "fact_conclusion", "geo_scaled", "dq_totals", "overview_raw", "parse_quantity", "union_sources", "src_workbook"):
        timed(key, lambda k=key: QUERIES[k](spark, sf_dir).collect())

    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf, "clean_rows": rows, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
