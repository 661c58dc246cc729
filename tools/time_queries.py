"""Time every registered query (cold = first run in the session, warm =
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from lossframe.registry import QUERIES
    from lossframe.session import get_spark
    from lossframe.tables import clean_table, raw_table
    spark = get_spark()
    cores = os.environ.get("BENCH_CPUS", "8")
    t0 = time.perf_counter()
    rows_in = raw_table(spark, sf_dir).count()
    t1 = time.perf_counter()
    clean_table(spark, sf_dir).count()
    t2 = time.perf_counter()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(f"| (build raw table) | {sf} | {rows_in} | {t1 - t0:.2f} | — | {cores} | 4.1.2 |")
    print(f"| (clean + write cleaned table) | {sf} | {rows_in} | {t2 - t1:.2f} | — | {cores} | 4.1.2 |")
    for key, fn in QUERIES.items():
        a = time.perf_counter()
        n = len(fn(spark, sf_dir).collect())
        b = time.perf_counter()
        fn(spark, sf_dir).collect()
        c = time.perf_counter()
        print(f"| {key} | {sf} | {rows_in} → {n} | {b - a:.2f} | {c - b:.2f} | {cores} | 4.1.2 |", flush=True)


if __name__ == "__main__":
    main()
