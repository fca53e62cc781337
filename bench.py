"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is executed completely through the ``noop`` sink (the whole plan
runs, nothing is collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillsight.plans import QUERIES  # noqa: E402
from tillsight.session import local_session  # noqa: E402

HEADLINE = [
    "feature_matrix",          # J1-J3, A5-A12, W1-W3: the basket feature pipeline
    "certain_frauds",          # R6 minimum slice
    "screen",                  # R1-R5 cascade with the stand-in scorer
    "predict_batch",           # R7
    "evaluation_metrics",      # V1-V6
    "average_precision",       # V3 / W7
    "threshold_sweep",         # V7
    "malus_sweep",             # V8
    "damage_threshold_sweep",  # V15 (1000-point grid)
    "margin_grid",             # V10
    "parameter_grid",          # V11
    "chi2_screen",             # T2
    "spearman_matrix",         # T8
    "pair_rules",              # R10
    "segment_report",          # A32
    "stratified_split",        # O8
    "fold_metrics",            # O9 + per-fold evaluation
    "frequent_itemsets_fraud", # U8
    "payload_roundtrip",       # S4 + S5
    "stream_screening",        # ST1
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    # JVM / JIT warm-up on a small data set, not timed
    for warm in ("feature_matrix", "screen", "threshold_sweep"):
        QUERIES[warm](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
