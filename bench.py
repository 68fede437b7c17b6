"""Headline queries, timed; prints one JSON line.

``BENCH_SF_DIR`` (tables) and ``BENCH_CPUS`` (local threads) set the run,
``BENCH_RUNS`` the repetitions whose median counts. ``rows_per_sec`` counts the
rows a query returns.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "l1_extract_positions",
    "a4_sampling_counters",
    "t21_vocabulary_fingerprint",
    "r2_split_documents",
    "r0_seeded_rank",
    "r9_chunk_numbers",
    "l2_label",
    "u3_encode",
    "j1_join_vectors",
    "l5_build_training",
    "a8_fve_baselines",
    "a9_fve_report",
    "l10_grpo_report",
    "a12_masked_cross_entropy",
    "r12_inject_vectors",
    "l12_roundtrip_eval",
    "l13_fve_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 8)))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    from echoframe.plans import registry
    from echoframe.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before the clock
    took: dict[str, float] = {}
    rows_per_sec: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs):
            begin, seen = time.perf_counter(), Observation()
            registry.PLANS[name](spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        took[name] = round(statistics.median(times), 3)
        rows_per_sec[name] = round(seen.get["rows"] / statistics.median(times), 1)
    result = {
        "metric": "headline_total_seconds",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "rows_per_sec": rows_per_sec,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
