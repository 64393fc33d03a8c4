"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sensorloom.plans import catalog
from sensorloom.session import local_session

HEADLINE = [
    "flagship", "q_severity_counts", "q_gaps", "q_coverage", "q_tw_mean", "q_features", "q_constant_run", "q_flatline", "q_mad_baseline", "q_screen",
    "q_regime_screen", "q_spc_run9", "q_segment", "q_grid_align", "q_mspc_t2spe", "q_pair_corr", "q_level_shift", "q_block_sums", "q_martingale", "q_ranking_auc", "q_replay_diff",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "bench")
    run = {"flagship": catalog.flagship} | catalog.QUERIES
    run["flagship"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
