"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "S2_pdsch_events", "S4_measurement_reports", "J1_first_feedback", "J2_consuming_feedback", "J4_nearest_measurement",
    "A1_snr_error_curve", "A9_column_profile", "A15_elevation_means", "W1_running_error_rate", "W3_trailing_means",
    "R1_threshold_argmax_fallback", "R2_throughput", "R8_olla_replay", "R9_allocator_replay", "R11_policy_summary",
    "R13_acceptance_sweep", "L1_empirical_lut_filled", "L2_model_lut", "J10_nearest_snr_cqi", "E3_reliability",
    "E6_areas", "E7_tradeoff", "M1_pass_model", "M10_recommend_with_model", "ST3_per_second",
]


def main() -> None:
    from linkops.catalog import registered
    from linkops.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registered(), {}
    queries["A4_distribution"](spark, sf_dir).collect()  # start-up
    for name in only or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.3f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name,
    }))


if __name__ == "__main__":
    main()
