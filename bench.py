"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each query runs once to warm the JVM at the smallest scale and is
then timed on the full tables; the sink forces every column.
"""

from __future__ import annotations

import json
import os
import time

from beatloom.catalog import QUERIES, load_all
from beatloom.session import local_session

HEADLINE = [
    "flagship_segment_review", "e3_rr_local_spread", "e15_session_split", "e11_trailing_median", "i4_hard_filters",
    "i16_soft_features", "i1_build_peaks", "i2_build_labels", "c8_nearest_within", "c9_asof_nearest_sample",
    "c11_in_intervals", "i7_coverage_subtract", "g2_greedy_dedup", "d9_describe_metrics", "d22_correlation_matrix",
    "l3_time_domain", "l6_frequency_domain", "l7_permutation_entropy", "l12_geometric", "l15_cosinor",
    "k0_snapped_windows", "k2_signal_quality", "k12_beat_matrix", "j1_vagal_arrests", "j2_rsa_events", "j5_ensemble_detector",
    "m7_fuse", "m8_tune_alpha", "n2_roc_auc", "n3_operating_points", "o1_select_candidates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "beatloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in HEADLINE[:3]:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
