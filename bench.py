"""Time the headline queries; prints one JSON line.

Settings come from BENCH_SF_DIR and BENCH_CPUS. Each query's rows are all produced (into the no-op sink); one
small query runs first so that session start is not counted against the first headline.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "e1_rms_envelope", "f1_smooth_envelope", "e2_thresholds", "e5_gap_statistics", "g8_automatic_selection",
    "j1_segment_captures", "i13_clipped_runs", "g1_top_events", "i14_impulse_events", "e14_robust_ratio", "d1_ordinal_join",
    "j7_identify_release", "e17_dense_coverage", "e20_typed_metrics", "e21_paired_comparison", "d9_pin_drift",
    "d11_inventory_diff", "j14_catalog_status", "c3_track_contiguity", "f16_feasible_targets", "a4_tracklist_text",
    "a6_match_payload", "i7_cosine_similarity", "i2_window_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from lacquer.registered import load
    from lacquer.session import local_session

    queries, _ = load()
    spark = local_session(cpus, int(cpus), "16g")
    queries["b9_catalog_fields"](spark, sf_dir).limit(1).collect()
    names = sys.argv[1:] or HEADLINES
    times = {}
    for name in names:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
