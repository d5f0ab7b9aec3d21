"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelight.plans.registry import all_queries  # noqa: E402
from tidelight.session import local_session  # noqa: E402

HEADLINE = [
    "event_table", "event_table_rolling", "rebin_switch", "sigma_clip_baseline", "rolling_baseline", "islands",
    "outburst_report", "lomb_scargle", "candidate_periodic", "pulse_fit", "cumulative_trapezoid_t90",
    "nearest_pairs", "phase_pairs_rise", "percentile_baseline", "wls_loglog", "fixed_effects_beta",
    "forward_sim", "forward_sim_tapered", "hardness_ratio", "hardness_in_spans", "mag_to_flux",
    "cone_nearest", "cone_best_catalog", "cone_archives", "positional_dedup", "classify_sources",
    "parse_name", "canonical_key", "name_variants", "html_links", "first_wins_dedup", "histogram_bins",
    "class_label_sets", "tier_summary", "band_conditional_stats", "chunked_union_distinct", "stored_spans",
    "whitespace_table", "event_simulation", "event_fit", "hardness_series", "four_panels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    found = all_queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_wall", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
