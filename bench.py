"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line of seconds (median of three warm runs)."""

from __future__ import annotations

import json
import os
import statistics
import time

from harborline.plans import catalog
from harborline.session import local_session

HEADLINE = [
    "supplier_risk", "pillar_scores", "graph_health", "sector_rollup", "event_timeline", "affects_merge_max_conf", "event_supplier_geo_link", "two_hop_exposure", "asof_snapshot", "daily_counts_spine",
    "sliding_window_features", "cusum", "regime_threshold", "linear_trend", "bfs_propagation", "monte_carlo", "percentile_bands", "pearson_corr", "backtest_metrics", "event_classifier",
    "keyword_classifier", "vector_topk", "context_budget", "alert_dedup_fold", "supplier_volume", "order_volume",
    "fuzzy_match", "resolved_links", "chunked_documents", "supply_paths", "vessel_sessions", "reports_after_events", "supplier_explained", "causal_refuters",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
