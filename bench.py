"""Headline timings: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelcast.queries import QUERIES  # noqa: E402
from panelcast.session import build_session  # noqa: E402

HEADLINE = [
    "etl_observations", "weekly_features", "extended_features", "jn13_nearest_fill", "fc01_seasonal_naive",
    "fc02_trend_seasonal", "fc03_sarima", "fc05_forecast_panel", "fc07_backtest", "fc07_backtest_all_models",
    "agg05_model_ranking", "agg06_metric_distribution", "agg10_forecast_summary", "agg16_seasonal_profile",
    "tp04_candidate_pairs", "tp05_greedy_log", "inc01_fingerprint", "inc02_forecast_ledger", "str01_name_key",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["weekly_features"](spark, sf_dir).limit(1).collect()  # start-up is not part of any query
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # noop runs the whole plan, all columns included, without moving rows to the driver
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
