"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from seriesloom.plans.catalog import REGISTRY
from seriesloom.session import local_session

HEADLINE = (
    "feature_rows", "hourly_grid_ffill", "dedupe_keep_first", "calendar_season", "lag_ratios",
    "rolling_stats", "robust_z", "shape", "summary_of_numbers", "corr_pairs", "fold_assignment",
    "lookback", "baseline_forecasts", "walkforward_metrics", "multi_horizon_metrics",
    "block_backtest_rank", "merge_forecasts_outer", "peak_scores", "month_peaks_view", "dm_pairs",
    "rank_fusion", "decomposition", "kpss_levels", "adf_levels", "linear_ar_forecast",
    "gbt_forecast", "perm_importance", "hourly_frames", "walk_forward_linear", "block_backtest_linear",
    "block_backtest_models", "perm_importance_linear", "perm_importance_sarimax", "ar_one_lag",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's code paths; no result is kept from it.
    REGISTRY["volatility"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
