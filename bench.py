"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from barloom.plans import catalog

HEADLINE = [
    "entry_latest_scores", "s12_resample_hourly", "s12_resample_daily", "indicator_set_hourly", "indicator_set_daily",
    "w12_macd_ema", "w16_fill_missing", "w18_sequences", "p05_price_history", "t01_latest_price", "t02_last_60_rows", "t04_latest_chain",
    "j05_underlying_as_of", "j06_quotes_with_sector", "q03_q07_greeks", "q08_with_greeks", "q09_implied_vol", "q10_expected_move",
    "x01_sql_functions", "q11_payoff_european", "q13_var_cvar", "q17_max_pain", "v01_validate_bars", "v02_validate_quotes", "v05_outliers_iqr",
    "a01_mape_over_time", "a08_regression_metrics", "a15_draw_summary", "k04_merge_updates", "k08_quote_points",
    "m02_train_per_symbol", "m04_forecast_ar", "m10_drift", "r08_signals_short", "r11_strategy_legs", "r12_r14_expiry_strategies",
    "s13_adjust_bars", "q17_iv_percentile", "q11_payoff_down_out", "m03_predict_per_symbol", "m05_ar_orders", "t07_market_movers",
    "st02_stateful_indicators", "st07_upsert_stream", "m02_ridge_choice", "m05_arma_orders", "q11_many_european", "s12_st10_rolled_bars",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            # The noop sink computes every row and column without moving them to the driver.
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_median_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
