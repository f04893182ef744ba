"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

    python bench.py            one warm-up, then the best of two runs per query
    python bench.py NAME ...   only these queries
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tickloom import build_session  # noqa: E402
from tickloom.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "csv_scan", "feed_normalise", "clean_rows", "dedup_keep_last", "dq_summary", "dq_outliers", "resample_ohlc", "sma",
    "rolling_volatility", "running_vwap", "ema_span", "macd_hist", "rsi", "lag_features", "feature_registry",
    "book_snapshot", "quote_metrics", "market_impact", "asof_join", "correlation_matrix", "trade_stats", "fifo_pnl",
    "avg_cost_position", "drawdown", "var_bootstrap", "limit_checks", "sig_combine", "pair_discovery", "best_route",
    "option_chain_greeks", "ev_order_state", "st_tick_enrich", "st_event_time_bars",
)


# Queries over the order lines; the others read the events.
ON_LINES = {
    "dedup_keep_last", "book_snapshot", "quote_metrics", "market_impact", "fifo_pnl", "avg_cost_position", "limit_checks",
    "best_route", "option_chain_greeks", "ev_order_state",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("sma")
    seconds = {name: round(min(run(name), run(name)), 3) for name in names}
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "lineitem", "orders")}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"), "rows": rows, "cpus": int(cpus),
        "rows_per_sec": {n: round(rows["lineitem" if n in ON_LINES else "events"] / s) for n, s in seconds.items()},
    }))


if __name__ == "__main__":
    main()
