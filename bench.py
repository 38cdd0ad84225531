"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8). Each query is planned and run to
the end with all its columns; the best of two runs counts, so that JVM warm-up is left out.
"""

from __future__ import annotations

import json
import os
import time

from ticklattice.plans.catalog import QUERIES
from ticklattice.session import build_session

HEADLINE = [
    "trade_windows", "tumbling_trade_window_sizes", "k_offset_join", "flatten_features", "pct_targets", "order_book_state",
    "order_windows", "pair_trade_order", "merge_api_ws_trades", "merge_snapshot_diff", "find_id_holes", "binance_ws_trade",
    "kraken_rest_trades", "strategy_zscore_stepper_fibo_incl", "rate", "histogram_quantile", "prediction_summary", "topk_specialists",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first run pays for the start
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
