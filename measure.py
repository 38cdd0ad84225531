"""Times trade windows over a trade table grown to a given number of rows by replication.

``python measure.py [rows] [sf_dir]``; the table is written to a fresh folder under /tmp and left for its clean-up.
"""

from __future__ import annotations

import sys
import tempfile
import time

from pyspark.sql import functions as F

from ticklattice.operators.trade_windows import trade_windows
from ticklattice.plans.views import WINDOW_MS, trades
from ticklattice.session import build_session


def main(rows: int, sf_dir: str) -> None:
    spark = build_session("measure", cores="8", shuffle_partitions=32)
    spark.sparkContext.setLogLevel("ERROR")
    base = trades(spark, sf_dir)
    n, span = base.count(), 31 * 86_400_000
    copies = -(-rows // n)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/trades"
    # each copy is a month later and has ids of its own, so windows stay as full as they are
    grown = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    grown.withColumn("time_ms", F.col("time_ms") + F.col("copy") * span).withColumn(
        "platform_trade_id", F.col("platform_trade_id") + F.col("copy") * n).drop("copy").repartition(32).write.parquet(path)
    table = spark.read.parquet(path)
    for size in (1000, WINDOW_MS):
        start = time.perf_counter()
        trade_windows(table, size).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        print(f"{n * copies} trades into {size} ms windows: {took:.1f} s, {n * copies / took:,.0f} rows/s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 20_000_000, sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1")
