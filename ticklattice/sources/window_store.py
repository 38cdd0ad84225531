"""The stored window table: parquet in directories named by the start date of a 180-day bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_MS = 180 * 86_400_000


def with_bucket(windows: DataFrame) -> DataFrame:
    start = F.floor(F.col("window_end_ms") / BUCKET_MS) * BUCKET_MS
    return windows.withColumn("date", F.date_format(F.timestamp_millis(start.cast("long")), "yyyy-MM-dd"))


def write_windows(windows: DataFrame, path: str, *, max_rows_per_file: int = 500_000, mode: str = "append") -> None:
    """Write windows so that a bucket's files are cut by platform, symbol and time and can be skipped by statistics."""
    laid = with_bucket(windows).repartitionByRange("date", "platform", "symbol", "window_end_ms")
    laid.sortWithinPartitions("date", "platform", "symbol", "window_end_ms").write.mode(mode).option(
        "maxRecordsPerFile", max_rows_per_file).partitionBy("date").parquet(path)


def scan_complete(spark: SparkSession, path: str, *, from_ms: int, to_ms: int, platform: str | None = None,
                  value: str = "trade_features") -> DataFrame:
    """Stored windows with a value, in a time range and of one platform. All conditions reach the parquet scan."""
    first, last = from_ms // BUCKET_MS * BUCKET_MS, to_ms // BUCKET_MS * BUCKET_MS
    day = lambda ms: F.date_format(F.timestamp_millis(F.lit(ms)), "yyyy-MM-dd")
    df = spark.read.option("basePath", path).parquet(path)
    df = df.where((F.col("date").cast("string") >= day(first)) & (F.col("date").cast("string") <= day(last)))
    df = df.where((F.col("window_end_ms") >= from_ms) & (F.col("window_end_ms") <= to_ms) & F.col(value).isNotNull())
    return df.where(F.col("platform") == platform) if platform else df
