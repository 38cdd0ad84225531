"""Plain indicators over window closes, threshold features and alignment of several symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.functions.scale import with_halo
from ticklattice.operators.transforms import BLOCK_ROWS, KEYS, numbered


def _blocks(df: DataFrame, back: int) -> tuple[DataFrame, W]:
    laid = with_halo(numbered(df), "row", BLOCK_ROWS, back=back, ahead=0)
    return laid, W.partitionBy(*KEYS, "_block").orderBy("row")


def basic_indicators(windows: DataFrame, n: int, value: str = "close") -> DataFrame:
    """Moving average, rate of change against ``n`` rows before, and volatility of the last ``n`` rows."""
    laid, w = _blocks(windows, n)
    frame = w.rowsBetween(-(n - 1), 0)
    before = F.lag(value, n).over(w)
    return laid.select(
        *KEYS, "window_end_ms", "_home", F.avg(value).over(frame).alias("moving_average"),
        F.try_divide(F.col(value) - before, before).alias("rate_of_change"), F.stddev_pop(value).over(frame).alias("volatility"),
    ).where("_home").drop("_home")


def threshold_features(windows: DataFrame, offsets: Sequence[int], thresholds: Sequence[float], value: str = "close") -> DataFrame:
    """Whether the value rose by at least a share against the row some offset before: ``{offset}_up_{percent}p``."""
    laid, w = _blocks(windows, max(offsets))
    cols = []
    for k in offsets:
        before = F.lag(value, k).over(w)
        cols += [(F.try_divide(F.col(value) - before, before) >= p).alias(f"{k}_up_{p * 100:g}p") for p in thresholds]
    return laid.select(*KEYS, "window_end_ms", "_home", *cols).where("_home").drop("_home")


def align_symbols(windows: DataFrame, symbols: Sequence[str], value: str = "close") -> DataFrame:
    """One row per platform, size and window with a column per symbol, null where a symbol has no window."""
    return windows.groupBy("platform", "window_size_ms", "window_end_ms").pivot("symbol", list(symbols)).agg(F.first(value))
