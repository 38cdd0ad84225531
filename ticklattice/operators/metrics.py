"""Metric queries over samples: ``metric, labels (map), ts (ms), value`` with the labels taken out into columns.

Range queries are evaluated at steps. A sample adds to every step whose range holds it, so samples are first summed per
series and step, and only these sums are repeated over the steps they reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.functions.scale import lag_one

SLICE_MS = 3_600_000


def label_columns(samples: DataFrame, metric: str, labels: Sequence[str]) -> DataFrame:
    """The samples of one metric with the named labels as columns."""
    return samples.where(F.col("metric") == metric).select(*[F.try_element_at("labels", F.lit(n)).alias(n) for n in labels], "ts", "value")


def _steps(ts: Column, range_ms: int, step_ms: int) -> Column:
    """The evaluation times ``t`` (multiples of the step) with ``t - range < ts <= t``."""
    first = F.ceil(ts / step_ms) * step_ms
    return F.sequence(first.cast("long"), (first + range_ms - step_ms).cast("long"), F.lit(step_ms).cast("long"))


def _over_range(rows: DataFrame, labels: Sequence[str], amount: str, range_ms: int, step_ms: int) -> DataFrame:
    if range_ms % step_ms:
        raise ValueError("the range must be a whole number of steps")
    per_step = rows.groupBy(*labels, (F.ceil(F.col("ts") / step_ms) * step_ms).cast("long").alias("ts")).agg(F.sum(amount).alias(amount))
    reached = per_step.select(*labels, F.explode(_steps(F.col("ts"), range_ms, step_ms)).alias("t"), amount)
    return reached.groupBy(*labels, "t").agg(F.sum(amount).alias(amount))


def _with_previous(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Samples of one time come in order of value, so that a counter's do not look like restarts."""
    sliced = samples.withColumn("_slice", F.floor(F.col("ts") / SLICE_MS))
    return lag_one(sliced, labels, ["ts", "value"], {"prev": "value"}).drop("_slice")


def rate(samples: DataFrame, labels: Sequence[str], range_ms: int, step_ms: int) -> DataFrame:
    """Per-second increase of counters over ``(t - range, t]`` at each step: ``labels, t, rate``.

    A drop is a restart and counts from 0. An increase belongs to the later of its two samples; nothing is extrapolated
    to the range's edges.
    """
    v, prev = F.col("value"), F.col("prev")
    grown = _with_previous(samples, labels).withColumn("rate", F.when(v >= prev, v - prev).when(prev.isNotNull(), v).otherwise(0.0))
    out = _over_range(grown, labels, "rate", range_ms, step_ms)
    return out.withColumn("rate", F.col("rate") / (range_ms / 1000))


def sum_by(rates: DataFrame, labels: Sequence[str], value: str = "rate") -> DataFrame:
    """Rates summed over all series that share the given labels."""
    return rates.groupBy(*labels, "t").agg(F.sum(value).alias(value))


def success_ratio(rates: DataFrame, ok: Column, labels: Sequence[str]) -> DataFrame:
    """Share of the rate that is ``ok``, in percent."""
    good = F.sum(F.when(ok, F.col("rate")).otherwise(0.0))
    return rates.groupBy(*labels, "t").agg(F.try_divide(good * 100, F.sum("rate")).alias("percent"))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], quantiles: Sequence[float], le: str = "le", value: str = "value") -> DataFrame:
    """Quantiles from cumulative buckets (``le`` ascending, the last infinite), linear within a bucket.

    In the last bucket the answer is the highest finite bound. ``keys`` name one histogram, so its buckets are few.
    """
    by_le = W.partitionBy(*keys).orderBy(le)
    rows = buckets.select(
        *keys, F.col(le).alias("le"),
        F.max(value).over(by_le.rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
        F.lag(le).over(by_le).alias("low"), F.max(value).over(W.partitionBy(*keys)).alias("total"),
    ).withColumn("below", F.coalesce(F.lag("upto").over(W.partitionBy(*keys).orderBy("le")), F.lit(0.0)))
    asked = rows.where(F.col("total") > 0).select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile"))
    rank = F.col("quantile") * F.col("total")
    hit = asked.where((F.col("upto") >= rank) & ((F.col("below") < rank) | F.col("low").isNull()))
    low = F.coalesce("low", F.lit(0.0))
    inside = F.when(F.col("low").isNull() & (F.col("le") <= 0), F.col("le")).otherwise(
        low + (F.col("le") - low) * F.try_divide(rank - F.col("below"), F.col("upto") - F.col("below")))
    value_at = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    ranked = hit.groupBy(*keys, "quantile").agg(F.min_by(value_at, "le").alias("value"))
    return ranked


def staleness(samples: DataFrame, labels: Sequence[str], now: Column | float, per_hour: bool = False) -> DataFrame:
    """Seconds (or hours) between ``now`` and each series' newest timestamp value; ``now`` is given in seconds."""
    now = F.lit(now) if isinstance(now, (int, float)) else now
    return samples.groupBy(*labels).agg(((now - F.max("value")) / (3600 if per_hour else 1)).alias("age"))


def topk(samples: DataFrame, k: int, tie: Sequence[str]) -> DataFrame:
    """The ``k`` largest values at each time; equal values in order of the ``tie`` columns."""
    rank = F.row_number().over(W.partitionBy("ts").orderBy(F.desc("value"), *tie))
    return samples.withColumn("rank", rank).where(F.col("rank") <= k)


def changes(samples: DataFrame, labels: Sequence[str], range_ms: int, step_ms: int) -> DataFrame:
    """How often each series' value changed in ``(t - range, t]`` at each step."""
    moved = _with_previous(samples, labels).withColumn("changes", F.coalesce((F.col("value") != F.col("prev")).cast("long"), F.lit(0)))
    return _over_range(moved, labels, "changes", range_ms, step_ms)


def sum_matching(samples: DataFrame, label: str, pattern: str, by: Sequence[str]) -> DataFrame:
    """Sum over the series whose label matches the whole pattern."""
    return samples.where(F.col(label).rlike(f"^(?:{pattern})$")).groupBy(*by, "ts").agg(F.sum("value").alias("value"))


def gauge_ratio(part: DataFrame, whole: DataFrame, labels: Sequence[str], *, of_sum: bool = False) -> DataFrame:
    """``part / whole`` of two series at the same time, or ``part / (part + whole)``."""
    joined = part.select(*labels, "ts", F.col("value").alias("a")).join(whole.select(*labels, "ts", F.col("value").alias("b")), [*labels, "ts"])
    below = F.col("a") + F.col("b") if of_sum else F.col("b")
    return joined.select(*labels, "ts", F.try_divide(F.col("a"), below).alias("ratio"))


def latest(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The newest value of each series."""
    return samples.groupBy(*labels).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
