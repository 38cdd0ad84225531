"""Chronological splits, z-scores and lag features over the rows of each key in time order.

Rows are numbered per key (0, 1, 2, …) without sorting a key in one task, and row lags run in blocks of consecutive
rows with a rim from the block before. A frame as long as the training part is taken as a difference of running sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.functions.scale import running, with_halo

KEYS = ["platform", "symbol", "window_size_ms"]
FIBO_LAGS = (2, 3, 5, 8, 13)  # fixed values
BLOCK_ROWS = 4096


def _sliced(df: DataFrame) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col("window_end_ms") / (F.col("window_size_ms") * BLOCK_ROWS)))


def numbered(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``row`` (0-based, in time order) and ``rows`` (how many the key has)."""
    keys = list(keys)
    sliced = _sliced(df)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    of_key = W.partitionBy(*keys)
    starts = counts.select(
        *keys, "_slice", F.sum("_n").over(of_key).alias("rows"),
        F.coalesce(F.sum("_n").over(of_key.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy("window_end_ms"))
    out = sliced.withColumn("_i", inside).join(starts, [*keys, "_slice"])
    return out.select(*df.columns, (F.col("_before") + F.col("_i") - 1).alias("row"), "rows")


def chrono_split(df: DataFrame, test_size: float = 0.10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number the rows and mark the last ``max(1, ceil(rows * test_size))`` of each key as test rows."""
    tests = F.greatest(F.lit(1), F.ceil(F.col("rows").cast("double") * F.lit(float(test_size)))).cast("long")
    return numbered(df, keys).withColumn("n_train", F.col("rows") - tests).withColumn("is_test", F.col("row") >= F.col("n_train"))


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last ``n`` rows of each key by time."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("window_end_ms")))
    return df.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def holdout(df: DataFrame, n: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mark each key's last ``n`` rows as held out."""
    return numbered(df, keys).withColumn("held_out", F.col("row") >= F.col("rows") - n).drop("row", "rows")


def _safe(std: Column) -> Column:
    return F.when(std == 0, 1.0).otherwise(std)


def zscore(split: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Columns minus mean over deviation. ``split`` comes from ``chrono_split``.

    Training rows use the mean and population deviation of all training rows of their key. Test row ``i`` uses those of
    the ``n_train`` rows that end with it. A deviation of 0 counts as 1. Where a row's frame holds a value that is infinite
    or not a number, its result is not a number.
    """
    keys, columns = list(keys), list(columns)
    rest = [c for c in split.columns if c not in columns]
    n, is_test, row = F.col("n_train"), F.col("is_test"), F.col("row")
    nth = list(enumerate(columns))
    unbounded = lambda c: ~(F.abs(F.col(f"`{c}`")) < float("inf"))  # noqa: E731  # not a number is above all others
    finite = lambda c: F.when(~unbounded(c), F.col(f"`{c}`"))
    stats = split.where(~is_test).groupBy(*keys).agg(
        *[F.coalesce(F.avg(finite(c)), F.lit(0.0)).alias(f"_m{i}") for i, c in nth],
        *[F.coalesce(F.stddev_pop(finite(c)), F.lit(0.0)).alias(f"_s{i}") for i, c in nth],
        *[F.count_if(unbounded(c)).alias(f"_u{i}") for i, c in nth])
    joined = split.join(stats, keys)
    train = joined.where(~is_test).select(*rest, *[
        F.when(F.col(f"_u{i}") == 0, (F.col(f"`{c}`") - F.col(f"_m{i}")) / _safe(F.col(f"_s{i}"))).otherwise(F.lit(float("nan"))).alias(c)
        for i, c in nth])

    # The frame of test row i is the training part without its first i + 1 rows and with the first i + 1 test rows. So
    # only those two ends are looked at: each pair changes the moments of the training part, and the changes add up. Moments
    # are those of the finite values; how many others a frame holds is counted beside them.
    pos = F.when(is_test, row - n).otherwise(row)
    ends = joined.where(is_test | (row < F.col("rows") - n)).withColumn("_pos", pos)
    centred = {i: F.coalesce(finite(c) - F.col(f"_m{i}"), F.lit(0.0)) for i, c in nth}
    sign = F.when(is_test, 1).otherwise(-1)
    pairs = ends.groupBy(*keys, "_pos").agg(
        *[F.sum(sign * centred[i]).alias(f"_a{i}") for i, _ in nth], *[F.sum(sign * centred[i] * centred[i]).alias(f"_q{i}") for i, _ in nth],
        *[F.sum(F.when(unbounded(c), sign).otherwise(0)).alias(f"_b{i}") for i, c in nth],
        F.max_by(F.struct(*rest, *[F.col(f"`{c}`") for c in columns], *[f"_{k}{i}" for k in "msu" for i, _ in nth]), is_test.cast("int")).alias("_t"))
    sums = {f"_{k}{i}_upto": ("sum", F.col(f"_{k}{i}")) for i, _ in nth for k in ("a", "q", "b")}
    moved = running(pairs.withColumn("_slice", F.floor(F.col("_pos") / BLOCK_ROWS)), keys, ["_pos"], sums)
    length = F.col("_t.n_train")
    out = []
    for i, c in nth:
        mean_c = F.try_divide(F.col(f"_a{i}_upto"), length)
        square = F.try_divide(F.col(f"_q{i}_upto"), length) + F.pow(F.col(f"_t._s{i}"), F.lit(2)) * F.try_divide(length - F.col(f"_t._u{i}"), length)
        var = square - mean_c * mean_c
        std = F.sqrt(F.when(var > square * 1e-12, var).otherwise(0.0))
        whole = F.col(f"_t._u{i}") + F.col(f"_b{i}_upto") == 0
        out.append(F.when(whole, (F.col(f"_t.`{c}`") - F.col(f"_t._m{i}") - mean_c) / _safe(std)).otherwise(F.lit(float("nan"))).alias(c))
    test = moved.where("_t.is_test").select(*[F.col(f"_t.`{c}`").alias(c) for c in rest], *out)
    return train.unionByName(test)


def _lags(df: DataFrame, columns: Sequence[str], lags: Sequence[int], keys: Sequence[str], build: Callable[..., Column],
          label: str, keep: bool) -> DataFrame:
    """Columns built from each value and its lags; a lag before the first row is 0."""
    far = max(lags) * (2 if label.startswith("doubled") else 1)
    laid = with_halo(df, "row", BLOCK_ROWS, back=far, ahead=0)
    w = W.partitionBy(*keys, "_block").orderBy("row")
    at = lambda c, k: F.lag(f"`{c}`", k, 0.0).over(w)
    made = [build(F.col(f"`{c}`"), at, c, lag).alias(f"{c}__{label}_{lag}") for lag in lags for c in columns]
    rest = [c for c in df.columns if keep or c not in columns]
    return laid.select(*[F.col(f"`{c}`") for c in rest], "_home", *made).where("_home").drop("_home")


def _sign(difference: Column) -> Column:
    """1, 0 or -1; 0 where the difference is not a number, as between two equal infinities."""
    return F.signum(F.nanvl(difference, F.lit(0.0))) + 0.0


_BUILDERS: dict[str, Callable[..., Column]] = {
    "stepper": lambda x, at, c, lag: F.when(x > at(c, lag), 1.0).otherwise(0.0),
    "diff": lambda x, at, c, lag: _sign(at(c, lag) - x),
    "doubled_stepper": lambda x, at, c, lag: F.when(at(c, lag) > at(c, 2 * lag), 1.0).otherwise(0.0),
    "doubled_diff": lambda x, at, c, lag: _sign(at(c, 2 * lag) - at(c, lag)),
}


def lag_features(df: DataFrame, columns: Sequence[str], kind: str, *, lags: Sequence[int] = FIBO_LAGS, keep: bool = False,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """One column per value and lag: ``stepper`` (above its lag), ``diff`` (sign of lag minus value) or their ``doubled``
    forms, which compare the lag with twice the lag. ``df`` has ``row``; ``keep`` keeps the values too."""
    return _lags(df, columns, lags, keys, _BUILDERS[kind], kind, keep)


def drop_warmup(df: DataFrame, rows: int) -> DataFrame:
    """Leave out the first training rows, whose lags reach before the data."""
    return df.where(F.col("is_test") | (F.col("row") >= rows))


def _strategy(kind: str | None, keep: bool) -> Callable[..., DataFrame]:
    def apply(split: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
        scored = zscore(split, columns, keys)
        if kind is None:
            return scored
        far = max(FIBO_LAGS) * (2 if kind.startswith("doubled") else 1)
        return drop_warmup(lag_features(scored, columns, kind, keep=keep, keys=keys), far)

    return apply


# Every strategy takes rows from ``chrono_split`` and gives rows with the transformed columns.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"zscore": _strategy(None, True)} | {
    f"zscore_{kind}_fibo{suffix}": _strategy(kind, keep)
    for kind in _BUILDERS
    for suffix, keep in (("", False), ("_incl", True))
}


def transform(split: DataFrame, strategy: str, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown transformation strategy: {strategy}")
    return STRATEGIES[strategy](split, columns, keys)


def transformed_columns(strategy: str, columns: Sequence[str]) -> list[str]:
    """The column names a strategy puts out."""
    if strategy == "zscore":
        return list(columns)
    kind = strategy.removeprefix("zscore_").removesuffix("_incl").removesuffix("_fibo")
    made = [f"{c}__{kind}_{lag}" for lag in FIBO_LAGS for c in columns]
    return [*columns, *made] if strategy.endswith("_incl") else made
