"""From single model votes to ranges, directions and confidences per price type, as aggregates over tables.

``votes``: keys, ``target_name``, ``side`` (``neg`` or ``pos``), ``prediction`` 0/1 and ``precision`` of each model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.functions.text import parse_target_name


def confusion(df: DataFrame, keys: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts of true and false negatives and positives per key."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*keys).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def _share(part: str, other: str) -> Column:
    total = F.col(part) + F.col(other)
    return F.when(total > 0, F.try_divide(F.col(part), total)).otherwise(0.0)


def recall(cm: DataFrame) -> DataFrame:
    """Add recall of both classes and their product; an empty class counts 0."""
    out = cm.withColumns({"recall_neg": _share("tn", "fp"), "recall_pos": _share("tp", "fn")})
    return out.withColumn("recall_score", F.col("recall_neg") * F.col("recall_pos"))


def precision(cm: DataFrame) -> DataFrame:
    """Add precision of both classes and their product; a class never predicted counts 0."""
    out = cm.withColumns({"precision_neg": _share("tn", "fn"), "precision_pos": _share("tp", "fp")})
    return out.withColumn("precision_score", F.col("precision_neg") * F.col("precision_pos"))


def score(cm: DataFrame) -> DataFrame:
    """All measures and ``score``, the product of the recall and precision products."""
    return precision(recall(cm)).withColumn("score", F.col("recall_score") * F.col("precision_score"))


def label_stats(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Number of rows and population deviation of the label."""
    return df.groupBy(*keys).agg(F.count("*").alias("training_data_length"), F.stddev_pop(F.col(label).cast("double")).alias("training_data_std"))


def majority_vote(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the class with more votes (0 on a tie), mean precision of the models that agree and their share."""
    ones = votes.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum("prediction").alias("_n1"),
        F.avg(F.when(F.col("prediction") == 1, F.col("precision"))).alias("_p1"),
        F.avg(F.when(F.col("prediction") == 0, F.col("precision"))).alias("_p0"))
    win = F.col("_n1") * 2 > F.col("_n")
    return ones.select(
        *keys, win.cast("int").alias("prediction"),
        F.coalesce(F.when(win, F.col("_p1")).otherwise(F.col("_p0")), F.lit(0.0)).alias("confidence"),
        F.try_divide(F.when(win, F.col("_n1")).otherwise(F.col("_n") - F.col("_n1")), F.col("_n")).alias("agreement"))


def predict_targets(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both votes of each target in one row; a side without models gives class 0 and zeros."""
    voted = majority_vote(votes, [*keys, "target_name", "side"])
    out = voted.groupBy(*keys, "target_name").agg(*[
        F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(0)).alias(f"{s}_{name}")
        for s in ("neg", "pos") for c, name in (("prediction", "prediction"), ("confidence", "confidence"), ("agreement", "model_agreement"))])
    return out


def parsed_targets(predictions: DataFrame) -> DataFrame:
    """Predictions with price type, direction and threshold of their names; other names are left out."""
    parsed = predictions.withColumn("_t", parse_target_name(F.col("target_name"))).where(F.col("_t").isNotNull())
    return parsed.select("*", "_t.price_type", "_t.direction", "_t.threshold").drop("_t")


def threshold_ranges(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per price type and direction the range of thresholds predicted to be reached, null if none.

    Reached means a positive vote with at least half the models agreeing. The range runs from the lowest reached
    threshold to the first one above the highest reached, or to the highest reached if there is none above.
    """
    group = [*keys, "price_type", "direction"]
    hit = (F.col("pos_prediction") == 1) & (F.col("pos_model_agreement") >= 0.5)
    top = F.max(F.when(hit, F.col("threshold"))).over(W.partitionBy(*group))
    rows = parsed.withColumn("_top", top).groupBy(*group).agg(
        F.min(F.when(hit, F.col("threshold"))).alias("range_low"), F.max("_top").alias("_top"),
        F.min(F.when(F.col("threshold") > F.col("_top"), F.col("threshold"))).alias("_next"))
    return rows.select(*group, "range_low", F.when(F.col("range_low").isNotNull(), F.coalesce("_next", "_top")).alias("range_high"))


def first_above(df: DataFrame, keys: Sequence[str], value: str, limit: str) -> DataFrame:
    """The smallest value above a limit per key."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(value) > F.col(limit), F.col(value))).alias("next_value"))


def direction_of(has_up: Column, has_down: Column) -> Column:
    """``volatile`` for both, ``up`` or ``down`` for one, ``stable`` for none."""
    return F.when(has_up & has_down, "volatile").when(has_up, "up").when(has_down, "down").otherwise("stable")


def summarize(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key ranges, direction and confidence of the high and the low price.

    Confidence of ``stable`` is the mean agreement of negative votes that say no, of ``volatile`` one half, of a
    direction the mean confidence of its positive votes that say yes; 0 where there are none.
    """
    keys = list(keys)
    parsed = parsed_targets(predictions)
    ranges = threshold_ranges(parsed, keys)
    kinds = [(t, d) for t in ("high", "low") for d in ("up", "down")]
    wide = ranges.groupBy(*keys).agg(*[
        F.max(F.when((F.col("price_type") == t) & (F.col("direction") == d), F.col(e))).alias(f"{t}_{d}_{e.removeprefix('range_')}")
        for t, d in kinds for e in ("range_low", "range_high")])
    yes = F.col("pos_prediction") == 1
    means = parsed.groupBy(*keys).agg(
        *[F.avg(F.when((F.col("price_type") == t) & (F.col("direction") == d) & yes, F.col("pos_confidence"))).alias(f"_{t}_{d}") for t, d in kinds],
        *[F.avg(F.when((F.col("price_type") == t) & (F.col("neg_prediction") == 0), F.col("neg_model_agreement"))).alias(f"_{t}_stable") for t in ("high", "low")])
    out = wide.join(means, keys)
    for t in ("high", "low"):
        direction = direction_of(F.col(f"{t}_up_low").isNotNull(), F.col(f"{t}_down_low").isNotNull())
        out = out.withColumn(f"{t}_direction", direction)
        d = F.col(f"{t}_direction")
        out = out.withColumn(f"{t}_confidence", F.when(d == "volatile", 0.5).otherwise(F.coalesce(
            F.when(d == "stable", F.col(f"_{t}_stable")).when(d == "up", F.col(f"_{t}_up")).otherwise(F.col(f"_{t}_down")), F.lit(0.0))))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def prediction_time(window_end_ms: Column, window_size_ms: Column, ahead: int = 3) -> Column:
    """The time a prediction is for: ``ahead`` windows after the one it was made at."""
    return window_end_ms + window_size_ms * ahead


# --- stored results --------------------------------------------------------------------------------------------------

def with_artifacts(results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Results that have a stored model."""
    return results.join(artifacts.select("result_id"), "result_id", "left_semi")


def distinct_targets(results: DataFrame, window_size_ms: int, methodology: str = "decision_tree") -> DataFrame:
    """Names of the targets with results, in order, per platform and symbol."""
    picked = results.where((F.col("window_size_ms") == window_size_ms) & (F.col("methodology") == methodology))
    return picked.select("platform", "symbol", "target_name").distinct().orderBy("platform", "symbol", "target_name")


def top_specialists(results: DataFrame, k: int = 3, *, window_size_ms: int = 30_000, methodology: str = "decision_tree") -> DataFrame:
    """Per platform, symbol and target the ``k`` results with the highest precision of each class, as ``side``."""
    picked = results.where((F.col("window_size_ms") == window_size_ms) & (F.col("methodology") == methodology))
    sides = picked.select("*", F.explode(F.array(
        F.struct(F.lit("neg").alias("side"), F.col("precision_neg").alias("precision")),
        F.struct(F.lit("pos").alias("side"), F.col("precision_pos").alias("precision")))).alias("_s")).select("*", "_s.*").drop("_s")
    rank = F.row_number().over(W.partitionBy("platform", "symbol", "target_name", "side").orderBy(F.desc("precision"), "result_id"))
    return sides.withColumn("rank", rank).where(F.col("rank") <= k)


def max_training_length(results: DataFrame, keys: Sequence[str], default: int = 2000) -> DataFrame:
    """Rows a prediction has to look back: the longest training among the given results."""
    longest = F.max("training_data_length")
    return results.groupBy(*keys).agg(F.when(longest > 0, longest).otherwise(default).alias("max_training_length"))


def top_per_dimension(results: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` best feature sets of each dimension by score, equal ones by name."""
    rank = F.row_number().over(W.partitionBy(*keys, "dimension").orderBy(F.desc("score"), "features"))
    return results.withColumn("rank", rank).where(F.col("rank") <= n)


def best_to_store(results: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Of the best set of each dimension those with a score above 0, and of them the ``k`` highest."""
    best = top_per_dimension(results, 1, keys).where(F.col("score") > 0).drop("rank")
    rank = F.row_number().over(W.partitionBy(*[F.col(c) for c in keys] or [F.lit(1)]).orderBy(F.desc("score"), "dimension"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def expand_feature_sets(bases: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each base set with one more feature, every resulting set once and sorted."""
    everything = F.array(*[F.lit(f) for f in features])
    more = bases.select("features", F.explode(F.array_except(everything, F.col("features"))).alias("_f"))
    return more.select(F.array_sort(F.array_union("features", F.array("_f"))).alias("features")).distinct()
