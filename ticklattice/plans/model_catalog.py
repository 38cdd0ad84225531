"""Queries that train and apply models on the gold table of all keys.

What a tree predicts is no SQL, so each query returns what SQL can say of it: the rows and classes it was trained and tested on,
the class weights, that its measures follow from its confusion counts, which sets a search tried, and that stored models
are the ones that were trained. The search's breadth is bounded here by ``TRADE``, ``ORDER``, ``TOP_N`` and ``DIMENSIONS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.operators import features as ft
from ticklattice.operators import models as ml
from ticklattice.operators import predict as pr
from ticklattice.plans.book_catalog import GOLD_CTE, gold
from ticklattice.plans.registry import query
from ticklattice.plans.views import WINDOW_MS, cte
from ticklattice.plans.windows_catalog import K, shifted_sql
from ticklattice.session import scratch_path, stored
from ticklattice.sources import results as rs

LOOKBACK = 12
TRADE = {f: 0.0 for f in ("sum_vol", "close", "high", "sum_logret")}
ORDER = {f: 0.0 for f in ("close_mid", "sw_imb")}
TOP_N, DIMENSIONS, KEEP, LAST = 2, 2, 3, 20
SHIFTS = range(-LOOKBACK, 1)
GROUPS = {f"{p}_{f}": [f"{k}_{p}_{f}" for k in SHIFTS] for p, fs in (("t", TRADE), ("o", ORDER)) for f in fs}
LABEL, OTHER_LABEL = "target_high_up_5p", "target_low_down_5p"
RULES = {n: x for n, x in ft.pct_rules([0.5], [-0.5]).items()}

# Labelled rows of the gold table with both labels, numbered in time and split as for training.
SPLIT = f"""
wide AS ({shifted_sql(["close", "high", "low"], [*range(-5, 1), 3, 4, 5], "gold")}),
moves AS (SELECT {K}, coalesce(high_p3, high_p4, high_p5) AS next_high, coalesce(high_p0, high_m1, high_m2, high_m3, high_m4, high_m5) AS past_high,
                 coalesce(low_p3, low_p4, low_p5) AS next_low, coalesce(low_p0, low_m1, low_m2, low_m3, low_m4, low_m5) AS past_low FROM wide),
placed AS (SELECT {K}, coalesce((next_high - past_high) / past_high >= 0.5, false) AS {LABEL},
                  coalesce((next_low - past_low) / past_low <= -0.5, false) AS {OTHER_LABEL},
                  row_number() OVER (PARTITION BY platform, symbol, window_size_ms ORDER BY window_end_ms) - 1 AS place,
                  count(*) OVER (PARTITION BY platform, symbol, window_size_ms) AS n
           FROM moves WHERE next_high IS NOT NULL AND past_high IS NOT NULL),
split AS (SELECT *, place >= n - greatest(1, CAST(ceil(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS is_test FROM placed)"""
MODEL_CTE = (*GOLD_CTE, SPLIT)


def _counts_sql(label: str, method: str) -> str:
    n, n1 = "count(*) FILTER (NOT is_test)", f"count(*) FILTER (NOT is_test AND {label})"
    return f"""SELECT '{label}' AS target_name, '{method}' AS methodology, {n} AS train_rows, {n1} AS train_pos,
       round({n} / (2 * ({n} - {n1})), 9) AS weight_neg, round({n} / (2 * {n1}), 9) AS weight_pos,
       count(*) FILTER (is_test AND NOT {label}) AS test_neg, count(*) FILTER (is_test AND {label}) AS test_pos, true AS measures_follow FROM split"""


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def _shared(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """A derived table written once per application, as the gold table and the design table would be."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _TABLES:
        _TABLES[key] = stored(make(), name)
    return _TABLES[key]


def _design(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows of all keys: one model is trained over all of them."""
    windows = _shared(spark, sf, "gold", lambda: gold(spark, sf))
    return _shared(spark, sf, "design", lambda: ml.design_table(windows, RULES, lookback=LOOKBACK, trade_fields=TRADE, order_fields=ORDER))


_PREPARED: dict[str, ml.Prepared] = {}


def _prepared(design: DataFrame) -> ml.Prepared:
    key = f"{design.sparkSession.sparkContext.applicationId} {id(design)}"
    if key not in _PREPARED:
        _PREPARED[key] = ml.prepare(design, list(RULES), GROUPS, lookback=LOOKBACK)
    return _PREPARED[key]


def _follow(m: dict) -> bool:
    """Whether a model's measures are those of its confusion counts."""
    tn, fp, fn, tp = (m[f"confusion_matrix_{k}"] for k in ("tn", "fp", "fn", "tp"))
    share = lambda a, b: a / (a + b) if a + b else 0.0
    recall, precision = share(tn, fp) * share(tp, fn), share(tn, fn) * share(tp, fp)
    want = {"recall_score": recall, "precision_score": precision, "score": recall * precision}
    return all(abs(m[k] - v) < 1e-12 for k, v in want.items() if k in m)


def _rows(prepared: ml.Prepared, built: list[ml.Built]) -> DataFrame:
    """What a model was trained and tested on; the class weights are read from the weighted training rows."""
    spark = prepared.rows.sparkSession
    rows = []
    for b in built:
        m, label = b.metrics, b.metrics["target_name"]
        weights = {r[label]: (r["n"], r["w"]) for r in ml.balanced(prepared.rows.where("NOT is_test"), label).groupBy(label).agg(
            F.count("*").alias("n"), F.max("weight").alias("w")).collect()}  # two classes
        cm = {k: m[f"confusion_matrix_{k}"] for k in ("tn", "fp", "fn", "tp")}
        rows.append((label, m["methodology"], m["training_data_length"], weights[1.0][0], round(weights[0.0][1], 9), round(weights[1.0][1], 9),
                     cm["tn"] + cm["fp"], cm["fn"] + cm["tp"], _follow(m)))
    return spark.createDataFrame(rows, "target_name string, methodology string, train_rows long, train_pos long, weight_neg double, weight_pos double, "
                                       "test_neg long, test_pos long, measures_follow boolean")


@query("train_decision_tree", cte(*MODEL_CTE) + _counts_sql(LABEL, "decision_tree"))
def _m1(spark, sf):
    prepared = _prepared(_design(spark, sf))
    return _rows(prepared, [ml.build(prepared, list(GROUPS), LABEL)])


@query("train_random_forest", cte(*MODEL_CTE) + _counts_sql(LABEL, "random_forest"))
def _m2(spark, sf):
    prepared = _prepared(_design(spark, sf))
    return _rows(prepared, [ml.build(prepared, list(GROUPS), LABEL, "random_forest")])


@query("compare_baselines", cte(*MODEL_CTE) + " UNION ALL ".join(
    _counts_sql(x, m) for x in (LABEL, OTHER_LABEL) for m in ("decision_tree", "random_forest")))
def _m4(spark, sf):
    prepared = _prepared(_design(spark, sf))
    return _rows(prepared, ml.compare_baselines(prepared, [LABEL, OTHER_LABEL]))


# Every single group, then the best ones each with one more: of two bases one set is the same.
N = len(GROUPS)


@query("greedy_feature_search", cte(*MODEL_CTE) + f"""
SELECT d.dimension, d.sets, d.sets * count(*) FILTER (is_test AND NOT {LABEL}) AS test_neg, d.sets * count(*) FILTER (is_test AND {LABEL}) AS test_pos,
       true AS sets_differ FROM split, (VALUES (1, {N}), (2, {TOP_N * (N - 1) - 1})) AS d(dimension, sets) GROUP BY d.dimension, d.sets""")
def _m3(spark, sf):
    found = ml.greedy_search(_prepared(_design(spark, sf)), LABEL, top_n=TOP_N, max_dimension=DIMENSIONS)
    tried = ml.search_results(found, spark)
    return tried.groupBy("dimension").agg(
        F.count("*").cast("int").alias("sets"), F.sum(F.col("tn") + F.col("fp")).alias("test_neg"), F.sum(F.col("fn") + F.col("tp")).alias("test_pos"),
        (F.countDistinct("features") == F.count("*")).alias("sets_differ"))


def _trained(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, str]:
    design = _design(spark, sf)
    root = scratch_path(spark, "models")
    empty = spark.createDataFrame([], rs.RESULT_SCHEMA)
    results = ml.train_and_store(_prepared(design), LABEL, ft.span_and_keys(design), empty, root, platform="all", symbol="all",
                                 window_size_ms=WINDOW_MS, top_n=TOP_N, max_dimension=DIMENSIONS, keep=KEEP)
    return design, results, root


@query("train_and_store", cte(*MODEL_CTE) + f"""
SELECT 'all' AS platform, 'all' AS symbol, '{LABEL}' AS target_name, 'decision_tree' AS methodology, min(window_end_ms) AS window_start,
       max(window_end_ms) AS window_end, CAST({WINDOW_MS} AS BIGINT) AS window_size_ms, {LOOKBACK} AS lookback,
       count(*) FILTER (NOT is_test) AS train_rows, round(stddev_pop(CAST({LABEL} AS DOUBLE)) FILTER (NOT is_test), 9) AS train_std,
       count(*) FILTER (is_test AND NOT {LABEL}) AS test_neg, count(*) FILTER (is_test AND {LABEL}) AS test_pos, true AS kept_few FROM split""")
def _m5(spark, sf):
    """The stored results, which agree in all but their features and counts."""
    results = _trained(spark, sf)[1]
    cm = lambda *ks: sum(F.col(f"confusion_matrix_{k}") for k in ks)
    same = ["platform", "symbol", "target_name", "methodology", "window_start", "window_end", "window_size_ms",
            F.col("used_features_lookback").alias("lookback"), F.col("training_data_length").alias("train_rows"),
            F.round("training_data_std", 9).alias("train_std"), cm("tn", "fp").alias("test_neg"), cm("fn", "tp").alias("test_pos")]
    rows = results.select(*same)
    return rows.groupBy(*rows.columns).agg(F.count("*").between(1, KEEP).alias("kept_few"))


def _specialists(results: DataFrame, root: str):
    top = pr.top_specialists(results, KEEP, window_size_ms=WINDOW_MS)
    # A handful of models: at most 2 KEEP per target.
    return [(row["result_id"], rs.load_model(root, row["result_id"]), row["side"], row["precision"], list(row["used_features"]))
            for row in top.select("result_id", "side", "precision", "used_features").toLocalIterator()]


def _votes(spark: SparkSession, sf: str, last: int) -> DataFrame:
    design, results, root = _trained(spark, sf)
    rows = stored(ml.latest_rows(design, [c for cols in GROUPS.values() for c in cols], last), "rows")
    return ml.predict_rows([m[:4] for m in _specialists(results, root)], rows, LABEL)


@query("load_specialists", "SELECT 0 AS missing, 0 AS not_of_two_stages, 0 AS with_other_features")
def _m6(spark, sf):
    """Every stored result's model can be loaded and has the columns of the result's features."""
    _, results, root = _trained(spark, sf)
    loaded = {i: (model, used) for i, model, _, _, used in _specialists(results, root)}
    ids = {r[0] for r in results.select("result_id").collect()}  # KEEP rows at most
    wrong = sum(len(m.stages[0].getInputCols()) != sum(len(GROUPS[g]) for g in used) for m, used in loaded.values())
    row = (len(ids - set(loaded)), sum(len(m.stages) != 2 for m, _ in loaded.values()), wrong)
    return spark.createDataFrame([row], "missing int, not_of_two_stages int, with_other_features int")


@query("artifact_store_load", cte(*MODEL_CTE) + "SELECT count(*) FILTER (is_test) AS rows_compared, 0 AS rows_that_differ FROM split")
def _s20(spark, sf):
    """A stored model gives the predictions of the one it was saved from."""
    prepared = _prepared(_design(spark, sf))
    built = ml.build(prepared, list(GROUPS), LABEL)
    root = scratch_path(spark, "models")
    rs.save_model(built.model, root, 1)
    pick = lambda m, name: m.transform(prepared.rows.where("is_test")).select(*ml.ID, F.col("prediction").alias(name))
    both = pick(built.model, "saved").join(pick(rs.load_model(root, 1), "loaded"), ml.ID)
    return both.agg(F.count("*").alias("rows_compared"), F.count_if(~F.col("saved").eqNullSafe(F.col("loaded"))).cast("int").alias("rows_that_differ"))


@query("predict_specialist", cte(*MODEL_CTE) + f"SELECT {K}, true AS voted FROM split WHERE place = n - 1")
def _m7(spark, sf):
    """Each key's latest row, and whether all specialists voted on it with 0 or 1."""
    votes = _votes(spark, sf, 1)
    return votes.groupBy(*ml.ID).agg((F.bool_and(F.col("prediction").isin(0, 1)) & (F.count("*") == F.countDistinct("result_id", "side"))).alias("voted"))


@query("holdout_predict", cte(*MODEL_CTE) + f"""
SELECT {K}, window_end_ms + 3 * window_size_ms AS prediction_for, true AS predicted FROM split WHERE place >= n - {LAST}""")
def _m13(spark, sf):
    predicted = pr.predict_targets(_votes(spark, sf, LAST), ml.ID)
    out = predicted.withColumn("prediction_for", pr.prediction_time(F.col("window_end_ms"), F.col("window_size_ms")))
    return out.select(*ml.ID, "prediction_for", (F.col("neg_prediction").isin(0, 1) & F.col("pos_prediction").isin(0, 1)).alias("predicted"))
