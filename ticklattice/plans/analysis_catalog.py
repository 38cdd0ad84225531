"""Queries over transforms, metrics, votes, stored results and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.operators import indicators as ind
from ticklattice.operators import metrics as mx
from ticklattice.operators import predict as pr
from ticklattice.operators import transforms as tf
from ticklattice.operators.features import ORDER_FIELDS, TRADE_FIELDS
from ticklattice.plans.feeds_catalog import LOG, log
from ticklattice.plans.registry import add, query
from ticklattice.plans.views import TRADES, WINDOW_MS, cte, millis, platform_of, symbol_of, table
from ticklattice.plans.windows_catalog import KEYS, TRADE_WINDOWS, K, r, rs, trade_gold

S = ["platform", "symbol"]

# --- transforms ------------------------------------------------------------------------------------------------------

VALUES = list(TRADE_FIELDS)
#: For lags of z-scores: fields whose values hardly ever repeat, as two engines' z-scores of equal values differ in their last bits and so in sign.
LAGGED = ["sum_vol", "sum_pv", "sum_price", "sum_price2", "open", "high", "low", "close"]
_PLAIN = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in VALUES)
SPLIT = f"""
base AS (SELECT platform, symbol, window_size_ms, window_end_ms, {_PLAIN},
                row_number() OVER w - 1 AS row, count(*) OVER (PARTITION BY platform, symbol) AS rows
         FROM trade_windows WINDOW w AS (PARTITION BY platform, symbol ORDER BY window_end_ms)),
split AS (SELECT *, rows - CAST(greatest(1, ceil(rows * 0.1::DOUBLE)) AS BIGINT) AS n_train,
                 row >= rows - CAST(greatest(1, ceil(rows * 0.1::DOUBLE)) AS BIGINT) AS is_test FROM base)"""


def _z(c: str) -> str:
    train = f"FILTER (NOT is_test) OVER (PARTITION BY platform, symbol)"
    frame = "OVER (PARTITION BY platform, symbol ORDER BY row ROWS BETWEEN (n_train - 1) PRECEDING AND CURRENT ROW)"
    safe = lambda s: f"CASE WHEN {s} = 0 THEN 1 ELSE {s} END"
    return (f"CASE WHEN is_test THEN ({c} - avg({c}) {frame}) / {safe(f'stddev_pop({c}) {frame}')} "
            f"ELSE ({c} - avg({c}) {train}) / {safe(f'stddev_pop({c}) {train}')} END AS {c}")


SCORED = f"scored AS (SELECT {K}, row, is_test, {', '.join(map(_z, VALUES))} FROM split)"
_ROUNDED = ", ".join(f"{rs(c)} AS {c}" for c in VALUES)
SPLIT_CTE = (TRADES, TRADE_WINDOWS, SPLIT)
SCORED_CTE = (*SPLIT_CTE, SCORED)


def _split(spark, sf):
    return tf.chrono_split(trade_gold(spark, sf).select(*KEYS, *[F.col(c).cast("double").alias(c) for c in VALUES]))


@query("chrono_split", cte(*SPLIT_CTE) + f"SELECT {K}, row, is_test FROM split")
def _w11(spark, sf):
    return _split(spark, sf).select(*KEYS, "row", "is_test")


@query("zscore_train", cte(*SCORED_CTE) + f"SELECT {K}, {_ROUNDED} FROM scored WHERE NOT is_test")
def _w4(spark, sf):
    return tf.zscore(_split(spark, sf), VALUES).where("NOT is_test").select(*KEYS, *[r(F.col(c)).alias(c) for c in VALUES])


@query("zscore_rolling_test", cte(*SCORED_CTE) + f"SELECT {K}, {_ROUNDED} FROM scored WHERE is_test")
def _w5(spark, sf):
    return tf.zscore(_split(spark, sf), VALUES).where("is_test").select(*KEYS, *[r(F.col(c)).alias(c) for c in VALUES])


def _lag_sql(kind: str, c: str, lag: int) -> str:
    w = "OVER (PARTITION BY platform, symbol ORDER BY row)"
    a, b = f"lag({c}, {lag}, 0.0) {w}", f"lag({c}, {2 * lag}, 0.0) {w}"
    return {"stepper": f"CASE WHEN {c} > {a} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "diff": f"CAST(sign({a} - {c}) AS DOUBLE)",
            "doubled_stepper": f"CASE WHEN {a} > {b} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
            "doubled_diff": f"CAST(sign({b} - {a}) AS DOUBLE)"}[kind]


# The single lag kinds over the plain values, all rows.
for _name, _kind in (("lag_stepper", "stepper"), ("lag_diff", "diff"), ("doubled_stepper", "doubled_stepper"), ("doubled_diff", "doubled_diff")):
    add(_name, lambda spark, sf, kind=_kind: tf.lag_features(_split(spark, sf).drop("is_test", "n_train", "rows"), VALUES, kind).drop("row"),
        cte(*SPLIT_CTE) + f"SELECT {K}, " + ", ".join(f"{_lag_sql(_kind, c, lag)} AS {c}__{_kind}_{lag}" for lag in tf.FIBO_LAGS for c in VALUES) + " FROM split")

# The nine strategies from split to transformed rows.
for _s in tf.STRATEGIES:
    _vals = VALUES if _s == "zscore" else LAGGED
    _kind = _s.removeprefix("zscore_").removesuffix("_incl").removesuffix("_fibo")
    _cols = ([f"{rs(c)} AS {c}" for c in _vals] if _s == "zscore" or _s.endswith("_incl") else []) + (
        [] if _s == "zscore" else [f"{_kind}_{c}_{lag} AS {c}__{_kind}_{lag}" for lag in tf.FIBO_LAGS for c in _vals])
    _made = "" if _s == "zscore" else ", " + ", ".join(f"{_lag_sql(_kind, c, lag)} AS {_kind}_{c}_{lag}" for lag in tf.FIBO_LAGS for c in _vals)
    _warm = 0 if _s == "zscore" else (26 if _kind.startswith("doubled") else 13)

    def _run(spark, sf, s=_s, values=_vals):
        split = _split(spark, sf)
        out = tf.transform(split.drop(*[c for c in VALUES if c not in values]), s, values)
        cols = tf.transformed_columns(s, values)
        return out.select(*KEYS, "is_test", *[r(F.col(c)).alias(c) if c in values else F.col(c) for c in cols])

    add(f"strategy_{_s}", _run, cte(*SCORED_CTE) + f"SELECT {K}, is_test, {', '.join(_cols)} FROM (SELECT *{_made} FROM scored) WHERE is_test OR row >= {_warm}")


@query("drop_warmup", cte(*SPLIT_CTE) + f"SELECT {K}, row FROM split WHERE is_test OR row >= 13")
def _w10(spark, sf):
    return tf.drop_warmup(_split(spark, sf), 13).select(*KEYS, "row")


@query("tail_n", cte(TRADES, TRADE_WINDOWS) + f"SELECT {K}, close FROM trade_windows QUALIFY row_number() OVER (PARTITION BY platform, symbol ORDER BY window_end_ms DESC) <= 50")
def _w13(spark, sf):
    return tf.last_rows(trade_gold(spark, sf), 50).select(*KEYS, "close")


@query("head_tail_holdout", cte(*SPLIT_CTE) + f"SELECT {K}, row >= rows - 20 AS held_out FROM split")
def _w14(spark, sf):
    return tf.holdout(trade_gold(spark, sf)).select(*KEYS, "held_out")


@query("in_window_diff", cte(TRADES, TRADE_WINDOWS) + f"SELECT platform, symbol, platform_trade_id AS id, dt, {rs('lr')} AS lr FROM trade_steps")
def _w1(spark, sf):
    from ticklattice.functions.scale import lag_one
    from ticklattice.operators.trade_windows import log_price, window_start
    from ticklattice.plans.views import trades

    t = trades(spark, sf).select(*S, F.col("platform_trade_id").alias("id"), "time_ms", log_price(F.col("price").cast("double")).alias("lp"))
    t = t.withColumn("ws", window_start("time_ms", WINDOW_MS)).withColumn("_slice", F.floor(F.col("id") / 65_536))
    t = lag_one(t, [*S, "ws"], ["id"], {"pt": "time_ms", "pl": "lp"})
    return t.select(*S, "id", (F.col("time_ms") - F.col("pt")).alias("dt"), r(F.col("lp") - F.col("pl")).alias("lr"))


@query("sort_by_key_time", cte(TRADES, TRADE_WINDOWS) + f"SELECT {K}, close FROM trade_windows ORDER BY {K}")
def _t1(spark, sf):
    return trade_gold(spark, sf).select(*KEYS, "close").orderBy(*KEYS)


# --- metrics ---------------------------------------------------------------------------------------------------------

LABELS = ["platform", "symbol", "status"]
STEP, RANGE = 3_600_000, 21_600_000


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events as samples of two metrics: a counter that restarts each day and a gauge with the event's value."""
    from ticklattice.functions.scale import dense_index

    t = millis(F.col("ts"))
    e = table(spark, sf, "events").select(
        platform_of(F.col("event_id")).alias("platform"), symbol_of(F.col("user_id")).alias("symbol"), F.col("event_type").alias("status"),
        t.alias("ts"), "event_id", "value").withColumn("day", F.floor(F.col("ts") / 86_400_000)).withColumn("_slice", F.floor(F.col("ts") / 3_600_000))
    counted = dense_index(e, [*LABELS, "day"], ["ts", "event_id"], out="n")
    names = F.create_map(*[x for n in LABELS for x in (F.lit(n), F.col(n))])
    both = F.array(F.struct(F.lit("requests_total").alias("metric"), (F.col("n") + 1).cast("double").alias("value")),
                   F.struct(F.lit("last_value").alias("metric"), F.col("value").alias("value")))
    return counted.select(names.alias("labels"), "ts", F.explode(both).alias("m")).select("m.metric", "labels", "ts", "m.value")


SAMPLES = """
ev AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'kraken' ELSE 'binance' END AS platform, 's' || (user_id % 4) || '_usdt' AS symbol, event_type AS status,
              epoch_us(ts) // 1000 AS ts, event_id, value FROM events),
counter AS (SELECT *, CAST(row_number() OVER (PARTITION BY platform, symbol, status, ts // 86400000 ORDER BY ts, event_id) AS DOUBLE) AS n FROM ev)"""
RATES = f"""
steps AS (SELECT *, lag(n) OVER (PARTITION BY platform, symbol, status ORDER BY ts) AS prev FROM counter),
grown AS (SELECT platform, symbol, status, (ts + {STEP - 1}) // {STEP} * {STEP} AS step,
                 CASE WHEN n >= prev THEN n - prev WHEN prev IS NOT NULL THEN n ELSE 0 END AS inc FROM steps),
rates AS (SELECT platform, symbol, status, t, sum(inc) / {RANGE / 1000} AS rate
          FROM (SELECT *, unnest(generate_series(step, step + {RANGE - STEP}, {STEP})) AS t FROM grown) GROUP BY 1, 2, 3, 4)"""
RATE_CTE = (SAMPLES, RATES)


def _counter(spark, sf):
    return mx.label_columns(samples(spark, sf), "requests_total", LABELS)


def _gauge(spark, sf):
    return mx.label_columns(samples(spark, sf), "last_value", LABELS)


def _rates(spark, sf):
    return mx.rate(_counter(spark, sf), LABELS, RANGE, STEP)


@query("rate", cte(*RATE_CTE) + f"SELECT platform, symbol, status, t, {rs('rate', 9)} AS rate FROM rates")
def _q1(spark, sf):
    return _rates(spark, sf).withColumn("rate", r(F.col("rate"), 9))


@query("sum_by_rate", cte(*RATE_CTE) + f"SELECT platform, status, t, {rs('sum(rate)', 9)} AS rate FROM rates GROUP BY 1, 2, 3")
def _q2(spark, sf):
    return mx.sum_by(_rates(spark, sf), ["platform", "status"]).withColumn("rate", r(F.col("rate"), 9))


@query("success_ratio", cte(*RATE_CTE) + f"""
SELECT platform, t, {rs("100 * sum(CASE WHEN status <> 'error' THEN rate ELSE 0 END) / CASE WHEN sum(rate) <> 0 THEN sum(rate) END", 5)} AS percent FROM rates GROUP BY 1, 2""")
def _q3(spark, sf):
    return mx.success_ratio(_rates(spark, sf), F.col("status") != "error", ["platform"]).withColumn("percent", r(F.col("percent"), 5))


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query("histogram_quantile", cte(SAMPLES) + f"""
, b AS (SELECT status, ts // 86400000 AS day, unnest([{', '.join(f'{b}::DOUBLE' for b in BOUNDS)}, 'inf'::DOUBLE]) AS le, value AS v FROM ev),
c AS (SELECT status, day, le, CAST(count(*) FILTER (v <= le) AS DOUBLE) AS upto FROM b GROUP BY 1, 2, 3),
w AS (SELECT *, lag(le) OVER o AS low, coalesce(lag(upto) OVER o, 0) AS below, max(upto) OVER (PARTITION BY status, day) AS total
      FROM c WINDOW o AS (PARTITION BY status, day ORDER BY le)),
q AS (SELECT *, unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS quantile FROM w),
h AS (SELECT *, row_number() OVER (PARTITION BY status, day, quantile ORDER BY le) AS k FROM q WHERE upto >= quantile * total)
SELECT status, day, quantile, {rs("CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (quantile * total - below) / (upto - below) END")} AS value
FROM h WHERE k = 1""".replace("\n, b", ", b", 1))
def _q4(spark, sf):
    bounds = F.array(*[F.lit(b) for b in [*BOUNDS, float("inf")]])
    g = _gauge(spark, sf).withColumn("day", F.floor(F.col("ts") / 86_400_000))
    # One row per day, status and observed bucket first, then each count carried to all bounds at or above it.
    own = F.element_at(F.filter(bounds, lambda b: b >= F.col("value")), 1)
    counts = g.groupBy("status", "day", own.alias("own")).agg(F.count("*").cast("double").alias("n"))
    cum = counts.select("status", "day", F.explode(bounds).alias("le"), "own", "n").groupBy("status", "day", "le").agg(
        F.sum(F.when(F.col("own") <= F.col("le"), F.col("n")).otherwise(0.0)).alias("value"))
    return mx.histogram_quantile(cum, ["status", "day"], [0.5, 0.95, 0.99]).withColumn("value", r(F.col("value")))


NOW = 1_706_745_600.0


@query("staleness", cte(SAMPLES) + f"SELECT platform, symbol, status, {rs(f'({NOW} - max(ts) / 1000) / 3600')} AS age FROM ev GROUP BY 1, 2, 3")
def _q5(spark, sf):
    s = _counter(spark, sf).withColumn("value", F.col("ts") / 1000)
    return mx.staleness(s, LABELS, NOW, per_hour=True).withColumn("age", r(F.col("age")))


@query("topk", cte(SAMPLES) + """
, g AS (SELECT platform, symbol, status, ts // 3600000 * 3600000 AS ts, max(value) AS value FROM ev GROUP BY 1, 2, 3, 4)
SELECT *, row_number() OVER (PARTITION BY ts ORDER BY value DESC, platform, symbol, status) AS rank FROM g QUALIFY rank <= 5""".replace("\n, g", ", g", 1))
def _q6(spark, sf):
    g = _gauge(spark, sf).groupBy(*LABELS, (F.floor(F.col("ts") / 3_600_000) * 3_600_000).alias("ts")).agg(F.max("value").alias("value"))
    return mx.topk(g, 5, LABELS).withColumn("rank", F.col("rank").cast("long"))


@query("changes", cte(SAMPLES) + f"""
, c AS (SELECT platform, symbol, status, (ts + {STEP - 1}) // {STEP} * {STEP} AS step,
               CASE WHEN value <> lag(value) OVER (PARTITION BY platform, symbol, status ORDER BY ts) THEN 1 ELSE 0 END AS d FROM ev)
SELECT platform, symbol, status, t, CAST(sum(d) AS BIGINT) AS changes
FROM (SELECT *, unnest(generate_series(step, step + {RANGE - STEP}, {STEP})) AS t FROM c) GROUP BY 1, 2, 3, 4""".replace("\n, c", ", c", 1))
def _q7(spark, sf):
    return mx.changes(_gauge(spark, sf), LABELS, RANGE, STEP)


@query("label_regex", cte(SAMPLES) + f"""
SELECT platform, ts // 86400000 AS ts, {rs('sum(value)')} AS value FROM ev WHERE regexp_full_match(status, '.*(ck|ew).*') GROUP BY 1, 2""")
def _q8(spark, sf):
    g = _gauge(spark, sf).withColumn("ts", F.floor(F.col("ts") / 86_400_000))
    return mx.sum_matching(g, "status", ".*(ck|ew).*", ["platform"]).withColumn("value", r(F.col("value")))


@query("gauge_ratio", cte(SAMPLES) + f"""
, g AS (SELECT platform, symbol, ts // 86400000 AS ts, sum(value) FILTER (status = 'error') AS a, sum(value) FILTER (status = 'view') AS b FROM ev GROUP BY 1, 2, 3)
SELECT platform, symbol, ts, {rs('a / (a + b)')} AS ratio FROM g WHERE a IS NOT NULL AND b IS NOT NULL""".replace("\n, g", ", g", 1))
def _q9(spark, sf):
    g = _gauge(spark, sf).groupBy(*S, "status", F.floor(F.col("ts") / 86_400_000).alias("ts")).agg(F.sum("value").alias("value"))
    out = mx.gauge_ratio(g.where("status = 'error'"), g.where("status = 'view'"), S, of_sum=True)
    return out.withColumn("ratio", r(F.col("ratio")))


@query("latest_gauge", cte(SAMPLES) + "SELECT platform, symbol, status, arg_max(value, ts) AS value, max(ts) AS ts FROM ev GROUP BY 1, 2, 3")
def _q10(spark, sf):
    return mx.latest(_gauge(spark, sf), LABELS)


# --- votes and predictions -------------------------------------------------------------------------------------------

VOTE_KEYS = [*S, "day"]


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as model votes on threshold targets of their day."""
    rows = log(spark, sf)
    k = F.expr("cast(round(cast(get_json_object(payload, '$.data.q') as double) * 10) as long)")
    target = F.concat(F.lit("target_"), F.when(k % 2 == 0, "high").otherwise("low"), F.lit("_"), F.when(F.col("event_type").isin("view", "error"), "up").otherwise("down"),
                      F.lit("_0."), (F.col("user_id") % 3 + 1).cast("string"), F.lit("p"))
    return rows.select(*S, F.floor(F.col("timestamp") / 86_400_000).alias("day"), target.alias("target_name"),
                       F.when(F.col("event_type").isin("click", "error"), "neg").otherwise("pos").alias("side"),
                       (F.col("value") > 6).cast("int").alias("prediction"), (k / 100).alias("precision"))


VOTES = """
votes AS (SELECT platform, symbol, timestamp // 86400000 AS day, 'target_' || CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END || '_' ||
            CASE WHEN event_type IN ('view', 'error') THEN 'up' ELSE 'down' END || '_0.' || (user_id % 3 + 1) || 'p' AS target_name,
            CASE WHEN event_type IN ('click', 'error') THEN 'neg' ELSE 'pos' END AS side, CASE WHEN value > 6 THEN 1 ELSE 0 END AS prediction, k / 100 AS precision
          FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM log)),
tally AS (SELECT platform, symbol, day, target_name, side, count(*) AS n, sum(prediction) AS n1,
                 avg(precision) FILTER (prediction = 1) AS p1, avg(precision) FILTER (prediction = 0) AS p0 FROM votes GROUP BY ALL),
voted AS (SELECT platform, symbol, day, target_name, side, CASE WHEN n1 * 2 > n THEN 1 ELSE 0 END AS prediction,
                 coalesce(CASE WHEN n1 * 2 > n THEN p1 ELSE p0 END, 0) AS confidence, CASE WHEN n1 * 2 > n THEN n1 ELSE n - n1 END / n AS agreement FROM tally),
targets AS (SELECT platform, symbol, day, target_name, split_part(target_name, '_', 2) AS price_type, split_part(target_name, '_', 3) AS direction,
                   CAST(rtrim(split_part(target_name, '_', 4), 'p') AS DOUBLE) AS threshold,
                   coalesce(max(prediction) FILTER (side = 'neg'), 0) AS neg_prediction, coalesce(max(confidence) FILTER (side = 'neg'), 0) AS neg_confidence,
                   coalesce(max(agreement) FILTER (side = 'neg'), 0) AS neg_model_agreement, coalesce(max(prediction) FILTER (side = 'pos'), 0) AS pos_prediction,
                   coalesce(max(confidence) FILTER (side = 'pos'), 0) AS pos_confidence, coalesce(max(agreement) FILTER (side = 'pos'), 0) AS pos_model_agreement
            FROM voted GROUP BY ALL),
hits AS (SELECT *, pos_prediction = 1 AND pos_model_agreement >= 0.5 AS hit FROM targets),
tops AS (SELECT *, max(threshold) FILTER (hit) OVER (PARTITION BY platform, symbol, day, price_type, direction) AS top FROM hits),
ranges AS (SELECT platform, symbol, day, price_type, direction, min(threshold) FILTER (hit) AS range_low,
                  CASE WHEN bool_or(hit) THEN coalesce(min(threshold) FILTER (threshold > top), max(top)) END AS range_high, min(threshold) FILTER (threshold > top) AS next_value
           FROM tops GROUP BY ALL)"""
VOTE_CTE = (LOG, VOTES)
V = "platform, symbol, day"


@query("majority_vote", cte(*VOTE_CTE) + f"SELECT {V}, target_name, side, CAST(prediction AS INTEGER) AS prediction, {rs('confidence')} AS confidence, {rs('agreement')} AS agreement FROM voted")
def _g38(spark, sf):
    out = pr.majority_vote(votes(spark, sf), [*VOTE_KEYS, "target_name", "side"])
    return out.withColumns({c: r(F.col(c)) for c in ("confidence", "agreement")})


_TARGET_COLS = ["neg_prediction", "neg_confidence", "neg_model_agreement", "pos_prediction", "pos_confidence", "pos_model_agreement"]


@query("predict_target", cte(*VOTE_CTE) + f"SELECT {V}, target_name, " + ", ".join(f"CAST({c} AS INTEGER) AS {c}" if c.endswith("_prediction") else f"{rs(c)} AS {c}" for c in _TARGET_COLS) + " FROM targets")
def _m8(spark, sf):
    out = pr.predict_targets(votes(spark, sf), VOTE_KEYS)
    return out.select(*VOTE_KEYS, "target_name", *[F.col(c).cast("int") if c.endswith("_prediction") else r(F.col(c)).alias(c) for c in _TARGET_COLS])


@query("threshold_range", cte(*VOTE_CTE) + f"SELECT {V}, price_type, direction, range_low, range_high FROM ranges")
def _m9(spark, sf):
    return pr.threshold_ranges(pr.parsed_targets(pr.predict_targets(votes(spark, sf), VOTE_KEYS)), VOTE_KEYS)


@query("first_threshold_above", cte(*VOTE_CTE) + f"SELECT {V}, price_type, direction, min(threshold) FILTER (threshold > 0.15) AS next_value FROM targets GROUP BY ALL")
def _t7(spark, sf):
    p = pr.parsed_targets(pr.predict_targets(votes(spark, sf), VOTE_KEYS)).withColumn("limit", F.lit(0.15))
    return pr.first_above(p, [*VOTE_KEYS, "price_type", "direction"], "threshold", "limit")


def _conf(t: str) -> str:
    mean = lambda cond, c: f"avg({c}) FILTER (price_type = '{t}' AND {cond})"
    return (f"coalesce(CASE {t}_direction WHEN 'volatile' THEN 0.5 WHEN 'stable' THEN {t}_s WHEN 'up' THEN {t}_u ELSE {t}_d END, 0)")


SUMMARY = f"""
means AS (SELECT {V}, """ + ", ".join(
    f"avg(pos_confidence) FILTER (price_type = '{t}' AND direction = '{d}' AND pos_prediction = 1) AS {t}_{d[0]}" for t in ("high", "low") for d in ("up", "down")) + ", " + ", ".join(
    f"avg(neg_model_agreement) FILTER (price_type = '{t}' AND neg_prediction = 0) AS {t}_s" for t in ("high", "low")) + f""" FROM targets GROUP BY ALL),
wide AS (SELECT {V}, """ + ", ".join(f"max({e}) FILTER (price_type = '{t}' AND direction = '{d}') AS {t}_{d}_{e[6:]}" for t in ("high", "low") for d in ("up", "down") for e in ("range_low", "range_high")) + f""" FROM ranges GROUP BY ALL),
dirs AS (SELECT *, """ + ", ".join(
    f"CASE WHEN {t}_up_low IS NOT NULL AND {t}_down_low IS NOT NULL THEN 'volatile' WHEN {t}_up_low IS NOT NULL THEN 'up' WHEN {t}_down_low IS NOT NULL THEN 'down' ELSE 'stable' END AS {t}_direction" for t in ("high", "low")) + f""" FROM wide JOIN means USING ({V}))"""


@query("prediction_summary", cte(*VOTE_CTE, SUMMARY) + f"SELECT {V}, high_up_low, high_up_high, high_down_low, high_down_high, low_up_low, low_up_high, low_down_low, low_down_high, "
       f"high_direction, low_direction, {rs(_conf('high'))} AS high_confidence, {rs(_conf('low'))} AS low_confidence, (day * 86400000 + 3 * 86400000) AS prediction_for FROM dirs")
def _m12(spark, sf):
    out = pr.summarize(pr.predict_targets(votes(spark, sf), VOTE_KEYS), VOTE_KEYS)
    day = F.lit(86_400_000).cast("long")
    return out.withColumns({"high_confidence": r(F.col("high_confidence")), "low_confidence": r(F.col("low_confidence")),
                            "prediction_for": pr.prediction_time(F.col("day") * day, day)})


@query("direction", cte(*VOTE_CTE, SUMMARY) + f"SELECT {V}, high_direction, low_direction FROM dirs")
def _m10(spark, sf):
    return pr.summarize(pr.predict_targets(votes(spark, sf), VOTE_KEYS), VOTE_KEYS).select(*VOTE_KEYS, "high_direction", "low_direction")


@query("direction_confidence", cte(*VOTE_CTE, SUMMARY) + f"SELECT {V}, {rs(_conf('high'))} AS high_confidence, {rs(_conf('low'))} AS low_confidence FROM dirs")
def _m11(spark, sf):
    out = pr.summarize(pr.predict_targets(votes(spark, sf), VOTE_KEYS), VOTE_KEYS)
    return out.select(*VOTE_KEYS, r(F.col("high_confidence")).alias("high_confidence"), r(F.col("low_confidence")).alias("low_confidence"))


LABELLED_SQL = """
judged AS (SELECT platform, symbol, CASE WHEN value > 10 THEN 1 ELSE 0 END AS label, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 60 THEN 1 ELSE 0 END AS prediction FROM log),
cm AS (SELECT platform, symbol, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
              count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM judged GROUP BY 1, 2)"""


def _judged(spark, sf):
    k = F.expr("cast(round(cast(get_json_object(payload, '$.data.q') as double) * 10) as long)")
    return log(spark, sf).select(*S, (F.col("value") > 10).cast("int").alias("label"), (k > 60).cast("int").alias("prediction"))


@query("confusion_matrix", cte(LOG, LABELLED_SQL) + "SELECT * FROM cm")
def _g34(spark, sf):
    return pr.confusion(_judged(spark, sf), S)


@query("recall", cte(LOG, LABELLED_SQL) + f"SELECT platform, symbol, {rs('tn / (tn + fp)')} AS recall_neg, {rs('tp / (tp + fn)')} AS recall_pos, {rs('tn / (tn + fp) * (tp / (tp + fn))')} AS recall_score FROM cm")
def _g35(spark, sf):
    out = pr.recall(pr.confusion(_judged(spark, sf), S))
    return out.select(*S, *[r(F.col(c)).alias(c) for c in ("recall_neg", "recall_pos", "recall_score")])


@query("precision", cte(LOG, LABELLED_SQL) + f"SELECT platform, symbol, {rs('tn / (tn + fn)')} AS precision_neg, {rs('tp / (tp + fp)')} AS precision_pos, {rs('tn / (tn + fn) * (tp / (tp + fp))')} AS precision_score FROM cm")
def _g36(spark, sf):
    out = pr.precision(pr.confusion(_judged(spark, sf), S))
    return out.select(*S, *[r(F.col(c)).alias(c) for c in ("precision_neg", "precision_pos", "precision_score")])


@query("label_std", cte(LOG, LABELLED_SQL) + f"SELECT platform, symbol, count(*) AS training_data_length, {rs('stddev_pop(label)')} AS training_data_std FROM judged GROUP BY 1, 2")
def _g37(spark, sf):
    return pr.label_stats(_judged(spark, sf), S).withColumn("training_data_std", r(F.col("training_data_std")))


# Order lines as stored training results: one per line, scored by its discount and tax.

def stored_results(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("result_id"), platform_of(F.col("l_suppkey")).alias("platform"),
        symbol_of(F.col("l_partkey")).alias("symbol"), F.concat(F.lit("target_high_up_0."), (F.col("l_suppkey") % 9 + 1).cast("string"), F.lit("p")).alias("target_name"),
        F.lit(30_000).cast("long").alias("window_size_ms"), F.when(F.col("l_linestatus") == "O", "decision_tree").otherwise("random_forest").alias("methodology"),
        F.col("l_discount").alias("precision_neg"), F.col("l_tax").alias("precision_pos"), F.col("l_quantity").cast("long").alias("training_data_length"),
        F.col("l_linenumber").alias("dimension"), F.col("l_extendedprice").alias("score"), F.concat_ws("+", F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("features"))


RESULTS = """
results AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS result_id, CASE WHEN l_suppkey % 3 = 0 THEN 'kraken' ELSE 'binance' END AS platform, 's' || (l_partkey % 4) || '_usdt' AS symbol,
              'target_high_up_0.' || (l_suppkey % 9 + 1) || 'p' AS target_name, CASE WHEN l_linestatus = 'O' THEN 'decision_tree' ELSE 'random_forest' END AS methodology,
              l_discount AS precision_neg, l_tax AS precision_pos, CAST(l_quantity AS BIGINT) AS training_data_length, l_linenumber AS dimension, l_extendedprice AS score,
              l_partkey || '+' || l_orderkey || '+' || l_suppkey AS features FROM lineitem)"""


@query("topk_specialists", cte(RESULTS) + """
SELECT platform, symbol, target_name, side, precision, result_id FROM (
  SELECT *, 'neg' AS side, precision_neg AS precision FROM results UNION ALL SELECT *, 'pos', precision_pos FROM results)
WHERE methodology = 'decision_tree' QUALIFY row_number() OVER (PARTITION BY platform, symbol, target_name, side ORDER BY precision DESC, result_id) <= 3""")
def _t3(spark, sf):
    return pr.top_specialists(stored_results(spark, sf)).select("platform", "symbol", "target_name", "side", "precision", "result_id")


@query("distinct_targets", cte(RESULTS) + "SELECT DISTINCT platform, symbol, target_name FROM results WHERE methodology = 'decision_tree'")
def _g39(spark, sf):
    return pr.distinct_targets(stored_results(spark, sf), 30_000)


@query("max_training_len", cte(RESULTS) + "SELECT platform, symbol, max(training_data_length) AS max_training_length FROM results GROUP BY 1, 2")
def _g40(spark, sf):
    return pr.max_training_length(stored_results(spark, sf), S)


@query("topn_combos", cte(RESULTS) + "SELECT platform, dimension, features, score FROM results QUALIFY row_number() OVER (PARTITION BY platform, dimension ORDER BY score DESC, features) <= 5")
def _t4(spark, sf):
    return pr.top_per_dimension(stored_results(spark, sf), 5, ["platform"]).select("platform", "dimension", "features", "score")


@query("topk_store", cte(RESULTS) + """
, best AS (SELECT platform, dimension, features, score FROM results QUALIFY row_number() OVER (PARTITION BY platform, dimension ORDER BY score DESC, features) = 1)
SELECT * FROM best WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY platform ORDER BY score DESC, dimension) <= 3""".replace("\n, best", ", best", 1))
def _t5(spark, sf):
    return pr.best_to_store(stored_results(spark, sf), 3, ["platform"]).select("platform", "dimension", "features", "score")


FEATURE_NAMES = [*[f"t_{f}" for f in TRADE_FIELDS], *[f"o_{f}" for f in ORDER_FIELDS]]


@query("expand_feature_sets", f"""
WITH names AS (SELECT unnest({FEATURE_NAMES}) AS f, unnest(range({len(FEATURE_NAMES)})) AS i),
bases AS (SELECT DISTINCT list_sort(list_distinct([a.f, b.f])) AS features FROM part JOIN names a ON a.i = p_partkey % {len(FEATURE_NAMES)} JOIN names b ON b.i = p_size % {len(FEATURE_NAMES)})
SELECT DISTINCT array_to_string(list_sort(list_append(features, f)), ',') AS features FROM bases, names WHERE NOT list_contains(features, f)""")
def _u3(spark, sf):
    names = F.array(*[F.lit(f) for f in FEATURE_NAMES])
    pick = lambda c: F.element_at(names, (F.col(c) % len(FEATURE_NAMES) + 1).cast("int"))
    bases = table(spark, sf, "part").select(F.array_sort(F.array_distinct(F.array(pick("p_partkey"), pick("p_size")))).alias("features")).distinct()
    return pr.expand_feature_sets(bases, FEATURE_NAMES).select(F.array_join("features", ",").alias("features"))


@query("union_relaxed", "SELECT o_orderkey AS k, o_totalprice AS price, NULL AS quantity FROM orders UNION ALL SELECT l_orderkey, CAST(NULL AS DOUBLE), l_quantity FROM lineitem")
def _u2(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return o.unionByName(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("quantity")), allowMissingColumns=True)


@query("distinct_union", "SELECT DISTINCT 's' || (user_id % 4) || '_usdt' AS symbol FROM events UNION SELECT DISTINCT 's' || (o_custkey % 4) || '_usdt' FROM orders")
def _u4(spark, sf):
    a = table(spark, sf, "events").select(symbol_of(F.col("user_id")).alias("symbol")).distinct()
    return a.unionByName(table(spark, sf, "orders").select(symbol_of(F.col("o_custkey")).alias("symbol")).distinct()).distinct()


# --- indicators ------------------------------------------------------------------------------------------------------

@query("basic_indicators", cte(TRADES, TRADE_WINDOWS) + f"""
SELECT {K}, {rs('avg(close) OVER f')} AS moving_average, {rs('(close - lag(close, 10) OVER w) / lag(close, 10) OVER w')} AS rate_of_change, {rs('stddev_pop(close) OVER f')} AS volatility
FROM trade_windows WINDOW w AS (PARTITION BY platform, symbol ORDER BY window_end_ms), f AS (PARTITION BY platform, symbol ORDER BY window_end_ms ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _d4(spark, sf):
    out = ind.basic_indicators(trade_gold(spark, sf).select(*KEYS, "close"), 10)
    return out.select(*KEYS, *[r(F.col(c)).alias(c) for c in ("moving_average", "rate_of_change", "volatility")])


@query("up_pct_features", cte(TRADES, TRADE_WINDOWS) + f"""
SELECT {K}, """ + ", ".join(f'(close - lag(close, {k}) OVER w) / lag(close, {k}) OVER w >= {p} AS "{k}_up_{p * 100:g}p"' for k in (1, 3) for p in (0.05, 0.5)) +
       " FROM trade_windows WINDOW w AS (PARTITION BY platform, symbol ORDER BY window_end_ms)")
def _d5(spark, sf):
    return ind.threshold_features(trade_gold(spark, sf).select(*KEYS, "close"), [1, 3], [0.05, 0.5])


SYMBOLS = [f"s{i}_usdt" for i in range(4)]


@query("multi_symbol_align", cte(TRADES, TRADE_WINDOWS) + "SELECT platform, window_size_ms, window_end_ms, " + ", ".join(
    f"max(close) FILTER (symbol = '{s}') AS {s}" for s in SYMBOLS) + " FROM trade_windows GROUP BY 1, 2, 3")
def _d6(spark, sf):
    return ind.align_symbols(trade_gold(spark, sf), SYMBOLS)
