"""Queries over trade windows and the feature frames built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.operators import features as ft
from ticklattice.operators import trade_windows as tw
from ticklattice.plans.registry import add, query
from ticklattice.plans.views import TRADES, WINDOW_MS, cte, table, trades

KEYS = [*tw.KEYS, "window_end_ms"]
K = "platform, symbol, window_size_ms, window_end_ms"


def _nudge(n: int) -> float:
    return 7.318e-3 * 10.0**-n


def r(c, n: int = 6):
    """Rounded for comparison: -0.0 becomes 0.0, and values are moved up by under a hundredth of the last digit, so that
    halves, which sums differing in their last bits would round either way, come out alike."""
    return F.round(c + F.lit(_nudge(n)), n) + F.lit(0.0)


def rs(c: str, n: int = 6) -> str:
    return f"(round({c} + {_nudge(n)!r}, {n}) + 0.0)"


TRADE_WINDOWS = f"""
trade_steps AS (
  SELECT *, CAST({WINDOW_MS} AS BIGINT) AS window_size_ms,
         time_ms // {WINDOW_MS} * {WINDOW_MS} + {WINDOW_MS} AS window_end_ms,
         ln(price) - lag(ln(price)) OVER w AS lr, time_ms - lag(time_ms) OVER w AS dt
  FROM trades WINDOW w AS (PARTITION BY platform, symbol, time_ms // {WINDOW_MS} ORDER BY platform_trade_id)),
trade_windows AS (
  SELECT {K}, count(*) AS trade_count, sum(quantity) AS sum_vol, sum(price * quantity) AS sum_pv,
         sum(CASE WHEN side = 0 THEN quantity ELSE 0 END) AS buy_vol,
         sum(quantity) - sum(CASE WHEN side = 0 THEN quantity ELSE 0 END) AS sell_vol,
         sum(price) AS sum_price, sum(price * price) AS sum_price2,
         coalesce(sum(lr), 0) AS sum_logret, coalesce(sum(lr * lr), 0) AS sum_logret2,
         coalesce(sum(lr * lr * lr), 0) AS sum_logret3,
         arg_min(price, platform_trade_id) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, platform_trade_id) AS close, min(quantity) AS min_size, max(quantity) AS max_size,
         arg_min(time_ms, platform_trade_id) AS first_ts, arg_max(time_ms, platform_trade_id) AS last_ts,
         CAST(coalesce(sum(dt), 0) AS BIGINT) AS sum_dt, coalesce(max(dt), 0) AS max_gap_ms
  FROM trade_steps GROUP BY ALL)"""

WHOLE = {"trade_count", "first_ts", "last_ts", "sum_dt", "max_gap_ms"}
TW_NAMES = {f: f"tw_{f}" for f in tw.TRADE_FEATURES}


def trade_gold(spark: SparkSession, sf: str) -> DataFrame:
    return tw.trade_windows(trades(spark, sf), WINDOW_MS)


def _feature(field: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = F.col(field) if field in WHOLE else r(F.col(field))
        return trade_gold(spark, sf).select(*KEYS, c.alias(field))

    return run


for _f, _name in TW_NAMES.items():
    _c = _f if _f in WHOLE else rs(_f)
    add(_name, _feature(_f), cte(TRADES, TRADE_WINDOWS) + f"SELECT {K}, {_c} AS {_f} FROM trade_windows")


@query("trade_windows", cte(TRADES, TRADE_WINDOWS) + f"SELECT {K}, " + ", ".join(
    f"{f if f in WHOLE else rs(f)} AS {f}" for f in tw.TRADE_FEATURES) + " FROM trade_windows")
def _trade_windows(spark, sf):
    return trade_gold(spark, sf).select(*KEYS, *[(F.col(f) if f in WHOLE else r(F.col(f))).alias(f) for f in tw.TRADE_FEATURES])


@query("tw_empty_window", cte(TRADES, TRADE_WINDOWS) + f"""
SELECT s.platform, s.symbol, s.window_size_ms, s.window_end_ms, coalesce(t.trade_count, 0) AS trade_count,
       {rs('coalesce(t.sum_vol, 0)')} AS sum_vol, coalesce(t.first_ts, s.window_end_ms - s.window_size_ms) AS first_ts
FROM (SELECT platform, symbol, window_size_ms,
             unnest(generate_series(min(window_end_ms), max(window_end_ms), {WINDOW_MS})) AS window_end_ms
      FROM trade_windows GROUP BY 1, 2, 3) s
LEFT JOIN trade_windows t USING (platform, symbol, window_size_ms, window_end_ms)""")
def _empty(spark, sf):
    out = tw.with_empty_windows(trade_gold(spark, sf))
    return out.select(*KEYS, "trade_count", r(F.col("sum_vol")).alias("sum_vol"), "first_ts")


@query("tw_derived", cte(TRADES, TRADE_WINDOWS) + f"""
SELECT {K}, {rs('CASE WHEN sum_vol > 0 THEN sum_pv / sum_vol END')} AS vwap, {rs('sum_price / trade_count')} AS mean_price,
       {rs("sum_price2 / trade_count - (sum_price / trade_count) * (sum_price / trade_count)", 2)} AS price_variance,
       {rs('sum_logret2')} AS realized_variance, {rs('trade_count / (window_size_ms / 1000)', 9)} AS trades_per_second,
       {rs('CASE WHEN sum_vol > 0 THEN (buy_vol - sell_vol) / sum_vol END')} AS volume_imbalance,
       {rs('sum_vol / trade_count')} AS mean_trade_size
FROM trade_windows""")
def _derived(spark, sf):
    d = tw.derived_trade_features(trade_gold(spark, sf))
    digits = {"price_variance": 2, "trades_per_second": 9}
    return d.select(*KEYS, *[r(F.col(c), digits.get(c, 6)).alias(c) for c in d.columns if c not in KEYS])


# Several sizes at once, stamped with the window start, as one feed serves all sizes.
@query("tumbling_trade_window_sizes", cte(TRADES) + " UNION ALL ".join(f"""
SELECT platform, symbol, CAST({s} AS BIGINT) AS window_size_ms, time_ms // {s} * {s} AS window_end_ms,
       count(*) AS trade_count, {rs('sum(price)')} AS sum_price FROM trades GROUP BY 1, 2, 3, 4"""
    for s in (1_800_000, WINDOW_MS, 86_400_000)))
def _sizes(spark, sf):
    out = tw.trade_windows(trades(spark, sf), [1_800_000, WINDOW_MS, 86_400_000], trade_key="start")
    return out.select(*KEYS, "trade_count", r(F.col("sum_price")).alias("sum_price"))


# --- offsets, targets and the flat design table over the trade side -------------------------------------------------

def trade_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Trade windows as a gold table whose order side is empty."""
    t = tw.as_struct(trade_gold(spark, sf), tw.TRADE_FEATURES, "trade_features")
    return t.withColumn("order_features", F.lit(None).cast("struct<sw:double>"))


def _k(k: int) -> str:
    return f"m{-k}" if k < 0 else f"p{k}"


SHIFTS = [*range(-12, 1), *range(3, 8)]


def shifted_sql(fields: list[str], shifts: list[int], source: str = "trade_windows") -> str:
    """Every listed field at every offset: a frame of one row per offset over one scan."""
    packed = "{" + ", ".join(f"'{f}': {f}" for f in fields) + "}"

    def frame(k: int) -> str:
        at = "CURRENT ROW" if k == 0 else f"{abs(k) * WINDOW_MS} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
        return f"first_value(fields) OVER (PARTITION BY platform, symbol, window_size_ms ORDER BY window_end_ms RANGE BETWEEN {at} AND {at}) AS {_k(k)}"

    frames = ", ".join(frame(k) for k in shifts)
    cols = ", ".join(f"{_k(k)}.{f} AS {f}_{_k(k)}" for k in shifts for f in fields)
    return f"SELECT {K}, {cols} FROM (SELECT {K}, {frames} FROM (SELECT {K}, {packed} AS fields FROM {source}))"


LABELLED = "shifted AS (" + shifted_sql(["close", "high", "low", "trade_count"], SHIFTS) + "), labelled AS (" + \
    f"SELECT {K}, " + ", ".join(
        f"coalesce({', '.join(f'{f}_p{k}' for k in (3, 4, 5))}) AS next_{f}, "
        f"coalesce({', '.join(f'{f}_{_k(-k)}' for k in range(6))}) AS past_{f}"
        for f in ("close", "high", "low")) + \
    ", trade_count_p0, trade_count_m12 FROM shifted WHERE coalesce(close_p3, close_p4, close_p5) IS NOT NULL)"

LABEL_CTE = (TRADES, TRADE_WINDOWS, LABELLED)


def _labelled(spark, sf):
    return ft.labelled_rows(trade_frames(spark, sf))


@query("first_future_nonnull", cte(*LABEL_CTE) + f"SELECT {K}, coalesce(close_p3, close_p4, close_p5) AS close FROM shifted")
def _future(spark, sf):
    out = ft.first_future(ft.k_offsets(trade_frames(spark, sf), prev_n=0, from_next_n=3, to_next_n=5), from_next_n=3, to_next_n=5)
    return out.select(*KEYS, F.col("relaxed_target.close").alias("close"))


@query("first_past_nonnull", cte(*LABEL_CTE) + f"SELECT {K}, coalesce(close_m1, close_m2, close_m3, close_m4, close_m5) AS close FROM shifted")
def _past(spark, sf):
    out = ft.first_past(ft.k_offsets(trade_frames(spark, sf), prev_n=5, from_next_n=0, to_next_n=0), from_past_n=1, to_past_n=5)
    return out.select(*KEYS, F.col("first_past_features.close").alias("close"))


@query("keep_labelled_rows", cte(*LABEL_CTE) + f"SELECT {K}, past_close, next_close FROM labelled")
def _keep_labelled(spark, sf):
    return _labelled(spark, sf).select(
        *KEYS, F.col("first_past_features.close").alias("past_close"), F.col("relaxed_target.close").alias("next_close"))


@query("drop_future_columns", cte(*LABEL_CTE) + f"SELECT {K}, close_m2, close_m1, close_p0 FROM shifted")
def _drop_future(spark, sf):
    wide = ft.k_offsets(trade_frames(spark, sf), prev_n=2, from_next_n=3, to_next_n=7)
    flat = wide.select(*KEYS, *[F.col(f"`{c}`")["close"].alias(c) for c in wide.columns if c.endswith("_trade_features")])
    left = ft.drop_future_columns(flat)
    names = {"-2_trade_features": "close_m2", "-1_trade_features": "close_m1", "0_trade_features": "close_p0"}
    return left.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in left.columns])


@query("target_rules", cte(*LABEL_CTE) + f"""
SELECT {K}, next_close > past_close AS rises, next_high - past_high >= 1 AS high_up_1,
       {rs('next_low - past_low')} AS low_change FROM labelled""")
def _rules(spark, sf):
    out = ft.add_targets(_labelled(spark, sf), {
        "rises": ("close", lambda a, b: b > a),
        "high_up_1": ("high", lambda a, b: b - a >= 1),
        "low_change": ("low", lambda a, b: r(b - a)),
    })
    return out.select(*KEYS, "rises", "high_up_1", "low_change")


QUANTILE_SQL = f"""
moves AS (SELECT platform, symbol, window_size_ms, (next_close - past_close) / past_close AS pct FROM labelled),
sized AS (SELECT platform, symbol, window_size_ms, CASE WHEN pct > 0 THEN 'up' ELSE 'down' END AS direction, abs(pct) AS size
          FROM moves WHERE pct <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY platform, symbol, direction ORDER BY size) - 1 AS i,
                  count(*) OVER (PARTITION BY platform, symbol, direction) AS n FROM sized),
quantiles AS (SELECT platform, symbol, window_size_ms, direction, q AS quantile,
                     CASE WHEN direction = 'up' THEN size ELSE -size END AS value
              FROM ranked, (SELECT unnest([0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE, 0.95::DOUBLE]) AS q)
              WHERE i = CAST(round((n - 1) * q) AS BIGINT)),
thresholds AS (SELECT DISTINCT platform, symbol, window_size_ms, direction, round(value, 4) AS threshold FROM quantiles)"""


@query("pct_quantiles", cte(*LABEL_CTE, QUANTILE_SQL) +
       f"SELECT platform, symbol, window_size_ms, direction, quantile, {rs('value', 9)} AS value FROM quantiles")
def _quantiles(spark, sf):
    return ft.pct_quantiles(_labelled(spark, sf)).withColumn("value", r(F.col("value"), 9))


@query("round_thresholds", cte(*LABEL_CTE, QUANTILE_SQL) + "SELECT * FROM thresholds")
def _thresholds(spark, sf):
    return ft.round_thresholds(ft.pct_quantiles(_labelled(spark, sf)))


PCT_TARGETS = """
moved AS (SELECT platform, symbol, window_size_ms, window_end_ms, (next_high - past_high) / past_high AS high,
                 (next_low - past_low) / past_low AS low FROM labelled),
long_moves AS (SELECT * FROM moved UNPIVOT (move FOR field IN (high, low))),
texted AS (SELECT *, rtrim(rtrim(rtrim(CAST(CAST(round(CAST(abs(threshold) * 100 AS DECIMAL(30,12)), 3) AS DECIMAL(30,3)) AS VARCHAR),
                 '0'), '.'), '0') AS pct FROM thresholds)"""


@query("pct_targets", cte(*LABEL_CTE, QUANTILE_SQL, PCT_TARGETS) + f"""
SELECT platform, symbol, window_size_ms, window_end_ms,
       'target_' || field || '_' || direction || '_' || CASE WHEN pct = '' THEN '0' ELSE pct END || 'p' AS target_name,
       CASE WHEN direction = 'up' THEN move >= threshold ELSE move <= threshold END AS label
FROM long_moves JOIN texted USING (platform, symbol, window_size_ms)""")
def _pct_targets(spark, sf):
    labelled = _labelled(spark, sf)
    return ft.pct_targets_long(labelled, ft.round_thresholds(ft.pct_quantiles(labelled)))


@query("rule_expressions", cte(*LABEL_CTE) + f"""
SELECT {K}, (next_high - past_high) / past_high >= 0.5 AS target_high_up_5p,
       (next_low - past_low) / past_low <= -0.2 AS target_low_down_2p FROM labelled""")
def _rule_expressions(spark, sf):
    rules = ft.pct_rules([0.5], [-0.2])
    wanted = ["target_high_up_5p", "target_low_down_2p"]
    return ft.add_targets(_labelled(spark, sf), {n: rules[n] for n in wanted}).select(*KEYS, *wanted)


@query("span_and_keys", cte(TRADES, TRADE_WINDOWS) + """
SELECT min(window_end_ms) AS window_start, max(window_end_ms) AS window_end, CAST(min(window_size_ms) AS VARCHAR) AS sizes,
       (SELECT string_agg(symbol, ',' ORDER BY symbol) FROM (SELECT DISTINCT symbol FROM trades)) AS symbols,
       (SELECT string_agg(platform, ',' ORDER BY platform) FROM (SELECT DISTINCT platform FROM trades)) AS platforms
FROM trade_windows""")
def _span(spark, sf):
    out = ft.span_and_keys(trade_gold(spark, sf))
    return out.select("window_start", "window_end", *[
        F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c) for c in ("sizes", "symbols", "platforms")])
