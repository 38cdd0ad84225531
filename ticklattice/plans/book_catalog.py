"""Queries over order-book state and order windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.operators import features as ft
from ticklattice.operators import order_book as ob
from ticklattice.operators import trade_windows as tw
from ticklattice.plans.registry import add, query
from ticklattice.plans.views import BOOK_SLICE, BOOKS, TRADES, WINDOW_MS, book_messages, cte
from ticklattice.plans.windows_catalog import WHOLE as tw_WHOLE
from ticklattice.plans.windows_catalog import KEYS, SHIFTS, TRADE_WINDOWS, K, _k, r, rs, shifted_sql, trade_gold

B = "platform, symbol"


def _apply(side: str, order: str) -> str:
    left = f"list_filter(f.{side}, lambda x: NOT list_contains(list_transform(m.{side}, lambda y: y.price), x.price))"
    merged = f"list_sort(list_concat({left}, list_filter(m.{side}, lambda y: y.qty <> 0)), '{order}')"
    return f"CASE WHEN f.d{side[0]} > 0 THEN list_slice({merged}, 1, f.d{side[0]}) ELSE {merged} END"


# The book after every message, one recursion step per message of an epoch, all epochs at once.
TICKS = f"""
epochs AS (SELECT *, CAST(sum(CASE WHEN type = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY {B} ORDER BY id) AS BIGINT) AS epoch FROM books),
msgs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {B}, epoch ORDER BY id) AS n FROM epochs WHERE epoch > 0),
book_fold AS (
  SELECT {B}, epoch, n, id, time_ms,
         list_sort(list_filter(bids, lambda y: y.qty <> 0), 'DESC') AS bids,
         list_sort(list_filter(asks, lambda y: y.qty <> 0), 'ASC') AS asks,
         len(list_filter(bids, lambda y: y.qty <> 0)) AS db, len(list_filter(asks, lambda y: y.qty <> 0)) AS da
  FROM msgs WHERE n = 1
  UNION ALL
  SELECT m.platform, m.symbol, m.epoch, m.n, m.id, m.time_ms, {_apply('bids', 'DESC')}, {_apply('asks', 'ASC')}, f.db, f.da
  FROM book_fold f JOIN msgs m ON m.platform = f.platform AND m.symbol = f.symbol AND m.epoch = f.epoch AND m.n = f.n + 1),
ticks AS MATERIALIZED (
  SELECT {B}, id, time_ms, epoch, bids[1].price AS bb, asks[1].price AS ba,
         coalesce(bids[1].qty, 0) AS bq0, coalesce(asks[1].qty, 0) AS aq0,
         coalesce(list_sum(list_transform(bids, lambda x: x.qty)), 0) AS tot_b,
         coalesce(list_sum(list_transform(asks, lambda x: x.qty)), 0) AS tot_a,
         coalesce(list_sum(list_transform(bids, lambda x: x.qty * x.price)), 0) AS notional_b,
         coalesce(list_sum(list_transform(asks, lambda x: x.qty * x.price)), 0) AS notional_a,
         len(bids) AS depth_b, len(asks) AS depth_a
  FROM book_fold)"""

# Messages of a window older than one already seen with a book never touch it.
LIVE = f"""
started AS (SELECT {B}, min(id) FILTER (type = 'snapshot') AS from_id FROM books GROUP BY ALL),
seen AS (SELECT b.*, time_ms // {WINDOW_MS} AS win, max(time_ms // {WINDOW_MS}) OVER (
           PARTITION BY b.platform, b.symbol ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_win
         FROM books b JOIN started s ON s.platform = b.platform AND s.symbol = b.symbol AND b.id >= s.from_id),
live AS (SELECT * EXCLUDE (win, seen_win) FROM seen WHERE seen_win IS NULL OR win >= seen_win)"""
LIVE_TICKS = TICKS.replace("FROM books)", "FROM live)")

WEIGHED = f"""
priced AS (
  SELECT *, CASE WHEN ba >= bb THEN (ba + bb) * 0.5 END AS mid, CASE WHEN ba >= bb THEN ba - bb END AS spread,
         CASE WHEN ba >= bb AND bq0 + aq0 > 0 THEN (ba * bq0 + bb * aq0) / (bq0 + aq0) END AS micro,
         tot_b <> 0 AND tot_a <> 0 AS both_sides, time_ms // {WINDOW_MS} * {WINDOW_MS} AS ws
  FROM ticks),
lagged AS (
  SELECT *, lag(mid) OVER w AS prev_mid, lag(spread) OVER w AS prev_spread, coalesce(lag(time_ms) OVER w, ws) AS since
  FROM priced WINDOW w AS (PARTITION BY {B}, ws ORDER BY id)),
weighed AS (SELECT *, CAST(CASE WHEN time_ms > since THEN time_ms - since ELSE 1 END AS DOUBLE) AS w FROM lagged),
means AS (SELECT {B}, ws, sum(w * mid) / sum(w) AS mean FROM weighed WHERE mid IS NOT NULL GROUP BY ALL),
order_windows AS (
  SELECT {B}, CAST({WINDOW_MS} AS BIGINT) AS window_size_ms, ws + {WINDOW_MS} AS window_end_ms,
         sum(w) AS sw, coalesce(sum(w * mid), 0) AS sw_mid, coalesce(sum(w * micro), 0) AS sw_micro,
         coalesce(min(spread), 'inf'::DOUBLE) AS spread_min, coalesce(max(spread), '-inf'::DOUBLE) AS spread_max,
         coalesce(sum(w * spread), 0) AS sw_spread, coalesce(sum(w) FILTER (mid IS NOT NULL), 0) AS n_w,
         coalesce(any_value(mean), 0) AS mean_mid, coalesce(sum(w * (mid - mean) * (mid - mean)), 0) AS M2_mid,
         coalesce(sum(w * tot_b) FILTER (both_sides), 0) AS sw_bid, coalesce(sum(w * tot_a) FILTER (both_sides), 0) AS sw_ask,
         coalesce(sum(w * (tot_b - tot_a) / (tot_b + tot_a)) FILTER (both_sides), 0) AS sw_imb,
         sum(w * bq0) AS sw_bid_best_sz, sum(w * aq0) AS sw_ask_best_sz, count(*) AS n_updates,
         count(*) FILTER (mid > prev_mid) AS n_mid_up, count(*) FILTER (mid < prev_mid) AS n_mid_down,
         count(*) FILTER (spread > prev_spread) AS n_spread_widen, count(*) FILTER (spread < prev_spread) AS n_spread_tighten,
         min(since) AS t_first, arg_max(time_ms, id) AS t_last,
         arg_max_null(mid, id) AS close_mid, arg_max_null(spread, id) AS close_spread,
         arg_max_null(bb, id) AS close_bb, arg_max_null(ba, id) AS close_ba,
         arg_max(bq0, id) AS close_bq0, arg_max(aq0, id) AS close_aq0,
         CASE WHEN arg_max(bq0, id) + arg_max(aq0, id) > 0
              THEN (arg_max(bq0, id) - arg_max(aq0, id)) / (arg_max(bq0, id) + arg_max(aq0, id)) ELSE 0 END AS close_best_imb
  FROM weighed LEFT JOIN means USING (platform, symbol, ws) GROUP BY {B}, ws)"""

BOOK_CTE = (BOOKS, TICKS)
ORDER_CTE = (BOOKS, LIVE, LIVE_TICKS, WEIGHED)
WHOLE = {"n_updates", "n_mid_up", "n_mid_down", "n_spread_widen", "n_spread_tighten", "t_first", "t_last"}
DIGITS = {"sw_mid": 2, "sw_micro": 2, "sw_spread": 2, "sw_bid": 2, "sw_ask": 2, "sw_imb": 3, "M2_mid": 1,
          "sw_bid_best_sz": 2, "sw_ask_best_sz": 2}
PLAIN = {"open", "high", "low", "close", "min_size", "max_size"}  # values as they came


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return ob.book_ticks(book_messages(spark, sf), slice_ids=BOOK_SLICE)


def window_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks for windows: late messages are left out before they reach the book."""
    messages = ob.drop_late(book_messages(spark, sf), WINDOW_MS, slice_ids=BOOK_SLICE)
    return ob.book_ticks(messages, slice_ids=BOOK_SLICE)


def order_gold(spark: SparkSession, sf: str) -> DataFrame:
    return ob.order_windows(window_ticks(spark, sf), WINDOW_MS, slice_ids=BOOK_SLICE)


def _out(f: str):
    return F.col(f) if f in WHOLE else r(F.col(f), DIGITS.get(f, 6)).alias(f)


def _out_sql(f: str) -> str:
    return f"{f if f in WHOLE else rs(f, DIGITS.get(f, 6))} AS {f}"


for _f in ob.ORDER_FEATURES:
    add(f"ow_{_f.lower()}", lambda spark, sf, f=_f: order_gold(spark, sf).select(*KEYS, _out(f)),
        cte(*ORDER_CTE) + f"SELECT {K}, {_out_sql(_f)} FROM order_windows")

add("order_windows", lambda spark, sf: order_gold(spark, sf).select(*KEYS, *[_out(f) for f in ob.ORDER_FEATURES]),
    cte(*ORDER_CTE) + f"SELECT {K}, {', '.join(_out_sql(f) for f in ob.ORDER_FEATURES)} FROM order_windows")

TICK_FIELDS = ["bb", "ba", "bq0", "aq0", "tot_b", "tot_a", "depth_b", "depth_a"]


@query("order_book_state", cte(*BOOK_CTE) + f"""
SELECT {B}, id, time_ms, bb, ba, bq0, aq0, tot_b, tot_a, CAST(depth_b AS INTEGER) AS depth_b, CAST(depth_a AS INTEGER) AS depth_a FROM ticks""")
def _state(spark, sf):
    return ticks(spark, sf).select("platform", "symbol", "id", "time_ms", *TICK_FIELDS)


# The same without the depth limit, checked by an interval form: a level lives from its change to its next change.
@query("order_book_state_unlimited", cte(BOOKS) + f"""
, epochs AS (SELECT *, sum(CASE WHEN type = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY {B} ORDER BY id) AS epoch FROM books),
changes AS (SELECT {B}, epoch, id, 'b' AS side, unnest(bids, recursive := true) FROM epochs WHERE epoch > 0
            UNION ALL SELECT {B}, epoch, id, 'a' AS side, unnest(asks, recursive := true) FROM epochs WHERE epoch > 0),
lives AS (SELECT *, coalesce(lead(id) OVER (PARTITION BY {B}, epoch, side, price ORDER BY id), 9223372036854775807) AS until FROM changes)
SELECT m.platform, m.symbol, m.id, max(price) FILTER (side = 'b') AS bb, min(price) FILTER (side = 'a') AS ba,
       coalesce(sum(qty) FILTER (side = 'b'), 0) AS tot_b, coalesce(sum(qty) FILTER (side = 'a'), 0) AS tot_a
FROM (SELECT * FROM epochs WHERE epoch > 0) m LEFT JOIN lives l
  ON l.platform = m.platform AND l.symbol = m.symbol AND l.epoch = m.epoch AND l.id <= m.id AND m.id < l.until AND l.qty <> 0
GROUP BY 1, 2, 3""".replace("\n, epochs", ", epochs", 1))
def _state_unlimited(spark, sf):
    out = ob.book_ticks(book_messages(spark, sf), limit_depth=False, slice_ids=BOOK_SLICE)
    return out.select("platform", "symbol", "id", "bb", "ba", "tot_b", "tot_a")


@query("snapshot_epoch", cte(BOOKS) + f"""
SELECT {B}, id, CAST(sum(CASE WHEN type = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY {B} ORDER BY id) AS BIGINT) AS epoch FROM books""")
def _epoch(spark, sf):
    return ob.snapshot_epochs(book_messages(spark, sf), slice_ids=BOOK_SLICE).select("platform", "symbol", "id", "epoch")


@query("side_totals", cte(*BOOK_CTE) + f"""
SELECT {B}, id, tot_b AS bid_qty, tot_a AS ask_qty, notional_b AS bid_notional, notional_a AS ask_notional,
       {rs('CASE WHEN tot_b <> 0 THEN notional_b / tot_b END')} AS bid_vwap,
       {rs('CASE WHEN tot_a <> 0 THEN notional_a / tot_a END')} AS ask_vwap FROM ticks""")
def _totals(spark, sf):
    t = ob.side_totals(ticks(spark, sf))
    return t.select("platform", "symbol", "id", "bid_qty", "ask_qty", "bid_notional", "ask_notional",
                    r(F.col("bid_vwap")).alias("bid_vwap"), r(F.col("ask_vwap")).alias("ask_vwap"))


@query("book_levels", cte(BOOKS) + f"""
SELECT {B}, id,
       array_to_string(list_transform(list_slice(list_reverse_sort(list_filter(bids, lambda x: x.qty <> 0)), 1, 2), lambda x: CAST(CAST(x.price AS INTEGER) AS VARCHAR)), ',') AS top_bids,
       array_to_string(list_transform(list_slice(list_sort(list_filter(asks, lambda x: x.qty <> 0)), 1, 2), lambda x: CAST(CAST(x.price AS INTEGER) AS VARCHAR)), ',') AS top_asks,
       list_max(list_transform(list_filter(bids, lambda x: x.qty <> 0), lambda x: x.price)) AS best_bid,
       list_min(list_transform(list_filter(asks, lambda x: x.qty <> 0), lambda x: x.price)) AS best_ask FROM books""")
def _levels(spark, sf):
    m = book_messages(spark, sf)
    text = lambda c, side: F.array_join(F.transform(ob.top_of_side(F.col(c), side, 2), lambda x: x["price"].cast("int").cast("string")), ",")
    return m.select(
        "platform", "symbol", "id", text("bids", "bid").alias("top_bids"), text("asks", "ask").alias("top_asks"),
        ob.best_level(F.col("bids"), "bid")["price"].cast("double").alias("best_bid"),
        ob.best_level(F.col("asks"), "ask")["price"].cast("double").alias("best_ask"))


@query("prev_tick", cte(*ORDER_CTE) + f"SELECT {B}, id, prev_mid, prev_spread, since AS prev_t FROM lagged")
def _prev_tick(spark, sf):
    from ticklattice.functions.scale import lag_one

    t = ob.with_prices(window_ticks(spark, sf)).withColumn("ws", tw.window_start("time_ms", WINDOW_MS))
    t = t.withColumn("_slice", F.floor(F.col("id") / BOOK_SLICE))
    t = lag_one(t, ["platform", "symbol", "ws"], ["id"], {"prev_t": "time_ms", "prev_mid": "mid", "prev_spread": "spread"})
    return t.select("platform", "symbol", "id", "prev_mid", "prev_spread", F.coalesce("prev_t", "ws").alias("prev_t"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of every window: the gold table."""
    t = tw.as_struct(trade_gold(spark, sf), tw.TRADE_FEATURES, "trade_features")
    o = tw.as_struct(order_gold(spark, sf), ob.ORDER_FEATURES, "order_features")
    return ft.pair_trade_order(t, o)


@query("pair_trade_order", cte(TRADES, TRADE_WINDOWS, *ORDER_CTE) + f"""
SELECT {K}, t.close, t.trade_count, o.n_updates, {rs('o.close_mid')} AS close_mid
FROM trade_windows t FULL OUTER JOIN order_windows o USING (platform, symbol, window_size_ms, window_end_ms)""")
def _pair(spark, sf):
    return gold(spark, sf).select(*KEYS, "trade_features.close", "trade_features.trade_count", "order_features.n_updates",
                                  r(F.col("order_features.close_mid")).alias("close_mid"))


@query("pair_by_kind", cte(TRADES, TRADE_WINDOWS, *ORDER_CTE) + f"""
SELECT {K}, t.trade_count, o.n_updates FROM trade_windows t FULL OUTER JOIN order_windows o USING (platform, symbol, window_size_ms, window_end_ms)""")
def _pair_by_kind(spark, sf):
    """The same from one table that holds the windows of both kinds."""
    t = tw.as_struct(trade_gold(spark, sf), tw.TRADE_FEATURES, "trade_features").withColumn("kind", F.lit("trade"))
    o = tw.as_struct(order_gold(spark, sf), ob.ORDER_FEATURES, "order_features").withColumn("kind", F.lit("order"))
    return ft.pair_by_kind(t.unionByName(o, allowMissingColumns=True)).select(*KEYS, "trade_features.trade_count", "order_features.n_updates")


GOLD = f"""
gold AS MATERIALIZED (SELECT {K}, t.* EXCLUDE ({K}), o.* EXCLUDE ({K})
         FROM trade_windows t FULL OUTER JOIN order_windows o USING (platform, symbol, window_size_ms, window_end_ms))"""
GOLD_CTE = (TRADES, TRADE_WINDOWS, *ORDER_CTE, GOLD)


# Every field of both sides at all offsets of the labelled frames.
FIELDS = [("trade", f) for f in ft.TRADE_FIELDS] + [("order", f) for f in ft.ORDER_FIELDS]


def _shown_sql(f: str, k: int) -> str:
    kept = f in tw_WHOLE or f in WHOLE or f in PLAIN
    return f"{f}_{_k(k)}" if kept else f"{rs(f'{f}_{_k(k)}', DIGITS.get(f, 6))} AS {f}_{_k(k)}"


@query("k_offset_join", cte(*GOLD_CTE, "shifted AS (" + shifted_sql([f for _, f in FIELDS], SHIFTS, "gold") + ")") +
       f"SELECT {K}, " + ", ".join(_shown_sql(f, k) for k in SHIFTS for _, f in FIELDS) + " FROM shifted")
def _k_offset(spark, sf):
    out = ft.k_offsets(gold(spark, sf), prev_n=12, from_next_n=3, to_next_n=7)

    def shown(side: str, f: str, k: int) -> str:
        c = f"`{k}_{side}_features`.`{f}`"
        return f"{c if f in tw_WHOLE or f in WHOLE or f in PLAIN else rs(c, DIGITS.get(f, 6))} AS {f}_{_k(k)}"

    return out.selectExpr(*KEYS, *[shown(side, f, k) for k in SHIFTS for side, f in FIELDS])


# The whole design table: every field of both sides at the twelve windows before and the row's own.
BACK = range(-12, 1)
FLAT = [("t", list(ft.TRADE_FIELDS)), ("o", list(ft.ORDER_FIELDS))]


def _flat_sql(side: str, f: str, k: int) -> str:
    value = f"CAST({f}_{_k(k)} AS DOUBLE)"
    return rs(f"coalesce(CASE WHEN isfinite({value}) THEN {value} END, 0)", DIGITS.get(f, 6) if side == "o" else 6)


@query("flatten_features", cte(*GOLD_CTE, "shifted AS (" + shifted_sql([f for _, fs in FLAT for f in fs], list(BACK), "gold") + ")") +
       f"SELECT {K}, " + ", ".join(f'{_flat_sql(side, f, k)} AS "{k}_{side}_{f}"' for side, fs in FLAT for k in BACK for f in fs) + " FROM shifted")
def _flatten(spark, sf):
    wide = ft.k_offsets(gold(spark, sf), prev_n=12, from_next_n=0, to_next_n=0)
    flat = ft.flatten_features(wide, BACK, keep=KEYS)
    groups = ft.feature_groups(flat.columns, BACK)  # fails if a column of a group is missing
    digits = {c: DIGITS.get(g[2:], 6) if g.startswith("o_") else 6 for g, cols in groups.items() for c in cols}
    return flat.selectExpr(*KEYS, *[f"{rs(f'`{c}`', digits[c])} AS `{c}`" for c in flat.columns if c not in KEYS])


@query("mergeable_accumulator", cte(*ORDER_CTE) + f"""
SELECT {B}, {rs('sum(sw)')} AS sw, {rs('sum(sw_mid) / sum(n_w)')} AS mean_mid, min(spread_min) AS spread_min,
       max(spread_max) AS spread_max, CAST(sum(n_updates) AS BIGINT) AS n_updates, CAST(sum(n_mid_up) AS BIGINT) AS n_mid_up
FROM order_windows GROUP BY {B}""")
def _merge(spark, sf):
    """Window rows hold mergeable sums, so longer spans come from them without going back to the ticks."""
    return order_gold(spark, sf).groupBy("platform", "symbol").agg(
        r(F.sum("sw")).alias("sw"), r(F.sum("sw_mid") / F.sum("n_w")).alias("mean_mid"), F.min("spread_min").alias("spread_min"),
        F.max("spread_max").alias("spread_max"), F.sum("n_updates").alias("n_updates"), F.sum("n_mid_up").alias("n_mid_up"))
