"""Queries that run as streams: the given tables arrive in parts and the result is what the stream put out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklattice.operators import order_book as ob
from ticklattice.operators import reconcile as rc
from ticklattice.operators import trade_windows as tw
from ticklattice.plans.book_catalog import GOLD_CTE, ORDER_CTE, TICKS, _out, _out_sql, gold
from ticklattice.plans.feeds_catalog import LOG, MERGED, SEQUENCE, _feeds, log, sequence
from ticklattice.plans.registry import ORACLES, query
from ticklattice.plans.views import BOOK_SLICE, BOOKS, T0_MS, TRADES, WINDOW_MS, book_messages, cte, trades
from ticklattice.plans.windows_catalog import KEYS, TRADE_WINDOWS, WHOLE, K, r, rs
from ticklattice.session import scratch_path, stored
from ticklattice.sources import raw_log as raw
from ticklattice.streaming import book_windows as bw
from ticklattice.streaming import feed_merge as fm
from ticklattice.streaming import processors as ps
from ticklattice.streaming import runner

S = ["platform", "symbol"]
CUT = T0_MS + 15 * 86_400_000  # the middle of the month: what lies before it arrives first


CUT_ID = 1212 * BOOK_SLICE  # book messages arrive by id


def halves(df: DataFrame, by: str = "time_ms", cut: int = CUT, *, once: bool = False) -> list[DataFrame]:
    """Both parts; with ``once`` the rows are made and stored once for all that reads them."""
    if once:
        df = stored(df, "arrived")
    return [df.where(F.col(by) < cut), df.where(F.col(by) >= cut)]


# Every window but each key's last two, which are still open.
@query("tumbling_trade_window", cte(TRADES, TRADE_WINDOWS) + f"SELECT {K}, " + ", ".join(
    f"{f if f in WHOLE else rs(f)} AS {f}" for f in tw.TRADE_FEATURES) +
    " FROM trade_windows QUALIFY row_number() OVER (PARTITION BY platform, symbol ORDER BY window_end_ms DESC) > 2")
def _st1(spark, sf):
    out = runner.run_in_parts(halves(trades(spark, sf), once=True), lambda s: ps.two_window_stream(s, WINDOW_MS), "two-windows", order="platform_trade_id")
    return out.select(*KEYS, *[(F.col(f) if f in WHOLE else r(F.col(f))).alias(f) for f in tw.TRADE_FEATURES])


# Trades of one kind come with the second half; those whose window the watermark had passed are dropped.
DELAY_MS = 6 * 3_600_000
LATE = f"""
seen AS (SELECT max(time_ms) - {DELAY_MS} AS mark FROM trades WHERE time_ms < {CUT} AND side = 0),
taken AS (SELECT t.* FROM trades t, seen WHERE (time_ms < {CUT} AND side = 0) OR time_ms // {WINDOW_MS} * {WINDOW_MS} + {WINDOW_MS} > mark),
last AS (SELECT max(time_ms) - {DELAY_MS} AS mark FROM trades)"""


LATE_FEATURES = {
    "trade_count": "count(*)", "sum_vol": "sum(quantity)", "sum_pv": "sum(price * quantity)", "buy_vol": "sum(CASE WHEN side = 0 THEN quantity ELSE 0 END)",
    "sell_vol": "sum(CASE WHEN side = 0 THEN 0 ELSE quantity END)", "sum_price": "sum(price)", "sum_price2": "sum(price * price)",
    "open": "arg_min(price, platform_trade_id)", "high": "max(price)", "low": "min(price)", "close": "arg_max(price, platform_trade_id)",
    "min_size": "min(quantity)", "max_size": "max(quantity)", "first_ts": "arg_min(time_ms, platform_trade_id)", "last_ts": "arg_max(time_ms, platform_trade_id)",
}  # all but those that need consecutive trades


@query("late_trades", cte(TRADES, LATE) + f"""
SELECT platform, symbol, time_ms // {WINDOW_MS} * {WINDOW_MS} + {WINDOW_MS} AS window_end_ms, """ +
       ", ".join(f"{x if f in WHOLE else rs(x)} AS {f}" for f, x in LATE_FEATURES.items()) + f"""
FROM taken, last WHERE time_ms // {WINDOW_MS} * {WINDOW_MS} + {WINDOW_MS} <= mark GROUP BY 1, 2, 3""")
def _st2(spark, sf):
    t = trades(spark, sf)
    early = (F.col("time_ms") < CUT) & (F.col("side") == 0)
    out = runner.run_in_parts([t.where(early), t.where(~early)], lambda s: ps.watermark_windows(s, WINDOW_MS, f"{DELAY_MS} milliseconds"), "late")
    return out.select(*S, "window_end_ms", *[F.col(f) if f in WHOLE else r(F.col(f)).alias(f) for f in LATE_FEATURES])


def _tagged(spark, sf):
    rest, live = _feeds(spark, sf)
    return rc.union_tagged({"rest": rest, "ws": live}, "feed")


@query("trade_reconcile_state", ORACLES["merge_api_ws_trades"])
def _st4(spark, sf):
    return runner.run_in_parts(halves(_tagged(spark, sf), "timestamp"), fm.merge_trades_stream, "merge")


@query("book_sequence_state", cte(BOOKS, SEQUENCE, MERGED) + "SELECT * FROM merged")
def _st5(spark, sf):
    return runner.run_in_parts(halves(sequence(spark, sf), "arrival", CUT_ID, once=True), ps.sequence_stream, "sequence", order="arrival")


@query("order_book_state_stream", cte(BOOKS, TICKS) + "SELECT platform, symbol, id, time_ms, bb, ba, bq0, aq0, tot_b, tot_a FROM ticks")
def _st3(spark, sf):
    out = runner.run_in_parts(halves(book_messages(spark, sf), "id", CUT_ID, once=True), bw.book_tick_stream, "ticks", order="id")
    return out.select(*S, "id", "time_ms", "bb", "ba", "bq0", "aq0", "tot_b", "tot_a")


IDLE_MS = 5_000  # a key without messages for so long puts out what it holds open


# All windows and features come out of the stream; each key's last one by its timer.
@query("order_window", cte(*ORDER_CTE) + f"SELECT {K}, {', '.join(_out_sql(f) for f in ob.ORDER_FEATURES)} FROM order_windows")
def _st7(spark, sf):
    parts = halves(book_messages(spark, sf), "id", CUT_ID, once=True)
    out = runner.run_until_idle(parts, lambda s: bw.order_window_stream(s, WINDOW_MS, idle_ms=IDLE_MS), "order-windows", IDLE_MS, order="id")
    return out.select(*KEYS, *[_out(f) for f in ob.ORDER_FEATURES])


# Every window of a trade stream: those still open when the trades end come out by the timer.
@query("flush_open_window", cte(TRADES, TRADE_WINDOWS) + f"SELECT {K}, " + ", ".join(f"{f if f in WHOLE else rs(f)} AS {f}" for f in tw.TRADE_FEATURES) + " FROM trade_windows")
def _st8(spark, sf):
    out = runner.run_until_idle(halves(trades(spark, sf), once=True), lambda s: ps.two_window_stream(s, WINDOW_MS, idle_ms=IDLE_MS), "open", IDLE_MS, order="platform_trade_id")
    return out.select(*KEYS, *[(F.col(f) if f in WHOLE else r(F.col(f))).alias(f) for f in tw.TRADE_FEATURES])


@query("checkpoint_resume", cte(TRADES, TRADE_WINDOWS) + f"SELECT {K}, trade_count, close FROM trade_windows")
def _st9(spark, sf):
    t = trades(spark, sf)
    path = scratch_path(spark, "resume")
    # A first run over what had arrived by the cut, which is a window's end, and a second that goes on from its result.
    tw.trade_windows(halves(t)[0], WINDOW_MS).write.parquet(path)
    done = spark.read.parquet(path)
    more = tw.trade_windows(ps.resume_trades(t, done, WINDOW_MS), WINDOW_MS)
    return done.unionByName(more).select(*KEYS, "trade_count", "close")


@query("micro_batch_commit", cte(LOG) + "SELECT platform, symbol, id FROM log")
def _st10(spark, sf):
    root = scratch_path(spark, "commit")
    for part in halves(log(spark, sf).select(*S, "id", "timestamp"), "timestamp"):
        part.write.mode("append").parquet(f"{root}/in")
        stream = runner.read_files(spark, f"{root}/in", part.schema)
        runner.each_batch(stream, runner.replace_batch(f"{root}/out"), f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*S, "id")


@query("log_append_stream", cte(LOG) + f"""
SELECT platform, symbol, id AS event_id, row_number() OVER (PARTITION BY platform, symbol ORDER BY timestamp >= {CUT}, id) - 1 AS id FROM log""")
def _s6(spark, sf):
    """Two micro-batches get dense ids, the second going on from the last ids of the first."""
    root = scratch_path(spark, "append")
    write = raw.appender(f"{root}/out", S, ["event_id"], lambda: F.floor(F.col("event_id") / 65_536))
    for part in halves(log(spark, sf).select(*S, F.col("id").alias("event_id"), "timestamp"), "timestamp"):
        part.write.mode("append").parquet(f"{root}/in")
        runner.each_batch(runner.read_files(spark, f"{root}/in", part.schema), write, f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*S, "event_id", "id")


@query("catch_up_then_live", cte(LOG) + "SELECT platform, symbol, id FROM log")
def _st11(spark, sf):
    root = scratch_path(spark, "live")
    first, second = halves(log(spark, sf).select(*S, "id", "timestamp"), "timestamp")
    first.write.parquet(f"{root}/in")
    build = lambda: runner.read_files(spark, f"{root}/in", first.schema).select(*S, "id")
    runner.append_to(build(), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    live = runner.append_to(build(), f"{root}/out", f"{root}/checkpoint", interval="1 second")
    second.write.mode("append").parquet(f"{root}/in")
    live.processAllAvailable()
    live.stop()
    return spark.read.parquet(f"{root}/out")


@query("trade_order_stream_join", cte(*GOLD_CTE) + f"SELECT {K}, close, n_updates FROM gold WHERE close IS NOT NULL AND n_updates IS NOT NULL")
def _j9(spark, sf):
    root = scratch_path(spark, "pair")
    both = gold(spark, sf)
    sides = {"trade": both.select(*KEYS, F.col("trade_features.close").alias("close")).where("close IS NOT NULL"),
             "order": both.select(*KEYS, F.col("order_features.n_updates").alias("n_updates")).where("n_updates IS NOT NULL")}
    for name, df in sides.items():
        df.write.parquet(f"{root}/{name}")
    t, o = (runner.read_files(spark, f"{root}/{n}", df.schema) for n, df in sides.items())
    runner.append_to(ps.pair_windows_stream(t, o, WINDOW_MS), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*KEYS, "close", "n_updates")


@query("live_source_sink", cte(LOG) + "SELECT platform, symbol, id, '{\"id\":' || id || ',\"event_type\":\"' || event_type || '\"}' AS record FROM log")
def _s21(spark, sf):
    build = lambda s: s.select(*S, "id", F.to_json(F.struct("id", "event_type")).alias("record"))
    return runner.run_in_parts(halves(log(spark, sf).select(*S, "id", "timestamp", "event_type"), "timestamp"), build, "pubsub")


class ChangeCounter:
    """A row handler: puts a row out when a user's event type changes, with the number of changes so far."""

    def __call__(self, state, row):
        state = state or {"kind": None, "changes": -1}
        if row["event_type"] == state["kind"]:
            return state, []
        state = {"kind": row["event_type"], "changes": state["changes"] + 1}
        return state, [{"user_id": row["user_id"], "id": row["id"], "changes": state["changes"]}]


@query("row_handler", cte(LOG) + """
, c AS (SELECT user_id, id FROM log QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY id))
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id) - 1 AS changes FROM c""".replace("\n, c", ", c", 1))
def _x3(spark, sf):
    rows = log(spark, sf).select("user_id", "id", "timestamp", "event_type")
    build = lambda s: ps.handle_rows(s.drop("timestamp"), ["user_id"], ChangeCounter(), ["id"], "user_id long, id long, changes long", many_keys=True)
    return runner.run_in_parts(halves(rows, "timestamp", once=True), build, "handler", order="id")


@query("consumer_streams", cte(LOG) + """
SELECT 'first' AS consumer, platform, symbol, id FROM log WHERE symbol IN ('s0_usdt', 's1_usdt')
UNION ALL SELECT 'second', platform, symbol, id FROM log WHERE timestamp >= (SELECT min(timestamp) FROM log) AND platform = 'kraken'""")
def _d7(spark, sf):
    """Two consumers of one log, each with a selector and a checkpoint of its own."""
    root = scratch_path(spark, "consumers")
    rows = log(spark, sf).select(*S, "id", "timestamp")
    rows.write.parquet(f"{root}/in")
    out = {}
    for name, pick in (("first", F.col("symbol").isin("s0_usdt", "s1_usdt")), ("second", F.col("platform") == "kraken")):
        stream = runner.read_files(spark, f"{root}/in", rows.schema).where(pick)
        runner.append_to(stream, f"{root}/{name}", f"{root}/checkpoint-{name}").awaitTermination()
        out[name] = spark.read.schema(rows.schema).parquet(f"{root}/{name}")
    return rc.union_tagged(out, "consumer").select("consumer", *S, "id")
