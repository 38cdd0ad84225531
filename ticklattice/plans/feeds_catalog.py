"""Queries over raw logs, normalisation and feed reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.functions import text as tx
from ticklattice.operators import normalize as nz
from ticklattice.operators import reconcile as rc
from ticklattice.operators import symbols as sy
from ticklattice.operators import trade_windows as tw
from ticklattice.plans.registry import query
from ticklattice.plans.views import BOOK_SLICE, BOOKS, TRADES, WINDOW_MS, book_messages, cte, millis, platform_of, symbol_of, table, trades
from ticklattice.plans.windows_catalog import TRADE_WINDOWS, K, r, rs, trade_gold
from ticklattice.session import scratch_path
from ticklattice.sources import raw_log as lg
from ticklattice.sources import results as res
from ticklattice.sources import window_store as ws

S = ["platform", "symbol"]


def by_id():
    return F.floor(F.col("id") / 65_536)


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a raw log of trade messages; the event type is kept for building feeds."""
    e = table(spark, sf, "events")
    t = millis(F.col("ts"))
    data = F.struct(
        F.lit("trade").alias("e"), t.alias("E"), F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string"), F.lit("USDT")).alias("s"),
        F.col("event_id").alias("t"), F.col("value").cast("string").alias("p"),
        (F.get_json_object("props", "$.k").cast("double") / 10).cast("string").alias("q"), t.alias("T"),
        F.col("event_type").isin("error", "signup", "purchase").alias("m"), F.lit(True).alias("M"))
    return e.select(
        platform_of(F.col("event_id")).alias("platform"), F.lit("ws_trade").alias("source"), symbol_of(F.col("user_id")).alias("symbol"),
        F.col("event_id").alias("id"), t.alias("timestamp"),
        F.to_json(F.struct(F.concat(F.lower(data["s"]), F.lit("@trade")).alias("stream"), data.alias("data"))).alias("payload"),
        "event_type", "value", "user_id")


LOG = """
log AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'kraken' ELSE 'binance' END AS platform, 's' || (user_id % 4) || '_usdt' AS symbol,
               event_id AS id, epoch_us(ts) // 1000 AS timestamp, event_type, value, user_id, props, ts FROM events)"""
L = "platform, symbol, id, timestamp"
OUT = [*S, "id", "timestamp"]

# --- the log ---------------------------------------------------------------------------------------------------------


@query("log_scan_from", cte(LOG) + f"""
SELECT {L} FROM log JOIN (SELECT platform, symbol, (min(id) + max(id)) // 2 AS from_id FROM log GROUP BY 1, 2) USING (platform, symbol)
WHERE id >= from_id""")
def _scan(spark, sf):
    rows = log(spark, sf)
    starts = rows.groupBy(*S).agg(F.expr("(min(id) + max(id)) div 2").alias("from_id"))
    return lg.scan_from_each(rows, starts, S).select(*OUT)


@query("log_range", cte(LOG) + f"""
SELECT {L} FROM log WHERE id >= 100 QUALIFY row_number() OVER (PARTITION BY platform, symbol ORDER BY id) <= 25""")
def _range(spark, sf):
    return lg.first_n(log(spark, sf), S, 25, from_id=100).select(*OUT)


@query("log_last_n", cte(LOG) + f"SELECT {L} FROM log QUALIFY row_number() OVER (PARTITION BY platform, symbol ORDER BY id DESC) <= 10")
def _last_n(spark, sf):
    return lg.last_n(log(spark, sf), S, 10).select(*OUT)


@query("log_last_record", cte(LOG) + "SELECT platform, symbol, max(id) AS id, arg_max(timestamp, id) AS timestamp FROM log GROUP BY 1, 2")
def _last(spark, sf):
    return lg.last_n(log(spark, sf), S, 1).select(*OUT)


@query("log_reverse_scan", cte(LOG) + f"SELECT {L} FROM log WHERE platform = 'binance' AND symbol = 's1_usdt' ORDER BY id DESC")
def _reverse(spark, sf):
    return lg.scan_from(log(spark, sf), 0, reverse=True, platform="binance", symbol="s1_usdt").select(*OUT)


@query("log_full_scan", cte(LOG) + "SELECT platform, symbol, id, timestamp, '$.data.t' AS path, CAST(id AS VARCHAR) AS trade_id FROM log")
def _full(spark, sf):
    """Written as a partitioned log and read back."""
    path = scratch_path(spark, "log")
    log(spark, sf).select("platform", "source", "symbol", "id", "timestamp", "payload").repartitionByRange("platform", "symbol", "id").write.partitionBy(
        "platform", "source", "symbol").parquet(path)
    return lg.read_log(spark, path).select(*OUT, F.lit("$.data.t").alias("path"), F.get_json_object("payload", "$.data.t").alias("trade_id"))


@query("log_append_with_id", cte(LOG) + f"""
, last AS (SELECT platform, symbol, max(id) AS last_id FROM log WHERE event_type = 'view' GROUP BY 1, 2)
SELECT l.platform, l.symbol, timestamp, value, coalesce(last_id + 1, 0) + row_number() OVER (PARTITION BY l.platform, l.symbol ORDER BY timestamp, id) - 1 AS id
FROM log l LEFT JOIN last USING (platform, symbol) WHERE event_type <> 'view'""".replace("\n, last", ", last", 1))
def _append(spark, sf):
    rows = log(spark, sf)
    fresh = rows.where("event_type <> 'view'").withColumnRenamed("id", "seq")
    out = lg.assign_ids(fresh, rows.where("event_type = 'view'"), S, ["timestamp", "seq"], F.floor(F.col("timestamp") / 3_600_000))
    return out.select(*S, "timestamp", "value", "id")


@query("upsert_last", cte(LOG) + "SELECT user_id, max(id) AS id, arg_max(event_type, id) AS event_type, arg_max(value, id) AS value FROM log GROUP BY 1")
def _upsert(spark, sf):
    rows = log(spark, sf).select("user_id", "id", "event_type", "value")
    first = lg.last_record(rows.where("event_type IN ('view', 'click')"), ["user_id"])
    return lg.upsert_last(first, rows.where("event_type NOT IN ('view', 'click')"), ["user_id"], ["id"])


@query("replace_by_id", cte(LOG) + "SELECT platform, symbol, id, CASE WHEN event_type = 'purchase' THEN value * 2 ELSE value END AS value FROM log")
def _replace(spark, sf):
    rows = log(spark, sf).select(*S, "id", "value", "event_type")
    changed = rows.where("event_type = 'purchase'").withColumn("value", F.col("value") * 2).drop("event_type")
    return lg.replace_by_id(rows.drop("event_type"), changed, S)


@query("truncate_before", cte(LOG) + f"""
SELECT {L} FROM log JOIN (SELECT platform, symbol, (min(id) + max(id)) // 2 AS keep FROM log GROUP BY 1, 2) USING (platform, symbol) WHERE id >= keep""")
def _truncate(spark, sf):
    rows = log(spark, sf)
    return lg.truncate_before(rows, rows.groupBy(*S).agg(F.expr("(min(id) + max(id)) div 2").alias("keep_from")), S).select(*OUT)


@query("append_if_changed", cte(LOG) + """
, marked AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS starts FROM log
             WINDOW w AS (PARTITION BY platform, symbol ORDER BY id)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY platform, symbol ORDER BY id) - 1 AS version FROM marked)
SELECT platform, symbol, CAST(version AS BIGINT) AS version, min(id) AS id, max(timestamp) AS timestamp, arg_min(event_type, id) AS payload
FROM runs GROUP BY 1, 2, 3""".replace("\n, marked", ", marked", 1))
def _changed(spark, sf):
    return lg.append_if_changed(log(spark, sf).select(*OUT, F.col("event_type").alias("payload")), S, by_id())


@query("reject_stale_batch", cte(LOG) + """
, batches AS (SELECT *, id + CAST(json_extract_string(props, '$.k') AS BIGINT) AS last_id FROM log)
SELECT platform, symbol, id, last_id FROM batches
QUALIFY last_id >= coalesce(max(last_id) OVER (PARTITION BY platform, symbol ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), last_id)""".replace("\n, b", ", b", 1))
def _stale(spark, sf):
    rows = log(spark, sf).select(*S, "id", (F.col("id") + F.expr("cast(round(cast(get_json_object(payload, '$.data.q') as double) * 10) as long)")).alias("last_id"))
    return lg.reject_stale(rows, S, by_id())


@query("drop_empty_response", cte(LOG) + f"SELECT {L} FROM log WHERE event_type NOT IN ('error', 'signup')")
def _empty(spark, sf):
    body = F.when(F.col("event_type") == "error", "[]").when(F.col("event_type") == "signup", "\"none\"").otherwise("[[1]]")
    rows = log(spark, sf).withColumn("result", F.create_map(F.lit("last"), F.lit("[1]"), F.lit("XXBTZUSD"), body))
    return rows.where(lg.has_data(F.col("result"))).select(*OUT)


def _jsonl_lines(spark, sf):
    rows = log(spark, sf)
    good = F.to_json(F.struct(F.col("timestamp"), F.struct(F.col("id"), F.col("value")).alias("message")))
    return rows.select(F.when(F.col("event_type") == "error", F.concat(F.lit("{\"timestamp\": "), F.col("id").cast("string")))
                       .when(F.col("event_type") == "signup", " ").otherwise(good).alias("value"))


@query("jsonl_load_lenient", cte(LOG) + """
SELECT 'ok' AS state, timestamp, '{"id":' || id || ',"value":' || CAST(value AS VARCHAR) || '}' AS message_data FROM log WHERE event_type NOT IN ('error', 'signup')
UNION ALL SELECT 'bad', NULL, '{"timestamp": ' || id FROM log WHERE event_type = 'error'""")
def _jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    _jsonl_lines(spark, sf).write.text(path)
    good, bad = lg.lenient_jsonl(spark.read.text(path))
    return good.select(F.lit("ok").alias("state"), "timestamp", "message_data").unionByName(
        bad.select(F.lit("bad").alias("state"), F.lit(None).cast("long").alias("timestamp"), F.col("data").alias("message_data")))


@query("dump_to_jsonl", cte(LOG) + "SELECT '{\"id\":' || id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM log")
def _dump(spark, sf):
    path = scratch_path(spark, "dump")
    lg.to_jsonl(log(spark, sf).select("id", "event_type")).write.text(path)
    return spark.read.text(path)


@query("windows_to_parquet", cte(TRADES, TRADE_WINDOWS) + f"""
SELECT {K}, close, CAST(strftime(make_timestamp(window_end_ms // 15552000000 * 15552000000 * 1000), '%Y-%m-%d') AS VARCHAR) AS date FROM trade_windows""")
def _store(spark, sf):
    path = scratch_path(spark, "windows")
    ws.write_windows(trade_gold(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select(*tw.KEYS, "window_end_ms", "close", F.col("date").cast("string").alias("date"))


@query("scan_complete_windows", cte(TRADES, TRADE_WINDOWS) + f"""
SELECT {K}, close FROM trade_windows WHERE platform = 'kraken' AND window_end_ms BETWEEN 1704500000000 AND 1706200000000""")
def _scan_windows(spark, sf):
    path = scratch_path(spark, "windows")
    ws.write_windows(tw.as_struct(trade_gold(spark, sf), tw.TRADE_FEATURES, "trade_features"), path)
    out = ws.scan_complete(spark, path, from_ms=1_704_500_000_000, to_ms=1_706_200_000_000, platform="kraken")
    return out.select(*tw.KEYS, "window_end_ms", "trade_features.close")


def _results(spark, sf, types, first_id):
    """Per platform, symbol and event type a made-up training result, its metrics counted from the events."""
    n = F.count("*")
    g = log(spark, sf).where(F.col("event_type").isin(*types)).groupBy(*S, "event_type", (F.col("user_id") % 5).alias("u")).agg(
        n.alias("n"), F.sum("value").alias("v"), F.max("id").alias("version"))
    d = F.lit(0.0)
    return g.select(
        (F.lit(first_id) + F.row_number().over(W.orderBy("platform", "symbol", "event_type", "u"))).cast("long").alias("result_id"),
        "symbol", "platform", F.concat(F.lit("target_high_up_"), F.col("u").cast("string"), F.lit("p")).alias("target_name"),
        F.lit(0).cast("long").alias("window_start"), F.lit(1).cast("long").alias("window_end"), F.lit(WINDOW_MS).cast("long").alias("window_size_ms"),
        F.lit("decision_tree").alias("methodology"), F.array(F.lit("t_close")).alias("used_features"), F.lit(12).alias("used_features_lookback"),
        F.lit("zscore").alias("transformation"), F.col("n").alias("training_data_length"), F.round("v", 2).alias("training_data_std"),
        *[d.alias(m) for m in res.METRICS[2:8]], *[F.lit(0).cast("long").alias(m) for m in res.METRICS[8:]], "version", "event_type")


@query("result_upsert", cte(LOG) + """
, g AS (SELECT platform, symbol, user_id % 5 AS u, event_type, count(*) AS n, round(sum(value), 2) AS v, max(id) AS version FROM log GROUP BY ALL),
stored AS (SELECT *, row_number() OVER (ORDER BY platform, symbol, event_type, u) AS result_id FROM g WHERE event_type = 'view'),
fresh AS (SELECT platform, symbol, u, arg_max(n, version) AS n, arg_max(v, version) AS v FROM g WHERE event_type <> 'view' AND u <> 3 GROUP BY 1, 2, 3),
kept AS (SELECT *, u <> 4 AS known FROM stored),
m AS (SELECT coalesce(s.platform, f.platform) AS platform, coalesce(s.symbol, f.symbol) AS symbol, coalesce(s.u, f.u) AS u, s.result_id,
             coalesce(f.n, s.n) AS n, coalesce(f.v, s.v) AS v
      FROM (SELECT * FROM kept WHERE known) s FULL OUTER JOIN fresh f ON s.platform = f.platform AND s.symbol = f.symbol AND s.u = f.u)
SELECT platform, symbol, 'target_high_up_' || u || 'p' AS target_name, n AS training_data_length, v AS training_data_std,
       CAST(coalesce(result_id, (SELECT max(result_id) FROM kept WHERE known)
         + row_number() OVER (PARTITION BY result_id IS NULL ORDER BY symbol, platform, u)) AS BIGINT) AS result_id FROM m""".replace("\n, g", ", g", 1))
def _results_upsert(spark, sf):
    stored = _results(spark, sf, ["view"], 0).where("target_name <> 'target_high_up_4p'").drop("version", "event_type")
    fresh = _results(spark, sf, ["click", "error", "signup", "purchase"], 0).where("target_name <> 'target_high_up_3p'").drop("result_id", "event_type")
    return res.upsert_results(stored, fresh).select("platform", "symbol", "target_name", "training_data_length", "training_data_std", "result_id")


@query("directory_stats", cte(LOG) + """
SELECT 'log/platform=' || platform AS directory, CAST(sum(strlen(symbol || ' ' || id) + 1) AS BIGINT) AS bytes, true AS has_files FROM log GROUP BY platform""")
def _stats(spark, sf):
    """The log as text in a folder per platform: what each folder holds is the length of its lines."""
    root = scratch_path(spark, "folders")
    lines = log(spark, sf).select("platform", F.concat_ws(" ", "symbol", F.col("id").cast("string")).alias("line"))
    lines.write.partitionBy("platform").text(f"{root}/log")
    out = lg.directory_stats(spark, root, ["log/**"])
    return out.where("size_bytes > 0").select("directory", F.col("size_bytes").alias("bytes"), (F.col("file_count") > 0).alias("has_files"))


# --- normalisation ---------------------------------------------------------------------------------------------------

UNIFIED = ["platform", "symbol", "platform_trade_id", "time_ms", "price", "quantity", "side", "order_type"]
U = ", ".join(UNIFIED)


def _trade_sql(platform: str, price: str = "price_s", qty: str = "quantity_s", side: str = "side", order_type: str = "0") -> str:
    return (cte(TRADES) + f"SELECT '{platform}' AS platform, symbol, platform_trade_id, time_ms, {price} AS price, {qty} AS quantity, "
            f"CAST({side} AS INTEGER) AS side, CAST({order_type} AS INTEGER) AS order_type FROM trades")


PLAIN = {"price": "regexp_replace(price_s, '\\.0$', '')", "qty": "regexp_replace(quantity_s, '\\.0$', '')"}


@query("binance_ws_trade", _trade_sql("binance"))
def _p1(spark, sf):
    return nz.binance_ws_trades(log(spark, sf)).select(*UNIFIED)


def _batched(spark, sf, item, name):
    """Trades gathered into messages of at most a thousand trades of a symbol, in trade order."""
    t = trades(spark, sf).withColumn("iso", F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return t.groupBy("symbol", F.floor(F.col("platform_trade_id") / 1000).alias("q")).agg(
        F.array_sort(F.collect_list(F.struct("platform_trade_id", item))).alias("items")).select(
        "symbol", "q", F.transform("items", lambda x: x[name]).alias("items"))


@query("binance_rest_trades", _trade_sql("binance"))
def _p2(spark, sf):
    item = F.struct(F.col("platform_trade_id").alias("id"), "price", F.col("quantity").alias("qty"), F.lit("0").alias("quoteQty"),
                    F.col("time_ms").alias("time"), (F.col("side") == 1).alias("isBuyerMaker"), F.lit(True).alias("isBestMatch")).alias("item")
    rows = _batched(spark, sf, item, "item").select("symbol", F.to_json(F.struct(
        F.struct(F.struct(F.lit("X").alias("symbol")).alias("query")).alias("request"), F.col("items").alias("response"))).alias("payload"))
    return nz.binance_rest_trades(rows).select(*UNIFIED)


@query("kraken_ws_trades", _trade_sql("kraken", PLAIN["price"], PLAIN["qty"], order_type="order_type"))
def _p3(spark, sf):
    item = F.struct(F.col("symbol"), F.when(F.col("side") == 1, "sell").otherwise("buy").alias("side"), F.col("price").cast("double").alias("price"),
                    F.col("quantity").cast("double").alias("qty"), F.when(F.col("order_type") == 1, "limit").otherwise("market").alias("ord_type"),
                    F.col("platform_trade_id").alias("trade_id"), F.col("iso").alias("timestamp")).alias("item")
    rows = _batched(spark, sf, item, "item").select("symbol", F.to_json(F.struct(
        F.lit("trade").alias("channel"), F.lit("update").alias("type"), F.col("items").alias("data"))).alias("payload"))
    return nz.kraken_ws_trades(rows).select(*UNIFIED)


@query("kraken_rest_trades", _trade_sql("kraken", order_type="order_type"))
def _p4(spark, sf):
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    sec = F.concat_ws(".", F.expr("cast(time_ms div 1000 as string)"), F.lpad((F.col("time_ms") % 1000).cast("string"), 3, "0"))
    item = F.concat(F.lit("["), F.concat_ws(",", q(F.col("price")), q(F.col("quantity")), F.concat(sec, F.lit("5")),
        F.when(F.col("side") == 1, '"s"').otherwise('"b"'), F.when(F.col("order_type") == 1, '"l"').otherwise('"m"'), F.lit('""'),
        F.col("platform_trade_id").cast("string")), F.lit("]")).alias("item")
    rows = _batched(spark, sf, item, "item").select("symbol", F.concat(
        F.lit('{"response":{"error":[],"result":{"XXBTZUSD":['), F.array_join("items", ","), F.lit('],"last":"1"}}}')).alias("payload"))
    return nz.kraken_rest_trades(rows).select(*UNIFIED)


def _level_text(c):
    return F.array_join(F.transform(c, lambda x: F.concat(x["price"], F.lit("x"), x["qty"])), ",")


def _sql_levels(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: CAST(CAST(x.price AS INTEGER) AS VARCHAR) || 'x' || CAST(CAST(x.qty AS INTEGER) AS VARCHAR)), ',')"


def _raw_books(spark, sf, body):
    short = lambda c: F.transform(c, lambda x: F.array(x["price"].cast("int").cast("string"), x["qty"].cast("int").cast("string")))
    m = book_messages(spark, sf).withColumn("b", short(F.col("bids"))).withColumn("a", short(F.col("asks")))
    return m.select("symbol", "id", (F.col("time_ms") + 5).alias("timestamp"), F.to_json(body(m)).alias("payload"))


def _book_sql(platform: str, kind: str, time: str) -> str:
    return cte(BOOKS) + f"SELECT '{platform}' AS platform, symbol, id, {kind} AS type, {time} AS time_ms, {_sql_levels('bids')} AS bids, {_sql_levels('asks')} AS asks FROM books"


def _book_out(df):
    return df.select("platform", "symbol", "id", "type", "time_ms", _level_text(F.col("bids")).alias("bids"), _level_text(F.col("asks")).alias("asks"))


@query("binance_book_snapshot", _book_sql("binance", "'snapshot'", "time_ms + 5"))
def _p5(spark, sf):
    return _book_out(nz.binance_snapshots(_raw_books(spark, sf, lambda m: F.struct(
        F.struct(F.struct(F.lit("X").alias("symbol")).alias("query")).alias("request"),
        F.struct(F.col("id").alias("lastUpdateId"), F.col("b").alias("bids"), F.col("a").alias("asks")).alias("response")))))


@query("binance_book_diff", _book_sql("binance", "'update'", "time_ms"))
def _p6(spark, sf):
    return _book_out(nz.binance_diffs(_raw_books(spark, sf, lambda m: F.struct(F.lit("x@depth").alias("stream"), F.struct(
        F.lit("depthUpdate").alias("e"), F.col("time_ms").alias("E"), F.lit("X").alias("s"), F.col("id").alias("U"), F.col("id").alias("u"), "b", "a").alias("data")))))


@query("kraken_book", _book_sql("kraken", "type", "CASE WHEN type = 'snapshot' THEN time_ms + 5 ELSE time_ms END"))
def _p7(spark, sf):
    num = lambda c: F.transform(c, lambda x: F.struct(x["price"].cast("double").alias("price"), x["qty"].cast("double").alias("qty")))
    iso = F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return _book_out(nz.kraken_books(_raw_books(spark, sf, lambda m: F.struct(F.lit("book").alias("channel"), "type", F.array(F.struct(
        F.lit("X/Y").alias("symbol"), num(F.col("bids")).alias("bids"), num(F.col("asks")).alias("asks"), F.lit(1).alias("checksum"),
        F.when(F.col("type") == "update", iso).alias("timestamp"))).alias("data")))))


def _nations(spark, sf):
    n = table(spark, sf, "nation").withColumn("base", F.regexp_replace("n_name", "_", ""))
    codes = F.array(*[F.lit(c) for c in list(sy.KRAKEN_CODES)[:12]])
    return n.withColumn("code", F.element_at(codes, (F.col("n_nationkey") % 12 + 1).cast("int")))


NATIONS = """
nations AS (SELECT *, replace(n_name, '_', '') AS base,
  list_extract(['XETC','XETH','XLTC','XMLN','XREP','XXLM','XXMR','XXRP','XZEC','ZAUD','ZCAD','ZEUR'], n_nationkey % 12 + 1) AS code,
  list_extract(['ETC','ETH','LTC','MLN','REP','XLM','XMR','XRP','ZEC','AUD','CAD','EUR'], n_nationkey % 12 + 1) AS common FROM nation)"""


def _exchange_info(n):
    return n.where("n_nationkey <> 7").select(F.concat("base", F.lit("USDT")).alias("symbol"), F.col("base").alias("baseAsset"), F.lit("USDT").alias("quoteAsset"))


@query("normalize_symbol_binance", cte(NATIONS) + """
SELECT c_custkey, lower(base) || 'usdt' AS ticker, CASE WHEN n_nationkey <> 7 THEN lower(base) || '_usdt' END AS symbol
FROM customer JOIN nations ON c_nationkey = n_nationkey""")
def _p8(spark, sf):
    n = _nations(spark, sf)
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower(F.concat("base", F.lit("usdt"))).alias("ticker"))
    return sy.from_binance(c, "ticker", _exchange_info(n)).select("c_custkey", "ticker", "symbol")


@query("normalize_symbol_kraken", cte(NATIONS) + """
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN code || '/ZUSD' ELSE lower(n_name) END AS ticker,
       CASE WHEN c_acctbal > 5000 THEN lower(common) || '_usd' WHEN n_nationkey <> 7 THEN lower(common) || '_usdt' END AS symbol
FROM customer JOIN nations ON c_nationkey = n_nationkey""")
def _p9(spark, sf):
    n = _nations(spark, sf)
    pairs = n.where("n_nationkey <> 7").select(F.upper("n_name").alias("altname"), F.concat_ws("/", "code", F.lit("USDT")).alias("wsname"))
    ticker = F.when(F.col("c_acctbal") > 5000, F.concat_ws("/", "code", F.lit("ZUSD"))).otherwise(F.lower("n_name"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", ticker.alias("ticker"))
    return sy.from_kraken(c, "ticker", pairs).select("c_custkey", "ticker", "symbol")


@query("to_binance_symbol", cte(NATIONS) + """
SELECT c_custkey, lower(base) || '_usdt' AS symbol, CASE WHEN n_nationkey <> 7 THEN upper(base) || 'USDT' END AS ticker
FROM customer JOIN nations ON c_nationkey = n_nationkey""")
def _p10(spark, sf):
    n = _nations(spark, sf)
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower(F.concat("base", F.lit("_usdt"))).alias("symbol"))
    return sy.to_binance(c, "symbol", _exchange_info(n)).select("c_custkey", "symbol", "ticker")


@query("to_kraken_symbol", cte(NATIONS) + """
SELECT c_custkey, lower(common) || '_eur' AS symbol, CASE WHEN common <> 'LTC' THEN common || '/EUR' END AS ws_symbol,
       CASE WHEN common <> 'LTC' THEN common || 'EUR' END AS altname
FROM customer JOIN nations ON c_nationkey = n_nationkey""")
def _p11(spark, sf):
    n = _nations(spark, sf).withColumn("common", sy.common_code(F.col("code")))
    pairs = n.select(F.concat("common", F.lit("EUR")).alias("altname"), F.col("code").alias("base"), F.lit("ZEUR").alias("quote")).distinct()
    assets = n.select(F.col("code").alias("asset")).where("asset <> 'XLTC'").distinct().union(n.select(F.lit("ZEUR")).distinct())
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower(F.concat("common", F.lit("_eur"))).alias("symbol"))
    return sy.to_kraken(c, "symbol", pairs, assets).select("c_custkey", "symbol", "ws_symbol", "altname")


@query("normalize_name", """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[^a-z0-9_]', '_', 'g'), '_{2,}', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM pages""")
def _p12(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.normalize_name(F.col("url")).alias("name"))


def _mixed_messages(spark, sf):
    """Per event one message of a kind that follows from its type, for each exchange by platform."""
    rows = log(spark, sf)
    kind = F.col("event_type")
    binance = (F.when(kind == "view", F.col("payload"))
               .when(kind == "click", '{"stream":"x@depth","data":{"e":"depthUpdate","E":1,"s":"X","U":1,"u":2,"b":[["1","2"]],"a":[]}}')
               .when(kind == "purchase", '{"stream":"x@depth5@100ms","data":{"lastUpdateId":5,"bids":[["1","2"]],"asks":[]}}')
               .when(kind == "error", '{"result":null,"id":3}').otherwise('{"hello":1}'))
    kraken = (F.when(kind == "view", '{"channel":"trade","type":"update","data":[{"symbol":"A/B","side":"buy","price":1.5,"qty":2,"ord_type":"limit","trade_id":1,"timestamp":"2024-01-01T00:00:00Z"}]}')
              .when(kind == "click", '{"channel":"book","type":"update","data":[{"symbol":"A/B","bids":[],"asks":[],"timestamp":"2024-01-01T00:00:00Z"}]}')
              .when(kind == "purchase", '{"channel":"heartbeat"}')
              .when(kind == "error", '{"method":"subscribe","result":{"channel":"book","snapshot":true,"symbol":"A/B"},"success":true,"time_in":"","time_out":""}')
              .otherwise('{"channel":'))
    return rows.withColumn("payload", F.when(F.col("platform") == "binance", binance).otherwise(kraken))


@query("route_by_type", cte(LOG) + """
SELECT platform, id, CASE WHEN platform = 'binance' THEN CASE event_type WHEN 'view' THEN 'trade' WHEN 'click' THEN 'diff_depth' WHEN 'purchase' THEN 'partial_depth' WHEN 'error' THEN 'ack' END
  ELSE CASE event_type WHEN 'view' THEN 'trade' WHEN 'click' THEN 'book' WHEN 'purchase' THEN 'heartbeat' WHEN 'error' THEN 'ack' END END AS stream_type FROM log""")
def _p13(spark, sf):
    p = F.col("payload")
    kind = F.when(F.col("platform") == "binance", nz.stream_type(p, "binance")).otherwise(nz.stream_type(p, "kraken"))
    return _mixed_messages(spark, sf).select("platform", "id", kind.alias("stream_type"))


@query("validate_schema", cte(LOG) + """
SELECT platform, id, CASE WHEN platform = 'binance' THEN CASE WHEN event_type = 'signup' THEN 'unknown stream' END
  WHEN event_type = 'signup' THEN 'not json' WHEN event_type = 'click' THEN 'missing field' END AS error FROM log""")
def _p14(spark, sf):
    m = _mixed_messages(spark, sf)
    checked = [nz.with_errors(m.where(F.col("platform") == e), e) for e in ("binance", "kraken")]
    return checked[0].unionByName(checked[1]).select("platform", "id", "error")


@query("quarantine", cte(LOG) + """
SELECT platform, id, 'unknown stream' AS error FROM log WHERE platform = 'binance' AND event_type = 'signup'
UNION ALL SELECT platform, id, CASE WHEN event_type = 'signup' THEN 'not json' ELSE 'missing field' END FROM log
WHERE platform = 'kraken' AND event_type IN ('signup', 'click')""")
def _quarantine(spark, sf):
    m = _mixed_messages(spark, sf)
    bad = [nz.validate(m.where(F.col("platform") == e), e)[1] for e in ("binance", "kraken")]
    return bad[0].unionByName(bad[1]).select("platform", "id", "error")


@query("split_by_symbol", cte(TRADES) + """
SELECT platform_trade_id // 1000 AS id, symbol, string_agg(CAST(platform_trade_id AS VARCHAR), ',' ORDER BY platform_trade_id) AS trade_ids FROM trades GROUP BY 1, 2""")
def _p15(spark, sf):
    m = trades(spark, sf).groupBy(F.floor(F.col("platform_trade_id") / 1000).alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("platform_trade_id", "symbol"))).alias("data"))
    out = nz.split_by_symbol(m)
    return out.select("id", "symbol", F.array_join(F.transform("data", lambda x: x["platform_trade_id"].cast("string")), ",").alias("trade_ids"))


@query("group_to_multimap", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def _g41(spark, sf):
    out = nz.group_in_order(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderkey", "orders")
    return out.select("o_custkey", F.array_join(F.transform("orders", lambda x: x.cast("string")), ",").alias("orders"))


@query("one_to_many", cte(BOOKS) + """
SELECT id, price, qty FROM (SELECT id, unnest(bids, recursive := true) FROM books UNION ALL SELECT id, unnest(asks, recursive := true) FROM books)""")
def _x4(spark, sf):
    m = book_messages(spark, sf)
    return m.select("id", F.explode(F.concat("bids", "asks")).alias("l")).select("id", F.col("l.price").cast("double").alias("price"), F.col("l.qty").cast("double").alias("qty"))


@query("skip_processed", cte(LOG) + f"""
SELECT {L} FROM log LEFT JOIN (SELECT platform, symbol, max(id) // 2 AS last FROM log WHERE event_type = 'purchase' GROUP BY 1, 2) USING (platform, symbol)
WHERE id > coalesce(last, -1)""")
def _p16(spark, sf):
    rows = log(spark, sf)
    state = rows.where("event_type = 'purchase'").groupBy(*S).agg(F.expr("max(id) div 2").alias("last_processed_id"))
    return nz.skip_processed(rows, state, S).select(*OUT)


@query("filter_platform_symbol_window", cte(TRADES, TRADE_WINDOWS) + f"SELECT {K}, close FROM trade_windows WHERE platform = 'kraken' AND symbol = 's2_usdt' ORDER BY window_end_ms")
def _p17(spark, sf):
    return nz.filter_windows(trade_gold(spark, sf), "kraken", "s2_usdt", WINDOW_MS).select(*tw.KEYS, "window_end_ms", "close")


@query("parse_target_name", """
SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN 'high' END AS price_type,
       CASE WHEN event_type NOT IN ('error', 'signup') THEN 'up' END AS direction, CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS threshold FROM events""")
def _p26(spark, sf):
    name = F.concat(F.when(F.col("event_type") == "error", "target_mid_up_").otherwise("target_high_up_"), F.col("value").cast("string"),
                    F.when(F.col("event_type") == "signup", "x").otherwise("p"))
    return table(spark, sf, "events").select("event_id", tx.parse_target_name(name).alias("t")).select("event_id", "t.price_type", "t.direction", "t.threshold")


# --- feeds -----------------------------------------------------------------------------------------------------------

REST, WS = ("view", "click", "purchase"), ("purchase", "error", "signup")


def _feeds(spark, sf):
    rows = log(spark, sf).select(*S, "id", "timestamp", "event_type")
    pick = lambda kinds: rows.where(F.col("event_type").isin(*kinds)).drop("event_type")
    return pick(REST), pick(WS)


FEEDS = """
feeds AS (SELECT *, 'rest' AS feed FROM log WHERE event_type IN ('view', 'click', 'purchase')
          UNION ALL SELECT *, 'ws' AS feed FROM log WHERE event_type IN ('purchase', 'error', 'signup'))"""


@query("merge_api_ws_trades", cte(LOG, FEEDS) + """
, sure AS (SELECT platform, symbol, least(max(id) FILTER (feed = 'rest'), max(id) FILTER (feed = 'ws')) AS sure FROM feeds GROUP BY 1, 2),
once AS (SELECT platform, symbol, id, min(feed) AS feed FROM feeds WHERE id > 0 GROUP BY 1, 2, 3),
gaps AS (SELECT *, id - lag(id, 1, 0) OVER (PARTITION BY platform, symbol ORDER BY id) > 1 AS hole FROM once),
cut AS (SELECT platform, symbol, min(id) FILTER (hole AND id > sure) AS cut FROM gaps JOIN sure USING (platform, symbol) GROUP BY 1, 2)
SELECT o.platform, o.symbol, o.id, o.feed FROM once o JOIN cut USING (platform, symbol) WHERE cut IS NULL OR id < cut""".replace("\n, sure", ", sure", 1))
def _j3(spark, sf):
    rest, live = _feeds(spark, sf)
    return rc.merge_trades(rest, live, S).select(*S, "id", "feed")


@query("merge_streams", cte(LOG, FEEDS) + f"SELECT {L}, feed AS stream FROM feeds")
def _j5(spark, sf):
    rest, live = _feeds(spark, sf)
    return rc.union_tagged({"rest": rest, "ws": live}).select(*OUT, "stream")


@query("gap_backfill", cte(LOG) + """
, mark AS (SELECT platform, symbol, min(id) AS last FROM log WHERE event_type = 'error' GROUP BY 1, 2),
live AS (SELECT * FROM log LEFT JOIN mark USING (platform, symbol) WHERE event_type IN ('view', 'click')),
span AS (SELECT platform, symbol, max(id) AS top FROM live GROUP BY 1, 2)
SELECT l.platform, l.symbol, l.id, CASE WHEN event_type IN ('view', 'click') THEN 'live' ELSE 'stored' END AS origin
FROM log l JOIN span s ON s.platform = l.platform AND s.symbol = l.symbol LEFT JOIN mark m ON m.platform = l.platform AND m.symbol = l.symbol
WHERE id > coalesce(last, -1) AND id <= top""".replace("\n, mark", ", mark", 1))
def _j6(spark, sf):
    rows = log(spark, sf).select(*S, "id", "timestamp", "event_type")
    mark = rows.where("event_type = 'error'").groupBy(*S).agg(F.min("id").alias("id"))
    return rc.backfill(rows.where("event_type IN ('view', 'click')"), rows, S, mark).select(*S, "id", "origin")


HOLES = """
h AS (SELECT platform, symbol, lag(id) OVER (PARTITION BY platform, symbol ORDER BY id) AS prev, id FROM log),
cov AS (SELECT platform, symbol, max(id) // 2 AS last_id FROM log WHERE event_type = 'purchase' GROUP BY 1, 2),
holes AS (SELECT platform, symbol, greatest(prev + 1, coalesce(last_id + 1, prev + 1)) AS hole_start, id - 1 AS hole_end
          FROM h LEFT JOIN cov USING (platform, symbol) WHERE prev IS NOT NULL AND greatest(prev + 1, coalesce(last_id + 1, prev + 1)) <= id - 1)"""


def _holes(spark, sf):
    rows = log(spark, sf)
    covered = rows.where("event_type = 'purchase'").groupBy(*S).agg(F.expr("max(id) div 2").alias("last_id"))
    return rc.id_holes(rows, S, covered)


@query("find_id_holes", cte(LOG, HOLES) + "SELECT *, hole_end - hole_start + 1 AS size FROM holes")
def _j7(spark, sf):
    return _holes(spark, sf)


@query("plan_hole_requests", cte(LOG, HOLES) + """
SELECT platform, symbol, from_id, CAST(least(10, hole_end - from_id + 1) AS INTEGER) AS "limit"
FROM (SELECT *, unnest(generate_series(hole_start, hole_end, 10)) AS from_id FROM holes)""")
def _j8(spark, sf):
    return rc.hole_requests(_holes(spark, sf), limit=10)


@query("storage_ahead_check", cte(LOG) + """
SELECT platform, symbol, max(id) AS stored_id, max(id) FILTER (event_type = 'purchase') AS processed_id FROM log GROUP BY 1, 2
HAVING max(id) > coalesce(max(id) FILTER (event_type = 'purchase'), -1)""")
def _j11(spark, sf):
    rows = log(spark, sf)
    return rc.storage_ahead(rows, rows.where("event_type = 'purchase'"), S)


@query("last_processed_per_feed", cte(LOG, FEEDS) + """
SELECT platform, symbol, feed AS stream, max(id) AS last_processed_id, arg_max(timestamp, id) AS last_processed_timestamp FROM feeds GROUP BY 1, 2, 3""")
def _g42(spark, sf):
    rest, live = _feeds(spark, sf)
    return rc.last_per_feed(rc.union_tagged({"rest": rest, "ws": live}), [*S, "stream"])


@query("throughput_count", cte(LOG) + "SELECT platform, symbol, event_type, count(*) AS rows_out FROM log GROUP BY 1, 2, 3")
def _g43(spark, sf):
    return rc.throughput(log(spark, sf), [*S, "event_type"])


# Book messages as a sequence: update ids count the levels changed, snapshots name the last id before them, and updates
# of one priority class got lost on the way.

def sequence(spark: SparkSession, sf: str, lost: bool = True) -> DataFrame:
    from ticklattice.functions.scale import running

    o = table(spark, sf, "orders").select(F.col("o_orderkey"), "o_orderpriority")
    m = book_messages(spark, sf).withColumn("o_orderkey", F.col("id") % 1_000_000_000_000).join(o, "o_orderkey")
    n = F.when(F.col("type") == "snapshot", 0).otherwise(F.greatest(F.size("bids") + F.size("asks"), F.lit(1))).cast("long")
    m = m.withColumn("n", n).withColumn("_slice", F.floor(F.col("id") / BOOK_SLICE))
    m = running(m, S, ["id"], {"last_id": ("sum", F.col("n"))})
    m = m.select(*S, F.col("id").alias("arrival"), F.col("type").alias("kind"), "time_ms", "o_orderpriority",
                 F.when(F.col("type") == "snapshot", F.col("last_id")).otherwise(F.col("last_id") - F.col("n") + 1).alias("first_id"), "last_id")
    return m.where((F.col("kind") == "snapshot") | ~F.lit(lost) | (F.col("o_orderpriority") != "1-URGENT"))


SEQUENCE = """
numbered AS (SELECT b.*, o_orderpriority, CASE WHEN type = 'snapshot' THEN 0 ELSE greatest(len(bids) + len(asks), 1) END AS n
             FROM books b JOIN orders ON o_orderkey = b.id % 1000000000000),
sequenced AS (SELECT platform, symbol, id AS arrival, type AS kind, o_orderpriority, n, time_ms,
                     CAST(sum(n) OVER (PARTITION BY platform, symbol ORDER BY id) AS BIGINT) AS last_id FROM numbered),
sequence AS (SELECT *, CASE WHEN kind = 'snapshot' THEN last_id ELSE last_id - n + 1 END AS first_id,
                    CASE WHEN kind = 'snapshot' THEN 'S' WHEN o_orderpriority = '1-URGENT' THEN 'lost' ELSE 'U' END AS c FROM sequenced)"""

# Snapshots name exactly the position they were taken at, so an update gets through if nothing was lost since the last
# snapshot, or if the next message is a snapshot that ends where the update ends.
MERGED = """
marks AS (SELECT *, sum(CASE WHEN c = 'S' THEN 1 ELSE 0 END) OVER w AS snaps, sum(CASE WHEN c = 'lost' THEN 1 ELSE 0 END) OVER w AS losses
          FROM sequence WINDOW w AS (PARTITION BY platform, symbol ORDER BY arrival)),
since AS (SELECT *, losses - max(CASE WHEN c = 'S' THEN losses ELSE 0 END) OVER (PARTITION BY platform, symbol ORDER BY arrival) AS lost_since,
                 losses - coalesce(max(CASE WHEN c = 'S' THEN losses END) OVER (PARTITION BY platform, symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS lost_before,
                 lead(c) OVER (PARTITION BY platform, symbol ORDER BY arrival) AS next_c,
                 lead(arrival) OVER (PARTITION BY platform, symbol ORDER BY arrival) AS next_arrival FROM marks),
merged AS (SELECT platform, symbol, arrival, CASE WHEN c = 'S' THEN 'snapshot' ELSE 'update' END AS kind, first_id, last_id,
                  CASE WHEN c = 'U' AND NOT (snaps > 0 AND lost_since = 0) THEN next_arrival ELSE arrival END AS emitted_at
           FROM since WHERE (c = 'S' AND lost_before > 0 AND last_id > 0)
              OR (c = 'U' AND ((snaps > 0 AND lost_since = 0) OR next_c = 'S')))"""


@query("merge_snapshot_diff", cte(BOOKS, SEQUENCE, MERGED) + "SELECT * FROM merged")
def _j4(spark, sf):
    return rc.merge_snapshots_updates(sequence(spark, sf), S, slice_width=BOOK_SLICE)


@query("ws_sequence_break", cte(BOOKS, SEQUENCE) + """
SELECT platform, symbol, arrival, first_id, prev_last_id FROM (
  SELECT *, lag(last_id) OVER (PARTITION BY platform, symbol ORDER BY arrival) AS prev_last_id FROM sequence WHERE c = 'U') WHERE first_id <> prev_last_id + 1""")
def _st6(spark, sf):
    updates = sequence(spark, sf).where("kind = 'update'")
    return rc.sequence_breaks(updates, S, F.floor(F.col("arrival") / BOOK_SLICE)).select(*S, "arrival", "first_id", "prev_last_id")


@query("resume_point", cte(BOOKS, SEQUENCE) + """
SELECT platform, symbol, greatest(coalesce(max(last_id) FILTER (kind = 'snapshot'), -1), coalesce(max(last_id) FILTER (kind = 'update'), -1)) AS resume_at
FROM sequence WHERE c <> 'lost' GROUP BY 1, 2""")
def _j12(spark, sf):
    m = sequence(spark, sf)
    snaps, updates = m.where("kind = 'snapshot'"), m.where("kind = 'update'")
    state = m.groupBy(*S).agg(F.max(F.when(F.col("kind") == "snapshot", F.col("arrival"))).alias("snapshot_arrival"),
                              F.max(F.when(F.col("kind") == "update", F.col("arrival"))).alias("update_arrival"))
    return rc.resume_point(snaps, updates, state, S)


@query("merge_order", cte(BOOKS, SEQUENCE) + """
SELECT platform, symbol, arrival, row_number() OVER (PARTITION BY platform, symbol ORDER BY first_id, kind, -last_id, time_ms, arrival) - 1 AS position FROM sequence WHERE c <> 'lost'""")
def _t2(spark, sf):
    from ticklattice.functions.scale import dense_index

    m = sequence(spark, sf).withColumn("_slice", F.floor(F.col("first_id") / 1000)).withColumn("down", -F.col("last_id"))
    return dense_index(m, S, ["first_id", "kind", "down", "time_ms", "arrival"], out="position").select(*S, "arrival", "position")


@query("result_artifact_join", cte(LOG) + """
SELECT platform, symbol, id FROM log WHERE event_type <> 'purchase' AND user_id IN (SELECT DISTINCT user_id FROM log WHERE event_type = 'purchase')""")
def _j10(spark, sf):
    from ticklattice.operators.predict import with_artifacts

    rows = log(spark, sf).select(*S, "id", F.col("user_id").alias("result_id"), "event_type")
    artifacts = rows.where("event_type = 'purchase'").select("result_id").distinct()
    return with_artifacts(rows.where("event_type <> 'purchase'"), artifacts).select(*S, "id")
