"""Raw exchange messages (JSON text) to unified trades and order books, with routing and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.functions.text import number_text
from ticklattice.sources import schemas as sc

TRADE_COLUMNS = ["platform", "symbol", "platform_trade_id", "time_ms", "price", "quantity", "side", "order_type", "misc"]
BOOK_COLUMNS = ["platform", "symbol", "id", "type", "time_ms", "bids", "asks"]


def _int(flag: Column) -> Column:
    return F.when(flag, 1).otherwise(0)


def _no_misc() -> Column:
    return F.lit(None).cast("string").alias("misc")


def _pairs(c: Column) -> Column:
    return F.transform(c, lambda x: F.struct(F.get(x, 0).alias("price"), F.get(x, 1).alias("qty")))


def _number_levels(c: Column) -> Column:
    return F.transform(c, lambda x: F.struct(number_text(x["price"]).alias("price"), number_text(x["qty"]).alias("qty")))


def typed(data: Column, types: dict[str, str]) -> dict[str, Column]:
    """The entries of a map of texts by name, each as its type; null where absent or of another type."""
    out = {}
    for name, kind in types.items():
        raw = F.try_element_at(data, F.lit(name))
        out[name] = F.from_json(raw, kind) if kind.startswith("ARRAY") else raw.try_cast(kind)
    return out


def binance_ws_trades(log: DataFrame) -> DataFrame:
    """Trade stream messages in ``payload``; the buyer being the maker means a sell. The order type is not sent: 0."""
    d = typed(F.from_json("payload", sc.BINANCE_WS_TRADE)["data"], sc.BINANCE_WS_TRADE_TYPES)
    return log.select(
        F.lit("binance").alias("platform"), "symbol", d["t"].alias("platform_trade_id"), d["T"].alias("time_ms"),
        d["p"].alias("price"), d["q"].alias("quantity"), _int(d["m"]).alias("side"), F.lit(0).alias("order_type"), _no_misc(),
    )


def binance_rest_trades(log: DataFrame) -> DataFrame:
    """Historical trade responses: one row per element of ``response``."""
    p = F.from_json("payload", sc.BINANCE_REST_TRADES)
    return log.select("symbol", F.explode(p["response"]).alias("t")).select(
        F.lit("binance").alias("platform"), "symbol", F.col("t.id").alias("platform_trade_id"),
        F.col("t.time").alias("time_ms"), F.col("t.price").alias("price"), F.col("t.qty").alias("quantity"),
        _int(F.col("t.isBuyerMaker")).alias("side"), F.lit(0).alias("order_type"), _no_misc(),
    )


def kraken_ws_trades(log: DataFrame) -> DataFrame:
    """Trade channel messages: one row per element of ``data``; times are ISO text."""
    p = F.from_json("payload", sc.KRAKEN_WS_TRADE)
    return log.select("symbol", F.explode(p["data"]).alias("t")).select(
        F.lit("kraken").alias("platform"), "symbol", F.col("t.trade_id").alias("platform_trade_id"),
        F.unix_millis(F.to_timestamp("t.timestamp")).alias("time_ms"),
        number_text(F.col("t.price")).alias("price"), number_text(F.col("t.qty")).alias("quantity"),
        _int(F.col("t.side") == "sell").alias("side"), _int(F.col("t.ord_type") == "limit").alias("order_type"), _no_misc(),
    )


def kraken_rest_trades(log: DataFrame) -> DataFrame:
    """Recent trade responses: a map of pair to 7-tuples beside the cursor ``last``. More than two keys is an error."""
    result = F.from_json(F.get_json_object("payload", "$.response.result"), sc.KRAKEN_REST_TRADES_RESULT)
    checked = F.when(
        F.size(F.map_keys(result)) > 2, F.raise_error(F.concat(F.lit("too many keys in trades result: "), F.to_json(result)))
    ).otherwise(F.map_filter(result, lambda k, _: k != "last"))
    rows = (
        log.select("symbol", F.explode(checked).alias("pair", "body"))
        .select("symbol", F.explode(F.from_json("body", "ARRAY<ARRAY<STRING>>")).alias("t"))
    )
    at = lambda i: F.get(F.col("t"), i)
    return rows.select(
        F.lit("kraken").alias("platform"), "symbol", at(6).cast("long").alias("platform_trade_id"),
        F.floor(at(2).cast("double") * 1000).cast("long").alias("time_ms"), at(0).alias("price"), at(1).alias("quantity"),
        _int(at(3) == "s").alias("side"), _int(at(4) == "l").alias("order_type"), at(5).alias("misc"),
    )


def binance_snapshots(log: DataFrame) -> DataFrame:
    """Depth responses as book snapshots, stamped with the time of receipt. A record without symbol is an error."""
    p = F.from_json("payload", sc.BINANCE_REST_DEPTH)
    asked = F.coalesce(p["request"]["query"]["symbol"], F.lit(""))
    kind = F.when(asked == "", F.raise_error(F.lit("a depth record needs the requested symbol"))).otherwise("snapshot")
    return log.select(
        F.lit("binance").alias("platform"), "symbol", "id", kind.cast("string").alias("type"), F.col("timestamp").alias("time_ms"),
        _pairs(p["response"]["bids"]).alias("bids"), _pairs(p["response"]["asks"]).alias("asks"),
    )


def binance_diffs(log: DataFrame) -> DataFrame:
    """Depth update messages, stamped with their event time."""
    d = typed(F.from_json("payload", sc.BINANCE_WS_DIFF)["data"], sc.BINANCE_WS_DIFF_TYPES)
    return log.select(
        F.lit("binance").alias("platform"), "symbol", "id", F.lit("update").alias("type"), d["E"].alias("time_ms"),
        _pairs(d["b"]).alias("bids"), _pairs(d["a"]).alias("asks"),
    )


def kraken_books(log: DataFrame) -> DataFrame:
    """Book channel messages: one row per element of ``data``; event time where sent, else time of receipt."""
    p = F.from_json("payload", sc.KRAKEN_WS_BOOK)
    rows = log.select("symbol", "id", "timestamp", p["type"].alias("kind"), F.explode(p["data"]).alias("d"))
    return rows.select(
        F.lit("kraken").alias("platform"), "symbol", "id",
        F.when(F.col("kind") == "snapshot", "snapshot").otherwise("update").alias("type"),
        F.coalesce(F.unix_millis(F.to_timestamp("d.timestamp")), F.col("timestamp")).alias("time_ms"),
        _number_levels(F.col("d.bids")).alias("bids"), _number_levels(F.col("d.asks")).alias("asks"),
    )


# --- routing and validation -----------------------------------------------------------------------------------------

def stream_type(payload: Column, exchange: str) -> Column:
    """The first stream whose mark the message carries; null if none does."""
    at = lambda path: F.get_json_object(payload, path)
    if exchange == "binance":
        return (
            F.when(at("$.data.e") == "trade", "trade")
            .when(at("$.data.e") == "depthUpdate", "diff_depth")
            .when(
                at("$.stream").contains("@depth") & (F.coalesce(at("$.data.lastUpdateId"), F.lit("0")) != "0")
                & at("$.data.bids").isNotNull() & at("$.data.asks").isNotNull(), "partial_depth")
            .when(F.coalesce(at("$.id"), F.lit("0")) != "0", "ack")
        )
    channel = at("$.channel")
    known = channel.isin("trade", "book", "level3", "ticker", "heartbeat", "status")
    ack = at("$.method").isin("subscribe", "unsubscribe") & at("$.success").isNotNull()
    return F.when(known, channel).when(ack, "ack")


# What each stream must hold to be valid: its schema and the fields that may not be missing.
_CHECKS: dict[tuple[str, str], tuple[str, list[str]]] = {
    ("binance", "trade"): (sc.BINANCE_WS_TRADE, ["stream", "data"]),
    ("binance", "diff_depth"): (sc.BINANCE_WS_DIFF, ["stream", "data"]),
    ("binance", "partial_depth"): (sc.BINANCE_WS_PARTIAL, ["stream", "data.lastUpdateId", "data.bids", "data.asks"]),
    ("binance", "ack"): (sc.BINANCE_ACK, ["id"]),
    ("kraken", "trade"): (sc.KRAKEN_WS_TRADE, ["channel", "type", "data"]),
    ("kraken", "book"): (sc.KRAKEN_WS_BOOK, ["channel", "type", "data"]),
    ("kraken", "level3"): (sc.KRAKEN_WS_LEVEL3, ["channel", "type", "data"]),
    ("kraken", "ticker"): (sc.KRAKEN_WS_TICKER, ["channel", "type", "data"]),
    ("kraken", "ack"): (sc.KRAKEN_WS_ACK, ["method", "success"]),
    ("kraken", "heartbeat"): (sc.KRAKEN_WS_CHANNEL, ["channel"]),
    ("kraken", "status"): (sc.KRAKEN_WS_CHANNEL, ["channel", "type", "data"]),
}
_MAP_TYPES = {"trade": sc.BINANCE_WS_TRADE_TYPES, "diff_depth": sc.BINANCE_WS_DIFF_TYPES}
_ITEM_FIELDS = {
    "trade": ["symbol", "side", "price", "qty", "ord_type", "trade_id", "timestamp"],
    "book": ["symbol", "bids", "asks", "checksum"],
    "level3": ["symbol", "bids", "asks", "checksum", "timestamp"],
    "ticker": ["symbol", "ask", "ask_qty", "bid", "bid_qty", "change", "change_pct", "high", "last", "low", "volume", "vwap"],
}


def _lacks(fields: list[str]):
    return lambda item: F.greatest(*[item[f].isNull().cast("int") for f in fields]) == 1


def with_errors(log: DataFrame, exchange: str) -> DataFrame:
    """Add ``stream_type`` and ``error``: why a message is not valid, null if it is.

    A message may not be JSON, be of no known stream, have a field of a wrong type or lack one. Each message is routed
    once and then parsed once, by the schema of its stream.
    """
    kind, checks = F.col("stream_type"), {s: c for (e, s), c in _CHECKS.items() if e == exchange}
    routed = log.withColumn("stream_type", stream_type(F.col("payload"), exchange))
    parsed = routed.select("*", *[
        F.when(kind == s, F.from_json("payload", schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})).alias(f"_b_{s}")
        for s, (schema, _) in checks.items()
    ])
    error = F.when(kind.isNull(), F.when(F.try_parse_json("payload").isNull(), "not json").otherwise("unknown stream"))
    for stream, (_, required) in checks.items():
        body = F.col(f"_b_{stream}")
        wrong, gaps = body["_bad"].isNotNull(), F.lit(False)
        for path in required:
            field = body
            for step in path.split("."):
                field = field[step]
            gaps = gaps | field.isNull()
        if exchange == "binance" and stream in _MAP_TYPES:
            for name, value in typed(body["data"], _MAP_TYPES[stream]).items():
                raw = F.try_element_at(body["data"], F.lit(name))
                gaps, wrong = gaps | raw.isNull(), wrong | (raw.isNotNull() & value.isNull())
        if exchange == "kraken" and stream in _ITEM_FIELDS:
            gaps = gaps | F.exists(body["data"], _lacks(_ITEM_FIELDS[stream]))
        error = error.when((kind == stream) & wrong, "wrong type").when((kind == stream) & gaps, "missing field")
    return parsed.select(*log.columns, "stream_type", error.alias("error"))


def validate(log: DataFrame, exchange: str) -> tuple[DataFrame, DataFrame]:
    """Good messages with their ``stream_type``, and the quarantine with its ``error``."""
    checked = with_errors(log, exchange)
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull())


def split_by_symbol(messages: DataFrame) -> DataFrame:
    """A message with items of several symbols as one message per symbol, items in their order.

    ``messages`` has ``id`` and ``data``, an array of structs with a ``symbol``.
    """
    items = messages.select("id", F.posexplode("data").alias("pos", "item"))
    return items.groupBy("id", F.col("item.symbol").alias("symbol")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("data"))


def group_in_order(df: DataFrame, key: str, position: str, value: str, out: str = "values") -> DataFrame:
    """The values of each key as a list in order of position, for keys that hold few rows each."""
    return df.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col(value).alias("value")))), lambda x: x["value"]).alias(out))


def skip_processed(log: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond each key's ``last_processed_id``; keys without state keep all."""
    joined = log.join(state.select(*keys, "last_processed_id"), keys, "left")
    return joined.where(F.col("id") > F.coalesce("last_processed_id", F.lit(-1))).drop("last_processed_id")


def filter_windows(windows: DataFrame, platform: str, symbol: str, window_size_ms: int) -> DataFrame:
    """The windows of one platform, symbol and size in time order."""
    return windows.where(
        (F.col("platform") == platform) & (F.col("symbol") == symbol) & (F.col("window_size_ms") == window_size_ms)
    ).orderBy("window_end_ms")
