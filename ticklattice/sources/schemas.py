"""Declared schemas of every stored table and exchange message. Nothing is inferred from data.

Prices and sizes that arrive as JSON numbers are read as strings, so no digit passes through a double.
"""

from __future__ import annotations

RAW_LOG = "platform STRING, source STRING, symbol STRING, id LONG, timestamp LONG, payload STRING"

TRADES = (
    "platform STRING, symbol STRING, platform_trade_id LONG, time_ms LONG, price STRING, quantity STRING, "
    "side INT, order_type INT, misc STRING"
)
_LEVELS = "ARRAY<STRUCT<price: STRING, qty: STRING>>"
ORDER_BOOKS = f"platform STRING, symbol STRING, id LONG, type STRING, time_ms LONG, bids {_LEVELS}, asks {_LEVELS}"

_PAIRS = "ARRAY<ARRAY<STRING>>"

# Two Binance streams use field names that differ only in case (t and T, e and E), which Spark's struct fields do not
# tell apart, so their data is read as a map and typed by name.
BINANCE_WS_TRADE = "stream STRING, data MAP<STRING, STRING>"
BINANCE_WS_TRADE_TYPES = {
    "e": "string", "E": "bigint", "s": "string", "t": "bigint", "p": "string", "q": "string", "T": "bigint",
    "m": "boolean", "M": "boolean",
}
BINANCE_WS_DIFF = "stream STRING, data MAP<STRING, STRING>"
BINANCE_WS_DIFF_TYPES = {
    "e": "string", "E": "bigint", "s": "string", "U": "bigint", "u": "bigint", "b": _PAIRS, "a": _PAIRS,
}
BINANCE_WS_PARTIAL = f"stream STRING, data STRUCT<lastUpdateId: LONG, bids: {_PAIRS}, asks: {_PAIRS}>"
BINANCE_REST_TRADES = (
    "request STRUCT<query: STRUCT<symbol: STRING, fromId: LONG, limit: INT>>, "
    "response ARRAY<STRUCT<id: LONG, price: STRING, qty: STRING, quoteQty: STRING, time: LONG, "
    "isBuyerMaker: BOOLEAN, isBestMatch: BOOLEAN>>"
)
BINANCE_REST_DEPTH = (
    "request STRUCT<query: STRUCT<symbol: STRING, limit: INT>>, "
    f"response STRUCT<lastUpdateId: LONG, bids: {_PAIRS}, asks: {_PAIRS}>"
)
BINANCE_BOOK_TICKER = "symbol STRING, bidPrice STRING, bidQty STRING, askPrice STRING, askQty STRING"
BINANCE_EXCHANGE_INFO = (
    "symbols ARRAY<STRUCT<symbol: STRING, status: STRING, baseAsset: STRING, quoteAsset: STRING>>"
)
BINANCE_ACK = "result STRING, error STRUCT<code: LONG, msg: STRING>, id LONG"

KRAKEN_WS_TRADE = (
    "channel STRING, type STRING, data ARRAY<STRUCT<symbol: STRING, side: STRING, price: STRING, qty: STRING, "
    "ord_type: STRING, trade_id: LONG, timestamp: STRING>>"
)
KRAKEN_WS_BOOK = (
    f"channel STRING, type STRING, data ARRAY<STRUCT<symbol: STRING, bids: {_LEVELS}, asks: {_LEVELS}, "
    "checksum: LONG, timestamp: STRING>>"
)
_ORDERS = "ARRAY<STRUCT<order_id: STRING, limit_price: STRING, order_qty: STRING, timestamp: STRING>>"
KRAKEN_WS_LEVEL3 = (
    f"channel STRING, type STRING, data ARRAY<STRUCT<symbol: STRING, bids: {_ORDERS}, asks: {_ORDERS}, "
    "checksum: LONG, timestamp: STRING>>"
)
KRAKEN_WS_TICKER = (
    "channel STRING, type STRING, data ARRAY<STRUCT<symbol: STRING, ask: DOUBLE, ask_qty: DOUBLE, bid: DOUBLE, "
    "bid_qty: DOUBLE, change: DOUBLE, change_pct: DOUBLE, high: DOUBLE, last: DOUBLE, low: DOUBLE, volume: DOUBLE, "
    "vwap: DOUBLE>>"
)
KRAKEN_WS_ACK = (
    "method STRING, result STRUCT<channel: STRING, snapshot: BOOLEAN, symbol: STRING>, error STRING, "
    "success BOOLEAN, time_in STRING, time_out STRING"
)
KRAKEN_WS_CHANNEL = "channel STRING, type STRING, data STRING"
KRAKEN_REST_TRADES_RESULT = "MAP<STRING, STRING>"  # pair -> array of 7-tuples, and 'last' -> cursor
KRAKEN_REST_DEPTH_RESULT = f"MAP<STRING, STRUCT<asks: {_PAIRS}, bids: {_PAIRS}>>"
KRAKEN_ASSET_PAIRS = "MAP<STRING, STRUCT<altname: STRING, wsname: STRING, base: STRING, quote: STRING>>"
KRAKEN_ASSETS = "MAP<STRING, STRUCT<aclass: STRING, altname: STRING, decimals: INT>>"
