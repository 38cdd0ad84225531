"""Market-data views over the given tables, for Spark and (as common table expressions) for the SQL checks.

``events`` act as trades and metric samples; ``orders`` with ``lineitem`` act as order-book messages, their order dates
squeezed onto the month the events cover so both sides share windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.functions.scale import spread

WINDOW_MS = 7_200_000
T0_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z
DAY_STEP_MS = 1_070_000  # one order date on the squeezed clock
BOOK_SLICE = 10**12  # message ids of one order date
RECEIPT_MS = 2_400_000  # snapshots are stamped on receipt, up to so much later than the updates around them
LEVELS = "array<struct<price:decimal(38,18),qty:decimal(38,18)>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp, rounded down."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def platform_of(n: Column) -> Column:
    return F.when(n % 3 == 0, F.lit("kraken")).otherwise(F.lit("binance"))


def symbol_of(n: Column) -> Column:
    return F.concat(F.lit("s"), (n % 4).cast("string"), F.lit("_usdt"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from_events(table(spark, sf_dir, "events"))


def trades_from_events(events: DataFrame) -> DataFrame:
    """Events as unified trades: price and quantity are decimal strings, as exchanges send them."""
    return events.select(
        platform_of(F.col("event_id")).alias("platform"),
        symbol_of(F.col("user_id")).alias("symbol"),
        F.col("event_id").alias("platform_trade_id"),
        millis(F.col("ts")).alias("time_ms"),
        F.col("value").cast("string").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") / 10).cast("string").alias("quantity"),
        F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1).alias("side"),
        (F.col("user_id") % 2).cast("int").alias("order_type"),
    )


TRADES = """
trades AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'kraken' ELSE 'binance' END AS platform,
         's' || (user_id % 4) || '_usdt' AS symbol,
         event_id AS platform_trade_id,
         epoch_us(ts) // 1000 AS time_ms,
         CAST(value AS VARCHAR) AS price_s,
         CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS VARCHAR) AS quantity_s,
         value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS quantity,
         CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS side,
         CAST(user_id % 2 AS INTEGER) AS order_type
  FROM events)"""


def book_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as book messages: each order's lines are its levels, every 64th order key is a full snapshot."""
    price = F.col("l_partkey") % 50
    is_bid = F.col("l_linestatus") == "O"
    qty = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))
    levels = (
        # one exchange serves both groupings and the join
        spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linestatus", "l_returnflag"), "l_orderkey")
        .groupBy(
            F.col("l_orderkey").alias("o_orderkey"),
            is_bid.alias("is_bid"),
            F.when(is_bid, price + 100).otherwise(price + 150).cast("decimal(38,18)").alias("price"),
        )
        .agg(F.sum(qty).cast("decimal(38,18)").alias("qty"))
        .groupBy("o_orderkey")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("is_bid"), F.struct("price", "qty")))).alias("bids"),
            F.sort_array(F.collect_list(F.when(~F.col("is_bid"), F.struct("price", "qty")))).alias("asks"),
        )
    )
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return (
        table(spark, sf_dir, "orders")
        .join(levels, "o_orderkey", "left")
        .select(
            F.when(F.col("o_orderstatus") == "P", "kraken").otherwise("binance").alias("platform"),
            symbol_of(F.col("o_custkey")).alias("symbol"),
            (day * 1_000_000_000_000 + F.col("o_orderkey")).alias("id"),
            F.when(F.col("o_orderkey") % 64 == 0, "snapshot").otherwise("update").alias("type"),
            (T0_MS + day * DAY_STEP_MS + F.least(F.col("o_orderkey"), F.lit(DAY_STEP_MS - 1))
             + F.when(F.col("o_orderkey") % 64 == 0, F.col("o_orderkey") * 7919 % RECEIPT_MS).otherwise(0)).alias("time_ms"),
            F.coalesce("bids", F.array().cast(LEVELS)).alias("bids"),
            F.coalesce("asks", F.array().cast(LEVELS)).alias("asks"),
        )
    )


# Each message keeps its levels as sorted lists of {price, qty}.
BOOKS = f"""
levels AS (
  SELECT l_orderkey AS o_orderkey, l_linestatus = 'O' AS is_bid,
         CAST(l_partkey % 50 + CASE WHEN l_linestatus = 'O' THEN 100 ELSE 150 END AS DOUBLE) AS price,
         SUM(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END) AS qty
  FROM lineitem GROUP BY 1, 2, 3),
books AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'kraken' ELSE 'binance' END AS platform,
         's' || (o_custkey % 4) || '_usdt' AS symbol,
         date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1000000000000 + o_orderkey AS id,
         CASE WHEN o_orderkey % 64 = 0 THEN 'snapshot' ELSE 'update' END AS type,
         {T0_MS} + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * {DAY_STEP_MS}
           + least(o_orderkey, {DAY_STEP_MS - 1}) + CASE WHEN o_orderkey % 64 = 0 THEN o_orderkey * 7919 % {RECEIPT_MS} ELSE 0 END AS time_ms,
         coalesce(l.bids, []) AS bids, coalesce(l.asks, []) AS asks
  FROM orders LEFT JOIN (
    SELECT o_orderkey,
           coalesce(list({{'price': price, 'qty': qty}} ORDER BY price) FILTER (is_bid), []) AS bids,
           coalesce(list({{'price': price, 'qty': qty}} ORDER BY price) FILTER (NOT is_bid), []) AS asks
    FROM levels GROUP BY 1) l USING (o_orderkey))"""


def cte(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"
