"""Exchange tickers to ``base_quote`` symbols and back, by joins with the exchanges' own tables.

The dimension tables are joined without a hint: Spark broadcasts them while they are below its size threshold and
shuffles otherwise. Rows that match nothing get a null symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklattice.functions.text import stored_pair

# Exchange asset codes and their common names, in the order the first match wins when inverted.
KRAKEN_CODES = {
    "XETC": "ETC", "XETH": "ETH", "XLTC": "LTC", "XMLN": "MLN", "XREP": "REP", "XXLM": "XLM", "XXMR": "XMR",
    "XXRP": "XRP", "XZEC": "ZEC", "ZAUD": "AUD", "ZCAD": "CAD", "ZEUR": "EUR", "ZGBP": "GBP", "ZJPY": "JPY",
    "ZUSD": "USD", "XXBT": "BTC", "XXDG": "DOGE", "XBT": "BTC", "XDG": "DOGE",
}


def _lookup(pairs: dict[str, str], c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def common_code(c: Column) -> Column:
    """Kraken's asset code as the common one; an unknown code stays."""
    return _lookup(KRAKEN_CODES, c)


def kraken_code(c: Column) -> Column:
    """The common asset code as Kraken's; of several the first listed."""
    inverse: dict[str, str] = {}
    for code, name in KRAKEN_CODES.items():
        inverse.setdefault(name, code)
    return _lookup(inverse, c)


def from_binance(df: DataFrame, ticker: str, exchange_info: DataFrame, out: str = "symbol") -> DataFrame:
    """Add the stored symbol of a Binance ticker. ``exchange_info`` has ``symbol, baseAsset, quoteAsset``."""
    dim = exchange_info.groupBy(F.lower("symbol").alias("_t")).agg(F.min_by(F.struct("baseAsset", "quoteAsset"), "symbol").alias("_p"))
    return (
        df.withColumn("_t", F.lower(ticker)).join(dim, "_t", "left")
        .withColumn(out, F.when(F.col("_p").isNotNull(), stored_pair(F.col("_p.baseAsset"), F.col("_p.quoteAsset"))))
        .drop("_t", "_p")
    )


def from_kraken(df: DataFrame, ticker: str, asset_pairs: DataFrame, out: str = "symbol") -> DataFrame:
    """Add the stored symbol of a Kraken ticker, which is ``BASE/QUOTE`` or an alternative name.

    ``asset_pairs`` has ``altname, wsname``; the codes on both sides go through the code table.
    """
    dim = asset_pairs.groupBy(F.lower("altname").alias("_t")).agg(F.min_by("wsname", "altname").alias("_ws"))
    slashed = F.size(F.split(ticker, "/")) >= 2
    joined = df.withColumn("_t", F.when(~slashed, F.lower(ticker))).join(dim, "_t", "left")
    parts = F.split(F.when(slashed, F.col(ticker)).otherwise(F.col("_ws")), "/")
    return joined.withColumn(
        out, F.when(parts.isNotNull(), stored_pair(common_code(F.get(parts, 0)), common_code(F.get(parts, 1))))
    ).drop("_t", "_ws")


def to_binance(df: DataFrame, symbol: str, exchange_info: DataFrame, out: str = "ticker") -> DataFrame:
    """Add the Binance ticker of a stored symbol, null if the exchange does not list it."""
    dim = exchange_info.select(F.upper("symbol").alias("_t")).distinct().withColumn("_known", F.lit(True))
    return (
        df.withColumn("_t", F.upper(F.concat_ws("", F.split(symbol, "_")))).join(dim, "_t", "left")
        .withColumn(out, F.when(F.col("_known"), F.col("_t"))).drop("_t", "_known")
    )


def to_kraken(df: DataFrame, symbol: str, asset_pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """Add ``ws_symbol`` (``BASE/QUOTE``) and ``altname`` of a stored symbol.

    Both assets must be listed in ``assets`` (column ``asset``) and the pair in ``asset_pairs`` (``base, quote,
    altname``), else the two are null.
    """
    parts = F.split(F.upper(symbol), "_")
    coded = df.withColumn("_b", kraken_code(F.get(parts, 0))).withColumn("_q", kraken_code(F.get(parts, 1)))
    names = assets.select(F.col("asset").alias("_a")).distinct()
    pairs = (
        asset_pairs.groupBy(F.col("base").alias("_b"), F.col("quote").alias("_q")).agg(F.min("altname").alias("_alt"))
        .join(names.withColumnRenamed("_a", "_b"), "_b", "left_semi")
        .join(names.withColumnRenamed("_a", "_q"), "_q", "left_semi")
    )
    found = coded.join(pairs, ["_b", "_q"], "left")
    return found.select(
        *[F.col(c) for c in df.columns],
        F.when(F.col("_alt").isNotNull(), F.concat_ws("/", common_code(F.col("_b")), common_code(F.col("_q")))).alias("ws_symbol"),
        F.col("_alt").alias("altname"),
    )
