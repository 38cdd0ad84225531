"""Order-book state from snapshots and updates, the tick table after every message, and window features over ticks."""

from __future__ import annotations

from bisect import bisect_left, insort
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.functions.scale import lag_one, running, spread
from ticklattice.operators.fold import ordered_fold
from ticklattice.operators.trade_windows import window_start

KEYS = ["platform", "symbol", "window_size_ms"]
BOOK_KEYS = ["platform", "symbol"]
LEVELS = "array<struct<price:decimal(38,18),qty:decimal(38,18)>>"
TICK_SCHEMA = (
    "platform string, symbol string, id long, time_ms long, bb double, ba double, bq0 double, aq0 double, "
    "tot_b double, tot_a double, notional_b double, notional_a double, depth_b int, depth_a int"
)
SLICE_IDS = 65_536  # width in ids of the slices a key is cut into; messages are in order of id, whatever their times
EPOCHS = 64  # epochs folded by one group

ORDER_FEATURES = [
    "sw", "sw_mid", "sw_micro", "spread_min", "spread_max", "sw_spread", "n_w", "mean_mid", "M2_mid",
    "sw_bid", "sw_ask", "sw_imb", "sw_bid_best_sz", "sw_ask_best_sz",
    "n_updates", "n_mid_up", "n_mid_down", "n_spread_widen", "n_spread_tighten", "t_first", "t_last",
    "close_mid", "close_spread", "close_bb", "close_ba", "close_bq0", "close_aq0", "close_best_imb",
]


class Ladder:
    """One side of a book: sizes by price in ascending order and running totals.

    Prices are positions in ``prices``, the sorted exact prices of the chunk, so they compare and hash as small integers.
    """

    def __init__(self, best_is_high: bool, prices: list[Decimal], levels=(), depth: int = 0):
        self.best_is_high, self.prices, self.depth = best_is_high, prices, depth
        self.load(levels)

    def load(self, levels) -> None:
        self.sizes = {p: q for p, q in levels if q != 0}
        self.ladder = sorted(self.sizes)
        self.qty = sum(self.sizes.values(), Decimal(0))
        self.notional = sum((self.prices[p] * q for p, q in self.sizes.items()), Decimal(0))

    def change(self, price: int, size: Decimal) -> None:
        before = self.sizes.pop(price, None)
        if before is not None and size == 0:
            del self.ladder[bisect_left(self.ladder, price)]
        elif before is None and size != 0:
            insort(self.ladder, price)
        if size != 0:
            self.sizes[price] = size
        moved = size - (before or 0)
        self.qty += moved
        self.notional += self.prices[price] * moved

    def trim(self) -> None:
        """Drop the worst prices beyond the snapshot's depth; a side that began empty has no limit."""
        while self.depth and len(self.ladder) > self.depth:
            self.change(self.ladder[0 if self.best_is_high else -1], Decimal(0))

    def top(self) -> tuple:
        """Best price and size, total size, notional and number of levels."""
        totals = float(self.qty), float(self.notional), len(self.ladder)
        if not self.ladder:
            return None, 0.0, *totals
        best = self.ladder[-1 if self.best_is_high else 0]
        return float(self.prices[best]), float(self.sizes[best]), *totals

    def save(self) -> list:
        return [[str(self.prices[p]), str(q)] for p, q in self.sizes.items()]


class BookFold:
    """The fold for ``ordered_fold``: applies messages in order and puts out one tick per message with a book.

    With ``window_ms`` a message whose window is older than that of an earlier message with a book is ignored.
    """

    def __init__(self, limit_depth: bool = True, window_ms: int | None = None):
        self.limit_depth, self.window_ms = limit_depth, window_ms

    def __call__(self, state: dict | None, table: pa.Table):
        saved = [(state or {}).get(k) or [] for k in ("bids", "asks")]
        flat = [_flat(table.column(k)) for k in ("bids", "asks")]
        held = [pa.array([Decimal(p) for p, _ in s], pa.decimal128(38, 18)) for s in saved]
        prices, codes = _sorted_codes([f[1] for f in flat] + held)
        books = []
        for k in (0, 1):
            levels = zip(codes[2 + k], [Decimal(q) for _, q in saved[k]], strict=True)
            depth = state["depths"][k] if state else 0
            books.append((Ladder(k == 0, prices, levels, depth), flat[k][0], codes[k], flat[k][2]))
        live, seen = bool(state and state["live"]), state["seen"] if state else None
        ticks: list[tuple] = []
        times = table.column("time_ms").to_pylist() if self.window_ms else None
        for i, kind in enumerate(table.column("type").to_pylist()):
            if times and (live or kind == "snapshot"):
                window = times[i] // self.window_ms
                if seen is not None and window < seen:
                    continue
                seen = window
            if kind == "snapshot":
                for side, at, price, size in books:
                    side.load(list(zip(price[at[i]:at[i + 1]], size[at[i]:at[i + 1]], strict=True)))
                    side.depth = len(side.ladder) if self.limit_depth else 0
                live = True
            elif live:
                for side, at, price, size in books:
                    for j in range(at[i], at[i + 1]):
                        side.change(price[j], size[j])
                    side.trim()
            if live:
                ticks.append((i, *books[0][0].top(), *books[1][0].top()))
        bids, asks = books[0][0], books[1][0]
        after = {"bids": bids.save(), "asks": asks.save(), "depths": [bids.depth, asks.depth], "live": live, "seen": seen}
        return _tick_table(table, ticks), after


def _flat(column) -> tuple[list[int], pa.Array, list[Decimal]]:
    """A list column as offsets, all prices and all sizes; a null list counts as empty."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = [0, *pc.cumulative_sum(pc.fill_null(lists.value_lengths(), 0)).to_pylist()]
    values = lists.flatten()
    return offsets, values.field("price"), values.field("qty").to_pylist()


def _sorted_codes(arrays: list[pa.Array]) -> tuple[list[Decimal], list[list[int]]]:
    """The distinct prices in order, and each array as positions among them."""
    encoded = pa.concat_arrays(arrays).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[encoded.indices.to_numpy(zero_copy_only=False)] if len(order) else np.empty(0, dtype=np.int64)
    cuts = np.cumsum([len(a) for a in arrays])[:-1]
    return encoded.dictionary.take(pa.array(order)).to_pylist(), [c.tolist() for c in np.split(codes, cuts)]


def _tick_table(table: pa.Table, ticks: list[tuple]) -> pa.Table:
    cols = list(zip(*ticks, strict=True)) if ticks else [()] * 11
    at = table.select(["platform", "symbol", "id", "time_ms"]).take(pa.array(cols[0], pa.int64()))
    f64, i32 = pa.float64(), pa.int32()
    extra = {
        "bb": (cols[1], f64), "ba": (cols[6], f64), "bq0": (cols[2], f64), "aq0": (cols[7], f64),
        "tot_b": (cols[3], f64), "tot_a": (cols[8], f64), "notional_b": (cols[4], f64), "notional_a": (cols[9], f64),
        "depth_b": (cols[5], i32), "depth_a": (cols[10], i32),
    }
    for name, (values, kind) in extra.items():
        at = at.append_column(name, pa.array(values, kind))
    return at


def decimal_levels(c: Column) -> Column:
    """Levels with exact decimal prices and sizes from levels with text."""
    exact = lambda x: x.cast("decimal(38,18)")
    return F.transform(c, lambda x: F.struct(exact(x["price"]).alias("price"), exact(x["qty"]).alias("qty")))


def _sliced(messages: DataFrame, slice_ids: int) -> DataFrame:
    return spread(messages.withColumn("_slice", F.floor(F.col("id") / slice_ids)), *BOOK_KEYS, "_slice")


def snapshot_epochs(messages: DataFrame, *, slice_ids: int = SLICE_IDS) -> DataFrame:
    """Number the stretches between snapshots in order of id: ``epoch`` is 0 before a key's first snapshot."""
    is_snap = F.when(F.col("type") == "snapshot", 1).otherwise(0).cast("long")
    return running(_sliced(messages, slice_ids), BOOK_KEYS, ["id"], {"epoch": ("sum", is_snap)}).drop("_slice")


def drop_late(messages: DataFrame, window_ms: int, *, slice_ids: int = SLICE_IDS) -> DataFrame:
    """Leave out messages whose window is older than that of an earlier message with a book."""
    first = messages.where(F.col("type") == "snapshot").groupBy(*BOOK_KEYS).agg(F.min("id").alias("_from"))
    # One id per key is sent to all tasks. A join by key alone would put every message of a key in one task, slices and all.
    live = messages.join(F.broadcast(first), BOOK_KEYS).where(F.col("id") >= F.col("_from")).drop("_from")
    windows = _sliced(live.withColumn("_win", window_start("time_ms", window_ms)), slice_ids)
    seen = running(windows, BOOK_KEYS, ["id"], {"_seen": ("max", F.col("_win"))}, exclusive=True)
    return seen.where(F.col("_seen").isNull() | (F.col("_win") >= F.col("_seen"))).select(*messages.columns)


def book_ticks(messages: DataFrame, *, limit_depth: bool = True, slice_ids: int = SLICE_IDS, epochs: int = EPOCHS) -> DataFrame:
    """The book after each message in order of id: best prices and sizes, totals, notional and number of levels per side.

    A snapshot replaces the book, an update sets levels (size 0 removes one), then each side is cut to the number of
    levels its snapshot had, worst prices first. Updates before the first snapshot are skipped. ``messages`` has
    ``platform, symbol, id, type, time_ms`` and decimal ``bids`` and ``asks``; times may go back and forth.

    As a snapshot starts the book anew, runs of ``epochs`` epochs are folded on their own. The ids of a slice, ``slice_ids`` wide,
    are numbered by one task. Neither changes the result.
    """
    rows = messages.select(*BOOK_KEYS, "id", "time_ms", "type", "bids", "asks")
    grouped = snapshot_epochs(rows, slice_ids=slice_ids).where("epoch > 0").withColumn("_group", F.floor(F.col("epoch") / epochs))
    return ordered_fold(grouped.drop("epoch"), [*BOOK_KEYS, "_group"], ["id"], BookFold(limit_depth), TICK_SCHEMA)


def with_prices(ticks: DataFrame) -> DataFrame:
    """Add mid, spread and size-weighted mid of each tick; null unless both sides are there and not crossed."""
    sane = F.col("bb").isNotNull() & F.col("ba").isNotNull() & (F.col("ba") >= F.col("bb"))
    best = F.col("bq0") + F.col("aq0")
    return ticks.withColumns({
        "mid": F.when(sane, (F.col("ba") + F.col("bb")) * 0.5),
        "spread": F.when(sane, F.col("ba") - F.col("bb")),
        "micro": F.when(sane & (best > 0), (F.col("ba") * F.col("bq0") + F.col("bb") * F.col("aq0")) / best),
    })


def order_windows(ticks: DataFrame, size_ms: int, *, close: str = "inside", slice_ids: int = SLICE_IDS) -> DataFrame:
    """One row per key and window with its order-book features.

    Each tick weighs the time since the previous tick of its window (since the window's start for the first), at least
    1. ``close='inside'`` takes the closing best prices from the last tick of the window, ``'next'`` from the first
    tick after it.

    Ticks are in order of id, whatever their times. A window is summed in two steps: per slice of ids, leaving out each
    slice's first tick, whose weight and changes need the slice before; then over the slices, where those first ticks are
    added. The ticks are read once and a busy window is shared by many tasks.
    """
    group = [*KEYS, "window_start_ms"]
    both = (F.col("tot_b") != 0) & (F.col("tot_a") != 0)
    weighed = {  # what each weighted sum adds per unit of weight; null adds nothing
        "sw": F.lit(1.0), "sw_mid": F.col("mid"), "sw_micro": F.col("micro"), "sw_spread": F.col("spread"),
        "n_w": F.when(F.col("mid").isNotNull(), 1.0), "sw_bid": F.when(both, F.col("tot_b")),
        "sw_ask": F.when(both, F.col("tot_a")),
        "sw_imb": F.when(both, F.try_divide(F.col("tot_b") - F.col("tot_a"), F.col("tot_b") + F.col("tot_a"))),
        "sw_bid_best_sz": F.col("bq0"), "sw_ask_best_sz": F.col("aq0"),
    }
    changes = {"n_mid_up": ("mid", 1), "n_mid_down": ("mid", -1), "n_spread_widen": ("spread", 1), "n_spread_tighten": ("spread", -1)}

    def weight(now: Column, before: Column) -> Column:
        return F.when(now > before, now - before).otherwise(1).cast("double")

    def moved(now: Column, before: Column, sign: int) -> Column:
        return F.coalesce(((now - before) * sign > 0).cast("long"), F.lit(0))

    in_slice = W.partitionBy(*group, "_slice").orderBy("id")
    rows = with_prices(ticks).withColumn("window_size_ms", F.lit(size_ms).cast("long")).withColumn(
        "window_start_ms", window_start("time_ms", size_ms)).withColumn("_slice", F.floor(F.col("id") / slice_ids))
    rows = spread(rows, *BOOK_KEYS, "window_start_ms", "_slice")
    # Mids are centred on one mid of their slice before squaring, so the variance does not cancel.
    rows = rows.select(
        "*", *[x.alias(f"x_{n}") for n, x in weighed.items()], F.min("mid").over(W.partitionBy(*group, "_slice")).alias("ref"),
        *[F.lag(c).over(in_slice).alias(f"prev_{c}") for c in ("time_ms", "mid", "spread")],
    ).withColumn("w", F.when(F.col("prev_time_ms").isNotNull(), weight(F.col("time_ms"), F.col("prev_time_ms"))))
    dev = F.col("mid") - F.col("ref")
    quote = F.struct("time_ms", "mid", "spread", "bb", "ba", "bq0", "aq0", *[f"x_{n}" for n in weighed])
    parts = rows.groupBy(*group, "_slice").agg(
        *[F.sum(F.col("w") * F.col(f"x_{n}")).alias(n) for n in weighed],
        F.sum(F.col("w") * dev).alias("d1"), F.sum(F.col("w") * dev * dev).alias("d2"), F.min("ref").alias("ref"),
        F.count("*").alias("n_updates"), F.min("spread").alias("spread_min"), F.max("spread").alias("spread_max"),
        *[F.sum(moved(F.col(c), F.col(f"prev_{c}"), sign)).alias(n) for n, (c, sign) in changes.items()],
        F.min_by(quote, "id").alias("head"), F.max_by(quote, "id").alias("tail"),
    )

    across = W.partitionBy(*group).orderBy("_slice")
    parts = parts.withColumn("back", F.lag("tail").over(across)).withColumn(
        "base", F.min("ref").over(W.partitionBy(*group))
    ).withColumn("since", F.coalesce(F.col("back.time_ms"), F.col("window_start_ms")))
    wf = weight(F.col("head.time_ms"), F.col("since"))
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    dev_f, shift = F.col("head.mid") - F.col("ref"), F.col("ref") - F.col("base")
    parts = parts.withColumns({
        **{n: or_zero(F.col(n)) + or_zero(wf * F.col(f"head.x_{n}")) for n in weighed},
        "d1": or_zero(F.col("d1")) + or_zero(wf * dev_f), "d2": or_zero(F.col("d2")) + or_zero(wf * dev_f * dev_f),
        **{n: F.col(n) + moved(F.col(f"head.{c}"), F.col(f"back.{c}"), sign) for n, (c, sign) in changes.items()},
    })
    out = parts.groupBy(*group).agg(
        *[F.sum(n).alias(n) for n in weighed],
        F.sum(F.col("d1") + or_zero(F.col("n_w") * shift)).alias("d1"),
        F.sum(F.col("d2") + or_zero(2 * shift * F.col("d1") + F.col("n_w") * shift * shift)).alias("d2"),
        F.min("base").alias("base"), F.sum("n_updates").alias("n_updates"),
        F.coalesce(F.min("spread_min"), F.lit(float("inf"))).alias("spread_min"),
        F.coalesce(F.max("spread_max"), F.lit(float("-inf"))).alias("spread_max"),
        *[F.sum(n).alias(n) for n in changes],
        F.min_by("since", "_slice").alias("t_first"), F.max_by("tail.time_ms", "_slice").alias("t_last"),
        F.max_by("tail", "_slice").alias("last"), F.min_by("head", "_slice").alias("first"),
    )
    if close == "next":
        sliced = out.withColumn("_o", -F.col("window_start_ms")).withColumn("_slice", F.floor(F.col("_o") / (size_ms * 4096)))
        out = lag_one(sliced, KEYS, ["_o"], {"book": "first"}).withColumn("book", F.coalesce("book", "last"))
    else:
        out = out.withColumn("book", F.col("last"))

    n_w = F.col("n_w")
    mean_dev = F.coalesce(F.try_divide(F.col("d1"), n_w), F.lit(0.0))
    bb, ba, bq0, aq0 = (F.col(f"book.{c}") for c in ("bb", "ba", "bq0", "aq0"))
    sane = bb.isNotNull() & ba.isNotNull() & (ba >= bb)
    open_quote = F.col("last.mid").isNull() | F.col("last.spread").isNull()
    return out.withColumns({
        "window_end_ms": F.col("window_start_ms") + F.col("window_size_ms"),
        "mean_mid": F.when(n_w > 0, F.col("base") + mean_dev).otherwise(0.0),
        "M2_mid": F.when(n_w > 0, F.greatest(F.col("d2") - n_w * mean_dev * mean_dev, F.lit(0.0))).otherwise(0.0),
        "close_mid": F.when(open_quote & sane, (ba + bb) * 0.5).otherwise(F.col("last.mid")),
        "close_spread": F.when(open_quote & sane, ba - bb).otherwise(F.col("last.spread")),
        "close_bb": bb, "close_ba": ba, "close_bq0": bq0, "close_aq0": aq0,
        "close_best_imb": F.when(bq0 + aq0 > 0, F.try_divide(bq0 - aq0, bq0 + aq0)).otherwise(0.0),
    }).select(*KEYS, "window_end_ms", *ORDER_FEATURES)


def side_totals(ticks: DataFrame) -> DataFrame:
    """Total size, notional and volume-weighted price per side after each message."""
    return ticks.select(
        *BOOK_KEYS, "id", F.col("tot_b").alias("bid_qty"), F.col("tot_a").alias("ask_qty"),
        F.col("notional_b").alias("bid_notional"), F.col("notional_a").alias("ask_notional"),
        F.try_divide("notional_b", "tot_b").alias("bid_vwap"), F.try_divide("notional_a", "tot_a").alias("ask_vwap"),
    )


def sorted_levels(levels: Column, reverse: bool = False) -> Column:
    """Levels by price; ``reverse`` puts the highest first."""
    return F.sort_array(levels, asc=not reverse)


def best_level(levels: Column, side: str) -> Column:
    """The best level of a side: the highest bid or the lowest ask among levels with a size."""
    filled = F.filter(levels, lambda x: x["qty"] != 0)
    return F.array_max(filled) if side == "bid" else F.array_min(filled)


def top_of_side(levels: Column, side: str, depth: int) -> Column:
    """The best ``depth`` levels of a side, best first."""
    filled = F.filter(levels, lambda x: x["qty"] != 0)
    return F.slice(sorted_levels(filled, reverse=side == "bid"), 1, depth)
