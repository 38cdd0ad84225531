"""Order books and their windows inside a stream.

The book of a key is kept level by level, a map from price to size for each side, so that a micro-batch writes only the levels
it changed. The window that is open is kept as sums; ticks are added to it a batch at a time, and it is put out at the first message of
a later window, or by a timer once its key has been idle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ticklattice.operators.order_book import BOOK_KEYS, ORDER_FEATURES, TICK_SCHEMA, BookFold
from ticklattice.streaming.processors import IdleTimer, plain_values, rows_in_order
from ticklattice.streaming.runner import use_rocksdb

_LEVELS = pa.list_(pa.struct([("price", pa.decimal128(38, 18)), ("qty", pa.decimal128(38, 18))]))
MESSAGE_TYPES = {"platform": pa.string(), "symbol": pa.string(), "id": pa.int64(), "time_ms": pa.int64(), "type": pa.string(), "bids": _LEVELS, "asks": _LEVELS}

COUNTS = ["n_updates", "n_mid_up", "n_mid_down", "n_spread_widen", "n_spread_tighten"]
SUMS = ["sw", "sw_mid", "sw_micro", "sw_spread", "n_w", "sw_bid", "sw_ask", "sw_imb", "sw_bid_best_sz", "sw_ask_best_sz"]
LAST = ["mid", "spread", "bb", "ba", "bq0", "aq0"]
_WHOLE = [*COUNTS, "t_first", "t_last"]
ORDER_WINDOW_SCHEMA = "platform string, symbol string, window_size_ms long, window_end_ms long, " + ", ".join(
    f"{f} {'long' if f in _WHOLE else 'double'}" for f in ORDER_FEATURES)


class BookState:
    """A key's book in the state store. ``load`` gives it in the form that ``BookFold`` takes; ``save`` writes what differs."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.sides = {k: handle.getMapState(k, "price string", "qty string") for k in ("bids", "asks")}
        self.facts = handle.getValueState("facts", "depth_b int, depth_a int, live boolean, seen long")
        self.held: dict[str, dict[str, str]] = {"bids": {}, "asks": {}}

    def load(self) -> dict | None:
        self.held = {k: {p[0]: q[0] for p, q in side.iterator()} for k, side in self.sides.items()}
        if not self.facts.exists():
            return None
        depth_b, depth_a, live, seen = self.facts.get()
        return {**{k: [list(x) for x in levels.items()] for k, levels in self.held.items()}, "depths": [depth_b, depth_a], "live": live, "seen": seen}

    def save(self, after: dict) -> int:
        """Returns how many levels were written or removed."""
        writes = 0
        for k, side in self.sides.items():
            before, now = self.held[k], dict(after[k])
            for p in before.keys() - now.keys():
                side.removeKey((p,))
                writes += 1
            for p, q in now.items():
                if before.get(p) != q:
                    side.updateValue((p,), (q,))
                    writes += 1
            self.held[k] = now
        self.facts.update((*after["depths"], after["live"], after["seen"]))
        return writes


class BookProcessor(StatefulProcessor):
    """The book after each message."""

    def __init__(self, limit_depth: bool = True, window_ms: int | None = None):
        self.fold = BookFold(limit_depth, window_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = BookState(handle)

    def ticks(self, rows: Iterator[pd.DataFrame]) -> pa.Table:
        pdf = rows_in_order(rows, ["id"])
        table = pa.table({c: pa.array(plain_values(pdf[c]), t) for c, t in MESSAGE_TYPES.items()})
        out, after = self.fold(self.book.load(), table)
        self.book.save(after)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = self.ticks(rows)
        if out.num_rows:
            yield out.to_pandas()

    def close(self) -> None:
        pass


class WindowSums:
    """The features of one open window, from runs of its ticks in order.

    A tick weighs the time since the one before it in the window, since the window's start for the first, at least 1. Means and squared
    deviations of runs are put together about their own means, so that they do not cancel.
    """

    FIELDS = ["start", "t_last", *COUNTS, *SUMS, "mean", "m2", "spread_min", "spread_max", *LAST]
    STATE = ", ".join(f"{f} {'long' if f in ('start', 't_last', *COUNTS) else 'double'}" for f in FIELDS)

    def __init__(self, start: int):
        self.v = dict.fromkeys(self.FIELDS, 0.0) | dict.fromkeys(COUNTS, 0)
        self.v.update(start=start, t_last=start, spread_min=np.inf, spread_max=-np.inf, **dict.fromkeys(LAST, np.nan))

    @classmethod
    def of(cls, state: tuple) -> WindowSums:
        made = cls(0)
        made.v = {f: np.nan if x is None else x for f, x in zip(cls.FIELDS, state, strict=True)}
        return made

    def state(self) -> tuple:
        return tuple(int(x) if f in ("start", "t_last", *COUNTS) else float(x) for f, x in self.v.items())

    def add(self, t: np.ndarray, quotes: dict[str, np.ndarray]) -> None:
        """``quotes`` holds ``bb, ba, bq0, aq0, tot_b, tot_a`` by tick; a missing best price is not a number."""
        v, q = self.v, quotes
        since = np.concatenate([[v["t_last"]], t[:-1]])
        w = np.maximum(t - since, 1).astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            sane, best, total = q["ba"] >= q["bb"], q["bq0"] + q["aq0"], q["tot_b"] + q["tot_a"]
            mid = np.where(sane, (q["ba"] + q["bb"]) * 0.5, np.nan)
            spread = np.where(sane, q["ba"] - q["bb"], np.nan)
            micro = np.where(sane & (best > 0), (q["ba"] * q["bq0"] + q["bb"] * q["aq0"]) / best, np.nan)
            both = (q["tot_b"] != 0) & (q["tot_a"] != 0)
            imbalance = np.where(both & (total != 0), (q["tot_b"] - q["tot_a"]) / total, np.nan)
        each = {
            "sw": np.ones(len(t)), "sw_mid": mid, "sw_micro": micro, "sw_spread": spread, "n_w": np.where(sane, 1.0, np.nan), "sw_bid": np.where(both, q["tot_b"], np.nan),
            "sw_ask": np.where(both, q["tot_a"], np.nan), "sw_imb": imbalance, "sw_bid_best_sz": q["bq0"], "sw_ask_best_sz": q["aq0"],
        }
        before = v["n_w"]
        for f, x in each.items():
            v[f] += float(np.nansum(w * x))
        added = v["n_w"] - before
        if added:
            mean = float(np.nansum(w * mid)) / added
            shift = mean - v["mean"]
            v["m2"] += float(np.nansum(w * (mid - mean) ** 2)) + shift * shift * before * added / v["n_w"]
            v["mean"] += shift * added / v["n_w"]
            v["spread_min"], v["spread_max"] = min(v["spread_min"], float(np.nanmin(spread))), max(v["spread_max"], float(np.nanmax(spread)))
        for up, down, x, last in (("n_mid_up", "n_mid_down", mid, v["mid"]), ("n_spread_widen", "n_spread_tighten", spread, v["spread"])):
            step = x - np.concatenate([[last], x[:-1]])
            v[up] += int((step > 0).sum())
            v[down] += int((step < 0).sum())
        v["n_updates"] += len(t)
        v["t_last"] = int(t[-1])
        v.update(mid=mid[-1], spread=spread[-1], **{f: q[f][-1] for f in ("bb", "ba", "bq0", "aq0")})

    def row(self, key: tuple, size_ms: int) -> tuple:
        v, best = self.v, self.v["bq0"] + self.v["aq0"]
        made = {
            **v, "mean_mid": v["mean"] if v["n_w"] > 0 else 0.0, "M2_mid": max(v["m2"], 0.0), "t_first": v["start"], "close_mid": v["mid"], "close_spread": v["spread"],
            "close_bb": v["bb"], "close_ba": v["ba"], "close_bq0": v["bq0"], "close_aq0": v["aq0"], "close_best_imb": (v["bq0"] - v["aq0"]) / best if best > 0 else 0.0,
        }
        return (*key, size_ms, v["start"] + size_ms, *(made[f] for f in ORDER_FEATURES))


class OrderWindowProcessor(BookProcessor):
    """Windows of the book, each put out at the first message of a later one; with ``idle_ms`` also when its key was idle for so long."""

    def __init__(self, size_ms: int, *, limit_depth: bool = True, idle_ms: int | None = None):
        super().__init__(limit_depth, size_ms)
        self.size_ms, self.idle_ms = size_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", WindowSums.STATE)
        self.timer = IdleTimer(handle, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticks, done = self.ticks(rows), []
        window = WindowSums.of(self.window.get()) if self.window.exists() else None
        if ticks.num_rows:
            t = ticks.column("time_ms").to_numpy()
            quotes = {c: ticks.column(c).to_numpy() for c in ("bb", "ba", "bq0", "aq0", "tot_b", "tot_a")}
            starts = t // self.size_ms * self.size_ms  # never falls, as late messages were left out
            cuts = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(t)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if window is None or window.v["start"] != starts[a]:
                    if window is not None:
                        done.append(window.row(key, self.size_ms))
                    window = WindowSums(int(starts[a]))
                window.add(t[a:b], {c: x[a:b] for c, x in quotes.items()})
            self.window.update(window.state())
        self.timer.restart(timerValues)
        if done:
            yield _frame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The window is over: it is put out, and what may still come of it starts one anew. The book stays."""
        if self.window.exists():
            window = WindowSums.of(self.window.get())
            self.window.clear()
            yield _frame([window.row(key, self.size_ms)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*BOOK_KEYS, "window_size_ms", "window_end_ms", *ORDER_FEATURES])


def book_tick_stream(messages: DataFrame, *, limit_depth: bool = True, window_ms: int | None = None) -> DataFrame:
    """The book after each message on a stream; late messages are ignored with ``window_ms``, see ``order_book.BookFold``."""
    use_rocksdb(messages.sparkSession)
    return messages.select(*MESSAGE_TYPES).groupBy(*BOOK_KEYS).transformWithStateInPandas(
        BookProcessor(limit_depth, window_ms), outputStructType=TICK_SCHEMA, outputMode="Append", timeMode="None")


def order_window_stream(messages: DataFrame, size_ms: int, *, limit_depth: bool = True, idle_ms: int | None = None) -> DataFrame:
    """Order-book windows with all features from a stream of messages in order of id within a key.

    A message whose window is older than that of an earlier message with a book never touches the book. A window comes out at the
    first message with a book of a later one. With ``idle_ms`` a key without messages for so long puts its open window out as well; such a
    query goes on running its timers and has to be stopped.
    """
    use_rocksdb(messages.sparkSession)
    return messages.select(*MESSAGE_TYPES).groupBy(*BOOK_KEYS).transformWithStateInPandas(
        OrderWindowProcessor(size_ms, limit_depth=limit_depth, idle_ms=idle_ms), outputStructType=ORDER_WINDOW_SCHEMA, outputMode="Append",
        timeMode="ProcessingTime" if idle_ms else "None")
