"""Two feeds of one key's trades as one stream, in order of id and each trade once.

A trade that follows the last one goes out; one behind it is dropped. Over a hole a trade goes out only when both feeds
have shown a trade at or beyond it, so the missing ones cannot come any more. Trades that wait are kept by id, so a micro-batch
writes only those that begin or cease to wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ticklattice.streaming.runner import use_rocksdb


def earliest(ids: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id once and in order, as of the ``rest`` feed if that has it."""
    order = np.lexsort((~rest, ids))
    ids, rest = ids[order], rest[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    return ids[first], rest[first]


def released(last: int, sure: int, ids: np.ndarray) -> int:
    """How many of these ids, in order and all beyond ``last``, go out: those up to ``sure``, and what follows without a hole."""
    n = int(np.searchsorted(ids, sure, side="right"))
    end = int(ids[n - 1]) if n else last
    follows = ids[n:] == end + 1 + np.arange(len(ids) - n)
    return n + (len(follows) if follows.all() else int(np.argmin(follows)))


class FeedMergeProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getValueState("facts", "last long, rest_top long, ws_top long")
        self.waiting = handle.getMapState("waiting", "id long", "rest boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, rest_top, ws_top = self.facts.get() if self.facts.exists() else (0, -1, -1)
        parts = [(b["id"].to_numpy(np.int64), (b["feed"] == "rest").to_numpy(bool)) for b in rows]
        ids, rest = (np.concatenate(x) for x in zip(*parts))
        rest_top, ws_top = max(rest_top, int(ids[rest].max(initial=-1))), max(ws_top, int(ids[~rest].max(initial=-1)))
        held = {k[0]: v[0] for k, v in self.waiting.iterator()}
        new = ids > last
        ids, rest = earliest(np.concatenate([ids[new], np.fromiter(held, np.int64, len(held))]), np.concatenate([rest[new], np.fromiter(held.values(), bool, len(held))]))
        n = released(last, min(rest_top, ws_top), ids)
        for i in ids[:n].tolist():
            if i in held:
                self.waiting.removeKey((i,))
        for i, r in zip(ids[n:].tolist(), rest[n:].tolist()):
            if held.get(i) != r:
                self.waiting.updateValue((i,), (r,))
        self.facts.update((int(ids[n - 1]) if n else last, rest_top, ws_top))
        if n:
            yield pd.DataFrame({"platform": key[0], "symbol": key[1], "id": ids[:n], "feed": np.where(rest[:n], "rest", "ws")})

    def close(self) -> None:
        pass


def merge_trades_stream(feeds: DataFrame) -> DataFrame:
    """Two tagged feeds (``platform, symbol, id, feed`` with ``rest`` or ``ws``) as one."""
    use_rocksdb(feeds.sparkSession)
    return feeds.select("platform", "symbol", "id", "feed").groupBy("platform", "symbol").transformWithStateInPandas(
        FeedMergeProcessor(), outputStructType="platform string, symbol string, id long, feed string", outputMode="Append", timeMode="None")
