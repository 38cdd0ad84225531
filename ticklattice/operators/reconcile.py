"""Joining overlapping feeds: merge by id, snapshot and update sequences, holes, backfill and resume points."""

from __future__ import annotations

from bisect import insort
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklattice.functions.scale import lag_one, running
from ticklattice.operators.fold import ordered_fold

ID_SLICE = 65_536


def id_slices(df: DataFrame, id_col: str = "id", width: int = ID_SLICE) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(id_col) / width))


def union_tagged(feeds: Mapping[str, DataFrame], tag: str = "stream") -> DataFrame:
    """All rows of the named feeds with the feed's name; columns a feed lacks are null."""
    out = None
    for name, df in feeds.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no feeds given")
    return out


def merge_trades(rest: DataFrame, ws: DataFrame, keys: Sequence[str], last_emitted: DataFrame | None = None) -> DataFrame:
    """Trades of two feeds in one: each id once (the REST row where both have it), up to the first doubtful hole.

    A hole in the ids is taken as real once both feeds have an id at or beyond its end; before that the missing trade
    may still come, so rows from there on are held back. That makes the cut the first hole above the smaller of the
    two feeds' largest ids, and only ids above that need to be looked at in order. ``last_emitted`` (``keys``, ``id``)
    continues an earlier run; without it counting starts after id 0.
    """
    keys = list(keys)
    both = union_tagged({"rest": rest, "ws": ws}, "feed")
    cols = [c for c in both.columns if c not in (*keys, "id")]
    seen = both.groupBy(*keys).agg(
        F.max(F.when(F.col("feed") == "rest", F.col("id"))).alias("_r"), F.max(F.when(F.col("feed") == "ws", F.col("id"))).alias("_w"))
    seen = seen.select(*keys, F.least(F.coalesce("_r", F.lit(-1)), F.coalesce("_w", F.lit(-1))).alias("_sure"))
    start = F.lit(0).cast("long")
    if last_emitted is not None:
        seen = seen.join(last_emitted.select(*keys, F.col("id").alias("_last")), keys, "left")
        start = F.coalesce("_last", F.lit(0)).cast("long")
    seen = seen.select(*keys, "_sure", start.alias("_last"))
    once = (
        both.join(seen, keys).where(F.col("id") > F.col("_last"))
        .groupBy(*keys, "id", "_sure", "_last").agg(F.min_by(F.struct(*cols), "feed").alias("_row"))
    )
    # Ids above the sure one, and the largest id at or below it as their predecessor.
    tail = once.where(F.col("id") > F.col("_sure")).select(*keys, "id")
    below = once.groupBy(*keys).agg(F.max(F.when(F.col("id") <= F.col("_sure"), F.col("id"))).alias("_b"), F.max("_last").alias("_l"))
    below = below.select(*keys, F.coalesce("_b", "_l").alias("id"))
    chain = lag_one(id_slices(tail.unionByName(below)), keys, ["id"], {"_prev": "id"})
    cut = chain.where(F.col("id") - F.col("_prev") > 1).groupBy(*keys).agg(F.min("id").alias("_cut"))
    kept = once.join(cut, keys, "left").where(F.col("_cut").isNull() | (F.col("id") < F.col("_cut")))
    return kept.select(*keys, "id", *[F.col(f"_row.{c}").alias(c) for c in cols])


SEQUENCE_SCHEMA_FIELDS = "arrival long, kind string, first_id long, last_id long, emitted_at long"


class SequenceFold:
    """The fold that keeps an order-book sequence gap-free.

    A snapshot is passed on if it is ahead of what was passed on before. An update is passed on if it joins on
    (``first_id <= last + 1`` and ``last_id >= last``), dropped if it is wholly behind, and held otherwise or while no
    snapshot was seen; held updates are looked at again after each message that moved the sequence.
    """

    def __init__(self, keys: Sequence[str], resume_at: int = -1):
        self.keys, self.resume_at = list(keys), resume_at

    def __call__(self, state: dict | None, table: pa.Table):
        last = state["last"] if state else self.resume_at
        held: list[list] = state["held"] if state else []  # [first_id, -last_id, arrival], in that order
        out = []
        cols = [table.column(c).to_pylist() for c in ("arrival", "kind", "first_id", "last_id")]
        for arrival, kind, lo, hi in zip(*cols, strict=True):
            if kind == "snapshot":
                if hi <= last:
                    continue
            elif last == -1 or lo > last + 1:
                insort(held, [lo, -hi, arrival])
                continue
            elif hi < last:
                continue
            last = hi
            out.append((arrival, kind, lo, hi, arrival))
            passed = 0
            while passed < len(held) and held[passed][0] <= last + 1:  # those beyond a hole stay where they are
                first, back, came = held[passed]
                passed += 1
                if -back >= last:
                    last = -back
                    out.append((came, "update", first, last, arrival))
            del held[:passed]
        names = ("arrival", "kind", "first_id", "last_id", "emitted_at")
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        values = list(zip(*out, strict=True)) if out else [()] * len(names)
        rows = {k: pa.array([table.column(k)[0].as_py()] * len(out), table.schema.field(k).type) for k in self.keys}
        rows.update({n: pa.array(v, t) for n, v, t in zip(names, values, types, strict=True)})
        return pa.table(rows), {"last": last, "held": held}


def merge_snapshots_updates(
    messages: DataFrame, keys: Sequence[str], *, resume_at: int = -1, slice_width: int = ID_SLICE, stretches: int = 64
) -> DataFrame:
    """The gap-free sequence of snapshots and updates, by order of arrival.

    ``messages`` has ``arrival`` (unique per key), ``kind`` (``snapshot`` or ``update``), ``first_id`` and ``last_id``
    (equal for a snapshot). ``emitted_at`` names the arrival that released a row. Rows not in the result were dropped
    or are still held.

    A snapshot ahead of all that came before sets the sequence whatever happened, so a key is cut there and runs of
    ``stretches`` such stretches are folded on their own. A task holds the updates its stretch waits with.
    """
    sliced = messages.withColumn("_slice", F.floor(F.col("arrival") / slice_width))
    ranked = running(sliced, keys, ["arrival"], {"_highest": ("max", F.col("last_id"))}, exclusive=True)
    ahead = (F.col("kind") == "snapshot") & (F.col("last_id") > F.greatest(F.coalesce("_highest", F.lit(resume_at)), F.lit(resume_at)))
    counted = running(ranked.withColumn("_cut", ahead.cast("long")), keys, ["arrival"], {"_stretch": ("sum", F.col("_cut"))})
    rows = counted.select(*keys, F.floor(F.col("_stretch") / stretches).alias("_group"), "arrival", "kind", "first_id", "last_id")
    key_types = ", ".join(f"{k} {messages.schema[k].dataType.simpleString()}" for k in keys)
    return ordered_fold(rows, [*keys, "_group"], ["arrival"], SequenceFold(keys, resume_at), f"{key_types}, {SEQUENCE_SCHEMA_FIELDS}")


def sequence_breaks(updates: DataFrame, keys: Sequence[str], slice_col: Column | None = None) -> DataFrame:
    """Updates whose ``first_id`` does not follow the previous one's ``last_id``, each key's first excepted."""
    sliced = updates.withColumn("_slice", F.floor(F.col("arrival") / ID_SLICE) if slice_col is None else slice_col)
    out = lag_one(sliced, keys, ["arrival"], {"prev_last_id": "last_id"})
    return out.where(F.col("first_id") != F.col("prev_last_id") + 1).drop("_slice")


def id_holes(ids: DataFrame, keys: Sequence[str], covered: DataFrame | None = None) -> DataFrame:
    """Missing id ranges between consecutive ids: ``hole_start, hole_end, size``.

    ``covered`` gives per key the last id another feed already has (``last_id``); holes up to it do not count.
    """
    chain = lag_one(id_slices(ids.select(*keys, "id").distinct()), keys, ["id"], {"prev": "id"})
    start = F.col("prev") + 1
    if covered is not None:
        chain = chain.join(covered.select(*keys, "last_id"), list(keys), "left")
        start = F.greatest(start, F.coalesce(F.col("last_id") + 1, start))
    holes = chain.where(F.col("prev").isNotNull()).select(*keys, start.alias("hole_start"), (F.col("id") - 1).alias("hole_end"))
    return holes.where(F.col("hole_start") <= F.col("hole_end")).withColumn("size", F.col("hole_end") - F.col("hole_start") + 1)


def hole_requests(holes: DataFrame, limit: int = 100) -> DataFrame:
    """Requests that fill the holes: ``from_id`` and ``limit`` of at most the given size."""
    cols = [c for c in holes.columns if c not in ("hole_start", "hole_end", "size")]
    return holes.select(
        *cols, "hole_end", F.explode(F.sequence("hole_start", "hole_end", F.lit(limit).cast("long"))).alias("from_id")
    ).select(*cols, "from_id", F.least(F.lit(limit), F.col("hole_end") - F.col("from_id") + 1).cast("int").alias("limit"))


def backfill(live: DataFrame, stored: DataFrame, keys: Sequence[str], last_seen: DataFrame) -> DataFrame:
    """Live rows beyond each key's ``last_seen`` id with what the feed skipped filled in from the stored log.

    The result holds every stored or live id in ``(last_seen, largest live id]`` once, the live row where both have it.
    """
    keys = list(keys)
    on = [*keys, "id"]
    mark = last_seen.select(*keys, F.col("id").alias("_from"))
    fresh = live.join(mark, keys, "left").where(F.col("id") > F.coalesce("_from", F.lit(-1))).drop("_from").dropDuplicates(on)
    span = live.groupBy(*keys).agg(F.max("id").alias("_to")).join(mark, keys, "left")
    between = stored.join(span, keys).where((F.col("id") > F.coalesce("_from", F.lit(-1))) & (F.col("id") <= F.col("_to"))).drop("_from", "_to")
    missing = between.join(fresh.select(*on), on, "left_anti")
    return union_tagged({"live": fresh, "stored": missing}, "origin")


def storage_ahead(stored: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose log holds ids beyond the last processed one."""
    top = stored.groupBy(*keys).agg(F.max("id").alias("stored_id"))
    joined = top.join(processed.groupBy(*keys).agg(F.max("id").alias("processed_id")), list(keys), "left")
    return joined.where(F.col("stored_id") > F.coalesce("processed_id", F.lit(-1)))


def resume_point(snapshots: DataFrame, updates: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where an order-book sequence goes on: the larger of the processed snapshot's and update's last ids, else -1.

    ``state`` has ``keys``, ``snapshot_arrival`` and ``update_arrival`` of the rows processed last.
    """
    keys = list(keys)
    snap = snapshots.select(*keys, F.col("arrival").alias("snapshot_arrival"), F.col("last_id").alias("_s"))
    upd = updates.select(*keys, F.col("arrival").alias("update_arrival"), F.col("last_id").alias("_u"))
    joined = state.join(snap, [*keys, "snapshot_arrival"], "left").join(upd, [*keys, "update_arrival"], "left")
    return joined.select(*keys, F.greatest(F.coalesce("_s", F.lit(-1)), F.coalesce("_u", F.lit(-1))).alias("resume_at"))


def last_per_feed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and feed the row with the largest id."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("id", "timestamp"), "id").alias("_r")).select(
        *keys, F.col("_r.id").alias("last_processed_id"), F.col("_r.timestamp").alias("last_processed_timestamp"))


def throughput(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows put out per key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows_out"))
