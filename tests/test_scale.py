"""Results do not depend on how keys are cut up, and plans have the shape they should at scale."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ticklattice.functions import scale
from ticklattice.operators import features as ft
from ticklattice.operators import order_book as ob
from ticklattice.operators import reconcile as rc
from ticklattice.operators import trade_windows as tw
from ticklattice.operators import transforms as tf
from ticklattice.plans.views import WINDOW_MS, book_messages, trades
from ticklattice.plans.windows_catalog import trade_frames
from ticklattice.sources import window_store as ws
from ticklattice.streaming import book_windows as bw
from ticklattice.streaming.processors import two_window_stream
from ticklattice.streaming import runner

from .states import HandleOfOne

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def numbers(spark):
    """One key holds most rows; order values have holes."""
    rng = random.Random(3)
    data = [("hot", 7 * i + rng.randrange(7), rng.randrange(100)) for i in range(500)] + [("cold", 900 * i, i) for i in range(5)]
    return spark.createDataFrame(data, "k string, o long, v long"), data


@pytest.mark.parametrize("width", [1, 10, 333, 10**9])
def test_running_index_and_lag(numbers, width):
    df, data = numbers
    df = scale.with_slice(df, "o", width)
    out = scale.running(df, ["k"], ["o"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, exclusive=True)
    out = scale.dense_index(out, ["k"], ["o"], out="i")
    out = scale.lag_one(out, ["k"], ["o"], {"p": "v"})
    got = {(r["k"], r["o"]): (r["s"], r["m"], r["i"], r["p"]) for r in out.collect()}
    for k in ("hot", "cold"):
        seen = []
        for _, o, v in sorted(d for d in data if d[0] == k):
            assert got[(k, o)] == (sum(seen), max(seen) if seen else None, len(seen), seen[-1] if seen else None)
            seen.append(v)


@pytest.mark.parametrize("block", [1, 3, 20])
def test_offsets_do_not_depend_on_blocks(spark, block):
    frames = trade_frames(spark, SF)
    pick = lambda d: d.select(*ft.KEYS, "window_end_ms", *[F.col(f"`{k}_trade_features`")["close"].alias(f"c{i}") for i, k in enumerate((-12, -1, 0, 3, 7))])
    args = dict(prev_n=12, from_next_n=3, to_next_n=7)
    assert same(pick(ft.k_offsets(frames, **args)), pick(ft.k_offsets(frames, block_windows=block, **args)))


def test_trade_slices(spark):
    cols = ["trade_count", "open", "close", "sum_dt", "max_gap_ms", F.round("sum_logret3", 6).alias("r3")]
    whole = tw.trade_windows(trades(spark, SF), WINDOW_MS * 50).select("symbol", "window_end_ms", *cols)
    cut = tw.trade_windows(trades(spark, SF), WINDOW_MS * 50, slice_ids=7).select("symbol", "window_end_ms", *cols)
    assert same(whole, cut)


def test_transform_blocks(spark, monkeypatch):
    gold = tw.trade_windows(trades(spark, SF), WINDOW_MS).select(*tf.KEYS, "window_end_ms", "close")
    run = lambda: tf.transform(tf.chrono_split(gold), "zscore_doubled_diff_fibo_incl", ["close"]).withColumn("close", F.round("close", 6)).toPandas()
    by = [*tf.KEYS, "window_end_ms"]
    whole = run().sort_values(by).reset_index(drop=True)
    monkeypatch.setattr(tf, "BLOCK_ROWS", 5)
    cut = run().sort_values(by).reset_index(drop=True)
    assert whole.equals(cut[whole.columns])


def brute_force_book(messages):
    """Each message's book by the plain rules."""
    out, sides, live, depth = [], ({}, {}), False, [0, 0]
    for m in messages:
        for n, levels in enumerate((m["bids"], m["asks"])):
            if m["type"] == "snapshot":
                sides[n].clear()
            if m["type"] == "snapshot" or live:
                for p, q in levels:
                    sides[n].pop(p, None)
                    if q:
                        sides[n][p] = q
            if m["type"] == "snapshot":
                depth[n] = len(sides[n])
            elif live and depth[n]:
                for p in sorted(sides[n], reverse=n == 0)[depth[n]:]:
                    del sides[n][p]
        live = live or m["type"] == "snapshot"
        if live:
            out.append((m["id"], max(sides[0], default=None), min(sides[1], default=None), sum(sides[0].values()), sum(sides[1].values())))
    return out


@pytest.mark.parametrize("args", [{}, {"epochs": 1}, {"slice_ids": 10**12, "epochs": 7}, {"slice_ids": 10**15}])
def test_book_against_brute_force(spark, args):
    messages = book_messages(spark, SF)
    got = {(r["platform"], r["symbol"], r["id"]): (r["bb"], r["ba"], r["tot_b"], r["tot_a"]) for r in ob.book_ticks(messages, **args).collect()}
    by_key = {}
    for m in messages.orderBy("id").collect():
        by_key.setdefault((m["platform"], m["symbol"]), []).append(m)
    n = 0
    for key, ms in by_key.items():
        for i, bb, ba, tb, ta in brute_force_book(ms):
            n += 1
            assert got[(*key, i)] == (bb if bb is None else float(bb), ba if ba is None else float(ba), float(tb or Decimal(0)), float(ta or Decimal(0)))
    assert n == len(got)


HOUR = 3_600_000
NUM = "decimal(38,18)"
MESSAGES = f"platform string, symbol string, id long, type string, time_ms long, bids array<struct<price:{NUM},qty:{NUM}>>, asks array<struct<price:{NUM},qty:{NUM}>>"


def quotes(spark, items):
    """(id, type, time, bids, asks) as messages of one key."""
    level = lambda levels: [(Decimal(p), Decimal(q)) for p, q in levels]
    return spark.createDataFrame([("x", "s", i, kind, t, level(b), level(a)) for i, kind, t, b, a in items], MESSAGES)


@pytest.mark.parametrize("slice_ids", [1, 2, 65_536])
def test_messages_are_taken_by_id_across_an_edge_of_an_hour(spark, slice_ids):
    items = [(1, "snapshot", HOUR + 20, [(5, 1)], [(6, 1)]), (2, "update", HOUR - 5, [(5, 2)], []), (3, "update", HOUR + 50, [], [(6, 3)])]
    for epochs in (1, 64):
        ticks = ob.book_ticks(quotes(spark, items), slice_ids=slice_ids, epochs=epochs)
        assert [r["id"] for r in ticks.orderBy("id").collect()] == [1, 2, 3]
    row = ob.order_windows(ticks, 2 * HOUR, slice_ids=slice_ids).first()
    assert (row["n_updates"], row["sw"]) == (3, HOUR + 20 + 1 + 55)


@pytest.mark.parametrize("slice_ids", [1, 2, 3, 65_536])
def test_a_step_back_in_time_weighs_one(spark, slice_ids):
    items = [(n, "update" if n else "snapshot", t, [(5, n + 1)], [(6, 1)]) for n, t in enumerate((1000, 3000, 2000, 5000))]
    assert ob.order_windows(ob.book_ticks(quotes(spark, items)), 6400, slice_ids=slice_ids).first()["sw"] == 1000 + 2000 + 1 + 3000


def plain_windows(messages, size):
    """Windows by the rules, one message after the other: (window end, weight, updates, last time, closing mid)."""
    book, depth, seen, last, out = ({}, {}), [0, 0], None, None, {}
    for _, kind, t, *sides in messages:
        window = t // size
        if seen is None and kind != "snapshot" or seen is not None and window < seen:
            continue
        if window != seen:
            last = window * size
        seen = window
        for n, levels in enumerate(sides):
            if kind == "snapshot":
                book[n].clear()
            for p, q in levels:
                book[n].pop(p, None)
                if q:
                    book[n][p] = q
            if kind == "snapshot":
                depth[n] = len(book[n])
            elif depth[n]:
                for p in sorted(book[n], reverse=n == 0)[depth[n]:]:
                    del book[n][p]
        weight, count, _, _ = out.get(window, (0, 0, None, None))
        mid = (max(book[0]) + min(book[1])) / 2 if all(book) and max(book[0]) <= min(book[1]) else None
        out[window] = (weight + max(1, t - last), count + 1, t, mid)
        last = t
    return {(w + 1) * size: v for w, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_windows_with_times_that_go_back_and_forth(spark, seed):
    rng, t, items, size = random.Random(seed), 10 * HOUR, [], 60_000
    for i in range(400):
        t += rng.choice((1, 500, 3000, -700, -4000, 20_000, -15_000))
        levels = lambda base: [(base + rng.randrange(8), rng.randrange(4)) for _ in range(rng.randrange(4))]
        items.append((3 * i, "snapshot" if rng.random() < 0.05 else "update", t, levels(100), levels(107)))
    for n, (i, kind, at, b, a) in enumerate(items):  # a price comes once in a message
        items[n] = (i, kind, at, list(dict(b).items()), list(dict(a).items()))
    want = plain_windows(items, size)
    messages = quotes(spark, items)
    for slice_ids, epochs in ((1, 1), (50, 3), (65_536, 64)):
        ticks = ob.book_ticks(ob.drop_late(messages, size, slice_ids=slice_ids), slice_ids=slice_ids, epochs=epochs)
        got = {r["window_end_ms"]: (r["sw"], r["n_updates"], r["t_last"], r["close_mid"]) for r in ob.order_windows(ticks, size, slice_ids=slice_ids).collect()}
        assert {k: (v[0], v[1]) for k, v in got.items()} == {k: (v[0], v[1]) for k, v in want.items()}
        assert {k: v[2:] for k, v in got.items()} == {k: v[2:] for k, v in want.items()}
    halves = [messages.where("id < 600"), messages.where("id >= 600")]
    streamed = runner.run_in_parts(halves, lambda s: bw.book_tick_stream(s, window_ms=size), "ticks")
    assert same(streamed, ob.book_ticks(ob.drop_late(messages, size)).select(streamed.columns))
    thirds = [messages.where(f"id >= {a} and id < {b}") for a, b in ((0, 300), (300, 301), (301, 10_000))]
    windows = runner.run_in_parts(thirds, lambda s: bw.order_window_stream(s, size), "windows")
    batch = {r["window_end_ms"]: r for r in ob.order_windows(ob.book_ticks(ob.drop_late(messages, size)), size).collect()}
    got = {r["window_end_ms"]: r for r in windows.collect()}
    assert set(got) == set(batch) - {max(batch)}  # the last window is still open
    for end, r in got.items():
        for f in ob.ORDER_FEATURES:
            a, b = r[f], batch[end][f]
            assert a == b or a == pytest.approx(b, rel=1e-9, abs=1e-6), (end, f)


def test_a_micro_batch_writes_only_the_levels_it_changed():
    book = bw.BookState(HandleOfOne())
    assert book.load() is None
    wide = {"bids": [[str(p), "1"] for p in range(500)], "asks": [], "depths": [500, 0], "live": True, "seen": 7}
    assert book.save(wide) == 500
    back = book.load()
    assert back == wide
    back["bids"] = [x for x in back["bids"] if x[0] != "3"]
    back["bids"][0] = ["0", "2"]
    back["asks"] = [["900", "5"]]
    assert book.save(back) == 3 and book.load() == back
    assert book.save(back) == 0


def test_sums_of_a_window_do_not_depend_on_how_its_ticks_are_cut():
    import numpy as np

    rng = np.random.default_rng(3)
    t = np.cumsum(rng.integers(-2, 9, 200)) + 1000
    quotes = {"bb": np.where(rng.random(200) < 0.1, np.nan, 1e6 + rng.integers(0, 9, 200)), "ba": np.where(rng.random(200) < 0.1, np.nan, 1e6 + rng.integers(7, 15, 200))}
    quotes |= {c: rng.integers(0, 4, 200).astype(float) for c in ("bq0", "aq0", "tot_b", "tot_a")}
    whole = bw.WindowSums(0)
    whole.add(t, quotes)
    for cuts in ([1], [50, 51, 120], list(range(1, 200))):
        parts = bw.WindowSums(0)
        for a, b in zip([0, *cuts], [*cuts, 200]):
            parts = bw.WindowSums.of(parts.state())  # as it comes back from the store
            parts.add(t[a:b], {c: x[a:b] for c, x in quotes.items()})
        assert parts.row(("p", "s"), 10)[:4] == whole.row(("p", "s"), 10)[:4]
        assert parts.state() == pytest.approx(whole.state(), nan_ok=True, rel=1e-9, abs=1e-6)


def test_open_windows_come_out_once_a_key_is_idle(spark):
    """Two open trade windows of one key; a second key whose only window is open; each once."""
    rows = [("p", "a", i, 1000 * i, "1.5", "2", 0) for i in range(25)] + [("p", "b", 1, 5, "1", "1", 1)]
    trades = spark.createDataFrame(rows, "platform string, symbol string, platform_trade_id long, time_ms long, price string, quantity string, side int")
    out = runner.run_until_idle([trades.where("time_ms < 12000"), trades.where("time_ms >= 12000")], lambda s: two_window_stream(s, 10_000, idle_ms=3000), "idle", 3000)
    got = sorted((r.symbol, r.window_end_ms, r.trade_count) for r in out.collect())
    assert got == [("a", 10_000, 10), ("a", 20_000, 10), ("a", 30_000, 5), ("b", 10_000, 1)]


def test_a_fold_does_not_depend_on_its_batches(spark):
    messages = book_messages(spark, SF)
    whole = ob.book_ticks(messages, slice_ids=10**12).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(whole) == sorted(ob.book_ticks(messages, slice_ids=10**12).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sequence_chunks_agree(spark):
    rng, last, data = random.Random(5), 0, []
    for i in range(400):
        if rng.random() < 0.08:
            data.append(("s", i, "snapshot", last + rng.randrange(-3, 4), 0))
            data[-1] = (*data[-1][:4], data[-1][3])
            continue
        n = rng.randrange(1, 5)
        if rng.random() > 0.05:
            data.append(("s", i, "update", last + 1, last + n))
        last += n
    df = spark.createDataFrame(data, "symbol string, arrival long, kind string, first_id long, last_id long")
    whole = rc.merge_snapshots_updates(df, ["symbol"])
    assert whole.count() > 50
    for chunk in (9, 60):
        assert same(whole, rc.merge_snapshots_updates(df, ["symbol"], slice_width=chunk, stretches=chunk // 9))


# --- plans ------------------------------------------------------------------------------------------------------------

def test_trade_windows_stay_in_the_jvm_and_prune_columns(spark):
    text = plan(tw.trade_windows(trades(spark, SF), WINDOW_MS).select("symbol", "window_end_ms", "high"))
    assert "Python" not in text and "Arrow" not in text
    assert "event_type" not in text.split("ReadSchema")[1]


def test_offsets_need_one_exchange(spark, tmp_path):
    ws.write_windows(tw.as_struct(tw.trade_windows(trades(spark, SF), WINDOW_MS), tw.TRADE_FEATURES, "trade_features"), str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w")).withColumn("order_features", F.lit(None).cast("struct<sw:double>"))
    text = plan(ft.k_offsets(stored, prev_n=12, from_next_n=3, to_next_n=7))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_window_scan_pushes_its_filters(spark, tmp_path):
    ws.write_windows(tw.as_struct(tw.trade_windows(trades(spark, SF), WINDOW_MS), tw.TRADE_FEATURES, "trade_features"), str(tmp_path / "w"))
    out = ws.scan_complete(spark, str(tmp_path / "w"), from_ms=1_704_500_000_000, to_ms=1_706_200_000_000, platform="kraken")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = plan(out.select("window_end_ms", "trade_features.close"))
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(window_end_ms,1704500000000)" in pushed and "EqualTo(platform,kraken)" in pushed
    assert "date" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "trade_features:struct<close:double>" in text.split("ReadSchema")[1]


def test_no_cartesian_products(spark):
    from ticklattice.plans.catalog import QUERIES

    for name in ("merge_api_ws_trades", "pct_targets", "prediction_summary", "gap_backfill", "expand_feature_sets"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, SF)), name


def test_no_step_of_late_messages_takes_a_whole_key(spark):
    import re

    from ticklattice.operators.order_book import drop_late

    schema = "platform string, symbol string, id long, type string, time_ms long, bids array<int>, asks array<int>"
    messages = spark.createDataFrame([("k", "s", i, "snapshot" if i == 3 else "update", i, [], []) for i in range(9)], schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = drop_late(messages, 1000)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[platform#\d+, symbol#\d+\]", plan)
        assert "REPARTITION_BY_NUM" in plan  # adaptive execution keeps the number of tasks
        assert sorted(r["id"] for r in out.collect()) == [3, 4, 5, 6, 7, 8]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_streamed_book_takes_a_part_in_bounded_micro_batches_in_order(spark):
    from pyspark.sql import functions as F

    from ticklattice.operators.order_book import LEVELS, book_ticks
    from ticklattice.streaming import book_windows as bw
    from ticklattice.streaming import runner

    level = F.array(F.struct((F.lit(100) + F.col("id") % 7).alias("price"), (F.lit(1) + F.col("id") % 3).alias("qty"))).cast(LEVELS)
    m = spark.range(1000).repartition(7).select(
        F.lit("p").alias("platform"), F.concat(F.lit("s"), F.col("id") % 2).alias("symbol"), "id", (F.col("id") * 10).alias("time_ms"),
        F.when(F.col("id") % 100 < 2, "snapshot").otherwise("update").alias("type"), level.alias("bids"), F.array().cast(LEVELS).alias("asks"))
    seen = []
    watch = lambda q: seen.extend(p["numInputRows"] for p in q.recentProgress)
    out = runner.run_in_parts([m.where("id < 500"), m.where("id >= 500")], bw.book_tick_stream, "bounded", watch, order="id", rows=100)
    assert sum(seen) == 1000 and max(seen) <= 200
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, book_ticks(m).collect()))


def test_a_stream_has_no_more_stateful_tasks_than_cores(spark):
    from ticklattice.streaming import runner
    from ticklattice.streaming.processors import handle_rows

    count = lambda state, row: ({"n": (state or {"n": 0})["n"] + 1}, [{"k": row["k"], "id": row["id"], "n": (state or {"n": 0})["n"]}])
    rows = spark.range(600).selectExpr("id % 50 AS k", "id")
    before, seen, got = spark.conf.get("spark.sql.shuffle.partitions"), [], {}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for many in (False, True):  # a frame for each key, or its rows one by one
            out = runner.run_in_parts([rows], lambda s: handle_rows(s, ["k"], count, ["id"], "k long, id long, n long", many_keys=many), "tasks",
                                      lambda q: seen.extend(p["stateOperators"][0]["numShufflePartitions"] for p in q.recentProgress), order="id", rows=200)
            got[many] = sorted(tuple(r) for r in out.collect())
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) >= 6 and max(seen) <= max(8, spark.sparkContext.defaultParallelism)
    assert got[False] == got[True] == sorted((i % 50, i, i // 50) for i in range(600))
