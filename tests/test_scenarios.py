"""Small scenarios with results worked out by hand."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ticklattice.functions import text as tx
from ticklattice.operators import features as ft
from ticklattice.operators import normalize as nz
from ticklattice.operators import order_book as ob
from ticklattice.operators import predict as pr
from ticklattice.operators import reconcile as rc
from ticklattice.operators import trade_windows as tw
from ticklattice.sources import raw_log as lg
from ticklattice.streaming.feed_merge import FeedMergeProcessor
from ticklattice.streaming.processors import TwoWindowHandler

from .states import HandleOfOne

KEYS = ["symbol"]


def rows(df):
    return [tuple(r) for r in df.collect()]


TRADES = [(1000, "100", "1", 0), (1400, "101", "2", 1), (2500, "99", "0.5", 0), (9000, "102", "1.5", 0)]


def trades(spark, items=TRADES):
    data = [("kraken", "btc_usdt", i, t, p, q, s) for i, (t, p, q, s) in enumerate(items)]
    return spark.createDataFrame(data, "platform string, symbol string, platform_trade_id long, time_ms long, price string, quantity string, side int")


EXPECTED_WINDOW = {
    "trade_count": 4, "sum_vol": 5.0, "sum_pv": 504.5, "buy_vol": 3.0, "sell_vol": 2.0, "sum_price": 402.0, "sum_price2": 40406.0,
    "open": 100.0, "high": 102.0, "low": 99.0, "close": 102.0, "min_size": 0.5, "max_size": 2.0, "first_ts": 1000, "last_ts": 9000,
    "sum_dt": 8000, "max_gap_ms": 6500, "sum_logret": 0.019802627, "sum_logret2": 0.001390235, "sum_logret3": 0.0000195893,
}


@pytest.mark.parametrize("slice_ids", [1, 2, 3, 65_536])
def test_trade_window(spark, slice_ids):
    row = tw.trade_windows(trades(spark), 10_000, slice_ids=slice_ids).first().asDict()
    assert row["window_end_ms"] == 10_000
    for name, value in EXPECTED_WINDOW.items():
        assert row[name] == pytest.approx(value, abs=1e-9), name


def test_trade_window_of_one_trade_and_nonpositive_price(spark):
    row = tw.trade_windows(trades(spark, [(5, "0", "1", 1)]), 10).first()
    assert (row["sum_logret"], row["sum_dt"], row["max_gap_ms"], row["buy_vol"], row["sell_vol"]) == (0.0, 0, 0, 0.0, 1.0)
    row = tw.trade_windows(trades(spark, [(1, "1", "1", 0), (2, "0", "1", 0), (3, "2", "1", 0), (4, "4", "1", 0)]), 10).first()
    assert row["sum_logret"] == pytest.approx(0.6931471805599453)  # only the step from 2 to 4 has two positive prices


BOOK = [
    ("snapshot", 1000, [("50000", "1.5")], [("50100", "2.0")]), ("update", 2000, [("50010", "1.2")], [("50090", "1.8")]),
    ("update", 3000, [("50020", "1.0")], [("50080", "2.2")]), ("snapshot", 4000, [("50030", "3.0")], [("50070", "2.5")]),
    ("update", 5000, [("50040", "1.1")], [("50060", "1.9")]),
]


def book(spark, items=BOOK):
    data = [("kraken", "btc_usdt", i, kind, t, b, a) for i, (kind, t, b, a) in enumerate(items)]
    lv = "array<struct<price:string,qty:string>>"
    df = spark.createDataFrame(data, f"platform string, symbol string, id long, type string, time_ms long, bids {lv}, asks {lv}")
    return df.withColumns({c: ob.decimal_levels(F.col(c)) for c in ("bids", "asks")})


EXPECTED_BOOK = {
    "sw": 5000, "sw_mid": 250250000, "sw_spread": 300000, "spread_min": 20, "spread_max": 100, "n_w": 5000, "mean_mid": 50050, "M2_mid": 0,
    "sw_bid": 7800, "sw_ask": 10400, "sw_bid_best_sz": 7800, "sw_ask_best_sz": 10400, "sw_micro": 250222758.658009, "sw_imb": -893.614719,
    "n_updates": 5, "n_mid_up": 0, "n_mid_down": 0, "n_spread_widen": 0, "n_spread_tighten": 4, "close_mid": 50050, "close_spread": 20,
    "close_bb": 50040, "close_ba": 50060, "close_bq0": 1.1, "close_aq0": 1.9, "close_best_imb": -0.266667, "t_first": 0, "t_last": 5000,
}


@pytest.mark.parametrize("slice_ids", [1, 2, 65_536])
def test_order_window(spark, slice_ids):
    row = ob.order_windows(ob.book_ticks(book(spark)), 10_000, slice_ids=slice_ids).first().asDict()
    for name, value in EXPECTED_BOOK.items():
        assert row[name] == pytest.approx(value, abs=1e-6), name


def test_order_window_closing_prices_of_the_next_tick(spark):
    ticks = ob.book_ticks(book(spark))
    inside = rows(ob.order_windows(ticks, 3000).orderBy("window_end_ms").select("close_bb", "close_mid"))
    following = rows(ob.order_windows(ticks, 3000, close="next").orderBy("window_end_ms").select("close_bb", "close_mid"))
    assert inside == [(50010.0, 50050.0), (50040.0, 50050.0)]
    assert following == [(50020.0, 50050.0), (50040.0, 50050.0)]


def test_book_updates_before_a_snapshot_are_skipped_and_late_ones_dropped(spark):
    items = [("update", 10, [("1", "1")], []), ("snapshot", 25, [("5", "1"), ("4", "1")], [("6", "1")]), ("update", 15, [("5", "9")], []),
             ("update", 27, [("4", "0"), ("3", "2")], [("7", "3")])]
    ticks = ob.book_ticks(ob.drop_late(book(spark, items), 10))
    assert rows(ticks.orderBy("id").select("id", "bb", "bq0", "tot_b", "tot_a", "depth_a")) == [
        (1, 5.0, 1.0, 2.0, 1.0, 1), (3, 5.0, 1.0, 3.0, 1.0, 1)]


def test_kraken_book_messages(spark):
    import json

    def level(ls):
        return [{"price": float(p), "qty": float(q)} for p, q in ls]

    data = [("btc_usdt", i, t, json.dumps({"channel": "book", "type": k, "data": [{"symbol": "X/Y", "bids": level(b), "asks": level(a), "checksum": 1}]}))
            for i, (k, t, b, a) in enumerate(BOOK)]
    out = nz.kraken_books(spark.createDataFrame(data, "symbol string, id long, timestamp long, payload string")).orderBy("id")
    got = rows(out.select("type", "time_ms", F.col("bids")[0]["qty"], F.col("asks")[0]["price"], F.col("asks")[0]["qty"]))
    assert got[0] == ("snapshot", 1000, "1.5", "50100", "2")
    assert [g[0] for g in got] == ["snapshot", "update", "update", "snapshot", "update"]


def test_two_feeds_as_one(spark):
    feed = lambda ids: spark.createDataFrame([("s", i) for i in ids], "symbol string, id long")
    out = rc.merge_trades(feed([2, 2, 4, 7, 10, 10, 11]), feed([1, 2, 4, 8, 8, 11, 13]), KEYS)
    assert [r["id"] for r in out.orderBy("id").collect()] == [1, 2, 4, 7, 8, 10, 11]
    batches = [[("rest", 2), ("rest", 2), ("ws", 1), ("ws", 2)], [("ws", 4)], [("rest", 4), ("ws", 8), ("ws", 8)], [("rest", 7)],
               [("ws", 11), ("rest", 10), ("ws", 13), ("rest", 10)], [("rest", 11)]]
    merge, handle = FeedMergeProcessor(), HandleOfOne()
    merge.init(handle)
    sent = [(i, feed) for batch in batches for i, feed in fed(merge, batch)]
    assert sent == [(1, "ws"), (2, "rest"), (4, "rest"), (7, "rest"), (8, "ws"), (10, "rest"), (11, "ws")] and list(merge.waiting.held) == [13]


def fed(merge, batch):
    import pandas as pd

    table = pd.DataFrame(batch, columns=["feed", "id"])
    cut = len(table) // 2
    chunks = [x for x in (table[:cut], table[cut:]) if len(x)]
    return [(r.id, r.feed) for out in merge.handleInputRows(("p", "s"), iter(chunks), None) for r in out.itertuples()]


def one_by_one(batches):
    """The rule for each id in turn."""
    last, waiting, tops, out, writes = 0, {}, {"rest": -1, "ws": -1}, [], []
    for batch in batches:
        before = dict(waiting)
        for feed, i in batch:
            tops[feed] = max(tops[feed], i)
            if i > last and (i not in waiting or feed == "rest"):
                waiting[i] = feed
        for i in sorted(waiting):
            if i > last + 1 and i > min(tops.values()):
                break
            out.append((i, waiting.pop(i)))
            last = i
        writes.append(sum(waiting.get(i) != before.get(i) for i in {*waiting, *before}))
    return out, waiting, sum(writes)


@pytest.mark.parametrize("seed", range(6))
def test_feeds_merge_by_batches_as_one_by_one(seed):
    rng = random.Random(seed)
    ids = [("rest" if rng.random() < 0.5 else "ws", max(1, n // 2 + rng.randrange(-6, 7))) for n in range(600) if rng.random() < 0.9]
    batches, at = [], 0
    while at < len(ids):
        size = rng.choice((1, 2, 17, 60))
        batches.append(ids[at : at + size])
        at += size
    merge = FeedMergeProcessor()
    merge.init(HandleOfOne())
    got = [x for batch in batches for x in fed(merge, batch)]
    want, waiting, writes = one_by_one(batches)
    assert got == want and {i: "rest" if r else "ws" for i, r in merge.waiting.held.items()} == waiting
    assert merge.waiting.writes == writes  # what waits on is not written again


P = 2491733000
SEQUENCE = [("update", P + 697, P + 738), ("update", P + 739, P + 797), ("update", P + 798, P + 930), ("snapshot", P + 879, P + 879),
            ("update", P + 931, P + 958), ("update", P + 959, P + 1090), ("update", P + 1200, P + 1202), ("snapshot", P + 1098, P + 1098),
            ("update", P + 1099, P + 1102)]


@pytest.mark.parametrize("chunk", [1, 2, 4, 100])
def test_snapshots_and_updates_as_one_sequence(spark, chunk):
    data = [("s", i, *m) for i, m in enumerate(SEQUENCE)]
    df = spark.createDataFrame(data, "symbol string, arrival long, kind string, first_id long, last_id long")
    out = rc.merge_snapshots_updates(df, KEYS, slice_width=chunk, stretches=chunk)
    got = sorted((r["emitted_at"], r["last_id"] - P) for r in out.collect())
    assert got == [(3, 879), (3, 930), (4, 958), (5, 1090), (7, 1098), (8, 1102)]


def ids(spark, values):
    return spark.createDataFrame([("s", v) for v in values], "symbol string, id long")


def test_holes_and_requests(spark):
    holes = rc.id_holes(ids(spark, [300, 1303, 1305]), KEYS)
    assert sorted(rows(holes)) == [("s", 301, 1302, 1002), ("s", 1304, 1304, 1)]
    got = sorted(rows(rc.hole_requests(holes)))
    assert got == [("s", 301 + 100 * i, 100) for i in range(10)] + [("s", 1301, 2), ("s", 1304, 1)]
    assert rows(rc.id_holes(ids(spark, [5000, 5500, 5501]), KEYS)) == [("s", 5001, 5499, 499)]
    covered = spark.createDataFrame([("s", 1000)], "symbol string, last_id long")
    assert sorted(rows(rc.id_holes(ids(spark, [300, 1303, 1305]), KEYS, covered))) == [("s", 1001, 1302, 302), ("s", 1304, 1304, 1)]


def test_only_rows_after_the_processed_one(spark):
    log = spark.createDataFrame([("s", i) for i in range(1, 6)], "symbol string, id long")
    state = spark.createDataFrame([("s", 3)], "symbol string, last_processed_id long")
    assert [r["id"] for r in nz.skip_processed(log, state, KEYS).orderBy("id").collect()] == [4, 5]


def test_directory_stats(spark, tmp_path):
    for name in ("api_v3_depth/BTCUSDT/data.jsonl", "api_v3_depth/ETHUSDT/data.jsonl", "api_v3_historicalTrades/BTCUSDT/0.jsonl"):
        path = tmp_path / "binance" / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_text("x" * 11)
    (tmp_path / "other.txt").write_text("abc")
    got = rows(lg.directory_stats(spark, str(tmp_path), ["binance/**"]).orderBy("directory").select("directory", "file_count", "size_bytes"))
    assert got == [("", 1, 3), ("binance/api_v3_depth", 2, 22), ("binance/api_v3_historicalTrades", 1, 11)]


def test_names(spark):
    df = spark.createDataFrame([("kraken::orderbook",), ("path\\to\\data",), ("a__b__c",), ("___test___",)], "x string")
    assert [r[0] for r in df.select(tx.normalize_name(F.col("x"))).collect()] == ["kraken_orderbook", "path_to_data", "a_b_c", "test"]


def test_numbers_as_text(spark):
    df = spark.createDataFrame([("2.0",), ("1e-7",), ("50010.10",), ("1.0E8",), ("100",)], "x string")
    assert [r[0] for r in df.select(tx.number_text(F.col("x"))).collect()] == ["2", "0.0000001", "50010.1", "100000000", "100"]


def test_percent_keys(spark):
    values = [0.001, 0.14, 0.13999, 0.0009, 0.1, 0.0, 0.123456]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    assert [r[0] for r in df.select(ft.pct_key_column(F.col("p"))).collect()] == [ft.pct_key(v) for v in values]
    assert [ft.pct_key(v) for v in values] == ["0.1", "14", "13.999", "0.09", "1", "0", "12.346"]


def test_nearest_rank_quantiles(spark):
    df = spark.createDataFrame([("k", float(v), 1) for v in range(1, 12)], "k string, v double, n int")
    got = {r["quantile"]: r["v"] for r in ft.nearest_rank(df, ["k"], "v", [0.0, 0.2, 0.25, 0.95, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.2: 3.0, 0.25: 4.0, 0.95: 11.0, 1.0: 11.0}


def test_votes_and_ranges(spark):
    votes = spark.createDataFrame([("a", 1, .8), ("a", 1, .9), ("a", 0, .7), ("b", 1, .5), ("b", 0, .6)], "k string, prediction int, precision double")
    got = {r["k"]: (r["prediction"], r["confidence"], r["agreement"]) for r in pr.majority_vote(votes, ["k"]).collect()}
    assert got["a"] == (1, pytest.approx(.85), pytest.approx(2 / 3)) and got["b"] == (0, pytest.approx(.6), .5)
    p = spark.createDataFrame([("k", f"target_high_up_{t}p", 0, 0.0, 1.0, hit, 0.7, 0.9) for t, hit in (("0.02", 1), ("0.09", 1), ("0.29", 0))],
                              "k string, target_name string, neg_prediction int, neg_confidence double, neg_model_agreement double, "
                              "pos_prediction int, pos_confidence double, pos_model_agreement double")
    row = pr.summarize(p, ["k"]).first()
    assert (row["high_up_low"], row["high_up_high"], row["high_direction"], row["low_direction"]) == (0.02, 0.29, "up", "stable")
    assert row["high_confidence"] == pytest.approx(0.7) and row["low_confidence"] == 0.0


def test_two_open_windows():
    handler, state, sent = TwoWindowHandler(10), None, []
    for i, t in enumerate([25, 3, 27, 12, 38, 4]):  # an older window becomes the next one; 4 lies before both and is dropped
        state, out = handler(state, {"platform": "p", "symbol": "s", "time_ms": t, "price": "1", "quantity": "1", "side": 0, "platform_trade_id": i})
        sent += [(o["window_end_ms"], o["trade_count"]) for o in out]
    assert sent == [(30, 2), (10, 1)]
    assert (state["current"]["start"], state["next"]["start"]) == (10, 30)


def test_errors(spark):
    bad = spark.createDataFrame([("s", 1, 1, '{"request":{"query":{}},"response":{"lastUpdateId":1,"bids":[],"asks":[]}}')],
                                "symbol string, id long, timestamp long, payload string")
    with pytest.raises(Exception, match="needs the requested symbol"):
        nz.binance_snapshots(bad).collect()
    keys = spark.createDataFrame([("s", '{"response":{"result":{"A":[],"B":[],"last":"1"}}}')], "symbol string, payload string")
    with pytest.raises(Exception, match="too many keys"):
        nz.kraken_rest_trades(keys).collect()
    with pytest.raises(KeyError):
        ft.feature_groups(["0_t_close"], [0])


def test_zscores_and_lags_beside_values_that_are_not_finite(spark):
    import math
    import statistics

    from ticklattice.operators import transforms as tf

    inf, nan = float("inf"), float("nan")
    values = [nan, inf, *[float(i * i % 7) for i in range(2, 16)], inf, 2.0, 3.0, 5.0]
    rows = [("k", "s", 1000, i * 1000, x) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "platform string, symbol string, window_size_ms long, window_end_ms long, x double")
    split = tf.chrono_split(df, test_size=0.5)
    got = {r["row"]: r["x"] for r in tf.zscore(split, ["x"]).select("row", "x").collect()}
    for i in range(20):
        frame = values[:10] if i < 10 else values[i - 9:i + 1]
        if all(map(math.isfinite, frame)):
            assert abs(got[i] - (values[i] - statistics.fmean(frame)) / statistics.pstdev(frame)) < 1e-9
        else:
            assert math.isnan(got[i])
    assert sum(map(math.isfinite, got.values())) == 5
    signs = {r["row"]: r["x__diff_2"] for r in tf.lag_features(split.select(*tf.KEYS, "row", "x"), ["x"], "diff", lags=[2], keep=True).collect()}
    assert signs[0] == 0 and signs[2] == 0 and signs[3] == 1 and signs[16] == -1


def test_flat_features_are_finite(spark):
    from ticklattice.operators.features import flatten_features

    df = spark.sql("SELECT struct(double('NaN') AS sum_logret, double('-Infinity') AS close, 3D AS high) AS `0_trade_features`, struct(double('Infinity') AS spread_min) AS `0_order_features`")
    row = flatten_features(df, [0], trade_fields={"sum_logret": 0.0, "close": 1.0, "high": 0.0}, order_fields={"spread_min": 0.0}).first()
    assert list(row) == [0.0, 1.0, 3.0, 0.0]


def _zero_price_trades(spark):
    prices = ["2", "0", "4", "0", "0", "5", "5", "6", "7", "0"]
    rows = [("k", "s", i, i // 2 * 1000 + i % 2, p, "1", 0) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "platform string, symbol string, platform_trade_id long, time_ms long, price string, quantity string, side int")


def test_returns_to_and_from_a_price_of_0_are_infinite_in_batch_and_stream(spark):
    from ticklattice.operators.trade_windows import trade_windows
    from ticklattice.streaming import processors, runner

    t = _zero_price_trades(spark)
    show = lambda df: {r["window_end_ms"]: [str(r[f]) for f in ("sum_logret", "sum_logret2", "sum_logret3")] for r in df.collect()}
    want = {1000: ["-inf", "inf", "-inf"], 2000: ["-inf", "inf", "-inf"], 3000: ["inf", "inf", "inf"], 5000: ["-inf", "inf", "-inf"]}
    for slice_ids in (65_536, 1):  # inside a slice and between slices
        got = show(trade_windows(t, 1000, slice_ids=slice_ids))
        assert {k: got[k] for k in want} == want
    both = show(trade_windows(t, 2000))
    assert both[2000] == ["nan", "inf", "nan"]
    got = show(runner.run_in_parts([t], lambda s: processors.two_window_stream(s, 2000), "zero"))
    assert got == {2000: both[2000]}  # the last two windows are still open


def test_moves_from_0_are_infinite_or_no_number(spark):
    df = spark.sql("SELECT * FROM VALUES (0D, 3D), (0D, 0D), (2D, 1D) AS t(a, b)").select(
        F.struct(F.col("a").alias("high"), F.col("a").alias("low"), F.col("a").alias("close")).alias("first_past_features"),
        F.struct(F.col("b").alias("high"), F.col("b").alias("low"), F.col("b").alias("close")).alias("relaxed_target"))
    rules = ft.pct_rules([0.5], [-0.2])
    out = ft.add_targets(df, rules).select("target_high_up_5p", "target_low_down_2p")
    assert rows(out) == [(True, False), (True, False), (False, True)]  # as in SQL, where no number is above all others
    keyed = df.select(F.lit("k").alias("platform"), F.lit("s").alias("symbol"), F.lit(1).alias("window_size_ms"), F.lit(1).alias("window_end_ms"), "*")
    found = ft.pct_quantiles(keyed, quantiles=(0.0, 1.0)).orderBy("direction", "quantile").select("direction", "quantile", F.col("value").cast("string"))
    assert rows(found) == [("down", 0.0, "-0.5"), ("down", 1.0, "-0.5"), ("up", 0.0, "Infinity"), ("up", 1.0, "NaN")]
    named = ft.pct_targets_long(keyed, ft.round_thresholds(ft.pct_quantiles(keyed, quantiles=(0.0,))))
    assert {r["target_name"] for r in named.collect()} == {f"target_{f}_{d}" for f in ("high", "low") for d in ("down_5p", "up_Infinityp")}


def test_a_windows_sums_are_added_in_order_of_id(spark):
    data = [("k", "s", i, 1, p, q, 0) for i, p, q in ((0, "0.1", "0.1"), (70_000, "0.2", "0.2"), (70_001, "0.3", "0.3"))]
    t = spark.createDataFrame(data, "platform string, symbol string, platform_trade_id long, time_ms long, price string, quantity string, side int")
    row = tw.trade_windows(t, 10).first()
    assert [row[f] for f in ("sum_vol", "buy_vol", "sum_price")] == [0.1 + 0.2 + 0.3] * 3 != [0.1 + (0.2 + 0.3)] * 3


def test_samples_of_one_time_are_no_restarts(spark):
    from ticklattice.operators import metrics as mx

    samples = spark.createDataFrame([("a", 10, 4.0), ("a", 10, 3.0), ("a", 10, 2.0), ("a", 5, 1.0)], "k string, ts long, value double").coalesce(1)
    assert rows(mx.rate(samples, ["k"], 1000, 1000)) == [("a", 1000, 3.0)]  # per second, over one second
