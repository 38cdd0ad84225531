"""Operators against brute force on small tables with odd rows, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ticklattice.llm.common import components
from ticklattice.llm.decontamination import contamination, drop_contaminated
from ticklattice.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from ticklattice.llm.jaccard_join import drop_near_duplicates, similar_documents
from ticklattice.llm.sharding import shards, write_shards

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(df):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


# exact copies


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(make_docs, odd_rows, keep):
    best, groups = {"smallest": min, "largest": max}[keep], defaultdict(list)
    for i, t in odd_rows:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        stays, seen = best(real) if real else None, set()
        for i in ids:
            want[i, stays, len(ids), i == stays and i not in seen, hashlib.sha256(t.encode()).hexdigest()] += 1
            seen.add(i)
    assert bag(exact_duplicates(make_docs(odd_rows), keep=keep, nodes=8, fan_in=2)) == want
    assert bag(exact_duplicates(make_docs(odd_rows), keep=keep, nodes=27, fan_in=5)) == want


def test_rows_go_by_identifier_and_text_whatever_columns_are_called(spark, make_docs):
    clash = ("_id", "_digest", "_sha", "c", "n", "gone_id", "GONE_ID_", "kept_id", "kept_digest", "i", "toxic", "class_id")
    rows = [(1, "x"), (2, "x"), (3, "y"), (3, "x"), (3, "y"), (4, "z"), (None, "z"), (5, None), (6, ""), (None, "w")]
    docs = make_docs(rows, extra=clash)
    left = drop_exact_duplicates(docs, keep="largest")
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(3, "x"), (3, "y"), (4, "z"), (6, ""), (None, "w")])
    items = spark.createDataFrame([(1, "z")], "item_id long, text string")
    for out in (drop_contaminated(docs, items), drop_near_duplicates(docs)):
        assert out.columns == docs.columns
    assert drop_contaminated(docs, items).count() == 7  # both identifiers with z, the null one with all its rows


def test_dropping_exact_duplicates_keeps_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    left = drop_exact_duplicates(docs, keep="largest")
    assert left.columns == docs.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t in odd_rows})


# shards


def test_shards(make_docs, odd_rows):
    rows = odd_rows + [(i, f"text {i}") for i in range(100, 1500)]
    got = shards(make_docs(rows), 24).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add((t or "").encode())
    slots = defaultdict(list)
    for r in got:
        assert any(r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t) for t in texts[r.doc_id])
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.doc_id: r.shard for r in got if r.doc_id} == {r.doc_id: r.shard for r in shards(make_docs(rows[::-1]), 24).collect() if r.doc_id}
    grown = {r.doc_id: r.shard for r in shards(make_docs(rows), 25).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)


def test_shards_are_those_of_recomputed_draws(make_docs):
    import math
    import struct

    import xxhash

    weights = [1.0, 2.5, 0.5, 1.0]

    def draw(key, shard, weight):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=seed) >> 11) + 0.5) * 2.0**-53
        return weight / -math.log(u)

    keys = [*range(-5, 400), 2**62, None]
    got = {r.doc_id: (r.shard, r.grown_shard) for r in shards(make_docs([(k, "t") for k in keys]), weights=weights).collect()}
    for k in keys:
        draws = [draw(k, s, w) for s, w in enumerate([*weights, 1.0])]
        assert got[k] == (max(range(4), key=lambda s: draws[s]), max(range(5), key=lambda s: draws[s])), k


def test_shard_weights(make_docs):
    got = Counter(r.shard for r in shards(make_docs([(i, "") for i in range(4000)]), weights=[1, 2, 5]).collect())
    assert abs(got[0] - 500) < 100 and abs(got[1] - 1000) < 130 and abs(got[2] - 2500) < 160


def test_written_shards_hold_every_row(spark, make_docs, odd_rows, tmp_path):
    docs = make_docs(odd_rows)
    write_shards(docs, str(tmp_path / "out"), [1.0, 1.0, 1.0])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert bag(back.select(docs.columns)) == bag(docs)


# contamination


def brute_contamination(rows, items, span):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(SMALL))
        n = min(span, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(item)
    out, hit, owners = Counter(), defaultdict(dict), defaultdict(set)
    for i, text in rows:
        w = WORD.findall((text or "").translate(SMALL))
        marks = set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    marks.update(range(a, a + n))
                    owners[i] |= {str(x) for x in found if x is not None}
        out[i, len(w), len(marks), tuple(sorted(owners[i]))] += 1
    return out


@pytest.mark.parametrize("span", [10, 4])
def test_contamination(spark, make_docs, odd_rows, span):
    r = random.Random(span)
    words = [f"b{i}" for i in range(12)]
    items = [(n, " ".join(r.choices(words, k=r.randint(1, 25)))) for n in range(12)] + [(50, None), (51, ""), (52, "?!"), (53, "É ñ Ñ x"), (54, "ha " * 11), (55, "ha HA ha")]
    rows = [x for x in odd_rows if x[0] not in (9, None)]
    for n in range(60):
        text = r.choices(words, k=r.randint(0, 60))
        if n % 2:
            text[5:5] = (r.choice(items)[1] or "").upper().split()
        rows.append((100 + n, ", ".join(text)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((x.doc_id, x.n_words, x.n_hit, tuple(x.item_ids)) for x in contamination(make_docs(rows), table, span=span).collect())
    want = brute_contamination(rows, items, span)
    assert got == want
    docs = make_docs(rows)
    assert sorted(x.doc_id for x in drop_contaminated(docs, table, span=span).collect()) == sorted(i for i, _, h, _ in want if not h)


def test_nothing_is_contaminated_by_an_empty_benchmark(spark, make_docs, odd_rows):
    got = contamination(make_docs(odd_rows), spark.createDataFrame([], "item_id long, text string"))
    assert got.count() == len(odd_rows) and got.where("contaminated or n_hit > 0 or n_items > 0").count() == 0


# similarity join


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[i] = frozenset(tuple(w[a : a + n]) for a in range(len(w) - n + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(r, words, share):
    return [f"e{r.random():.9f}" if r.random() < share else w for w in words]


@pytest.mark.parametrize("k, percent, common", [(3, 90, 16), (5, 80, 16), (3, 90, 1), (5, 80, 1), (1, 80, 2)])
def test_components_of_similar_documents(make_docs, odd_rows, k, percent, common):
    """``common=1`` sends nearly all similar documents through the blocks."""
    r = random.Random(k * percent + common)
    rows = [x for x in odd_rows if x[0] not in (9, None, 7, 8)]
    line = [f"l{i}" for i in range(12)]
    for base in range(12):
        words = [f"v{r.randrange(3000)}" for _ in range(r.choice((3, 8, 30, 120, 300)))]
        for copy in range(r.choice((1, 2, 5, 40))):
            text = edited(r, words, r.choice((0, 0.005, 0.02, 0.05)))
            rows.append((100 + 50 * base + copy, " ".join(text + line * (copy % 2))))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similar_documents(make_docs(rows), shingle=k, percent=percent, common=common).collect()}
    want = brute_components(rows, k, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_large_group_of_near_copies_in_several_blocks(make_docs, monkeypatch):
    from ticklattice.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    r = random.Random(5)
    words = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join(edited(r, words, 0.012))) for i in range(120)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similar_documents(make_docs(rows)).collect()}
    assert got == brute_components(rows, 3, 90)


def test_texts_of_one_identifier_are_linked(make_docs, monkeypatch):
    from ticklattice.llm import jaccard_join

    r = random.Random(9)
    a, b, c = (" ".join(f"{k}{r.randrange(9000)}" for _ in range(200)) for k in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b + " one"), (10, c), (11, b + " two"), (20, a + " x"), (20, c), (21, a + " x"), (30, "s t u"), (31, "v w x"), (32, "s t u"), (32, "v w x"), (None, a)]
    got = {(x.doc_id, x.component_id) for x in similar_documents(make_docs(rows)).collect()}
    assert got == {(i, 3) for i in (3, 5, 7, 10, 11, 20, 21, None)} - {(None, 3)} | {(None, 3)} | {(i, 30) for i in (30, 31, 32)}


def test_tokens_in_a_third_of_all_texts_are_spread_and_linked(make_docs, monkeypatch):
    from ticklattice.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "SALTS", 3)
    r, line = random.Random(6), [f"l{i}" for i in range(14)]
    rows = [(i, " ".join(([f"u{i}"] if i % 3 else line + [f"x{i // 60}"]) + [f"v{r.randrange(50)}" for _ in range(i % 2)])) for i in range(300)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similar_documents(make_docs(rows), percent=80).collect()}
    assert got == brute_components(rows, 3, 80)


def test_near_duplicates_leave_one_of_each_group(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = Counter(x.doc_id for x in left.collect())
    assert ids == Counter({1: 1, 2: 1, 3: 1, 4: 1, 6: 1, None: 1, 7: 1, 10: 1, 11: 1, 12: 1, 13: 1, 14: 1})


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_blocks_of_sets_take_little_memory_beyond_their_tokens():
    import tracemalloc

    import numpy as np

    from ticklattice.llm.jaccard_join import _overlaps

    rng = np.random.default_rng(1)
    make = lambda n, size, of: [np.unique(rng.integers(0, of, size).astype(np.uint64)) for _ in range(n)]
    left, right = make(9, 40, 300), make(7, 50, 300)
    assert _overlaps(left, right, 16).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    left, right = make(256, 2000, 1 << 60), make(256, 2000, 1 << 60)
    tracemalloc.start()
    _overlaps(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * 512 * 2000, peak / 512 / 2000  # bytes a token


def test_near_duplicates_send_texts_a_few_at_a_time(spark, make_docs, monkeypatch):
    from ticklattice.llm import jaccard_join

    name, seen, stored = "spark.sql.execution.arrow.maxRecordsPerBatch", [], jaccard_join.stored
    before = spark.conf.get(name)
    monkeypatch.setattr(jaccard_join, "stored", lambda *a: seen.append(int(spark.conf.get(name))) or stored(*a))
    drop_near_duplicates(make_docs([(1, "a b c d e f"), (2, "a b c d e f")]))
    assert seen and max(seen) <= 512 and spark.conf.get(name) == before


@pytest.mark.parametrize("operator", [exact_duplicates, similar_documents, lambda d: shards(d, 24), drop_near_duplicates, drop_exact_duplicates])
def test_empty_tables_give_no_rows(make_docs, operator):
    assert operator(make_docs([])).count() == 0
