"""Filter interactions, packing and manifests against brute force on small tables with odd rows, and on empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklattice.llm import merkle, packing
from ticklattice.llm.filter_audit import filter_interactions, filter_steps
from ticklattice.llm.merkle import fold, leaf_digest, manifest, proof_digest
from ticklattice.llm.packing import ByteEncoder, Stretch, apportioned, pack, plan, sequences
from ticklattice.llm.queries import BYTE_TOKENIZER, LEAF, corpus_filters

CLASH = ("part", "mask", "id", "n", "good", "key", "leaf", "pos", "block", "root", "queue", "start", "ids", "claimed")


# filters


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {k for k, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t),
                                              i is not None and first[t] < i)) if bad}
        docs[part or ""].append((fails, i in good, i in toxic))
    out = Counter()
    for part, mine in docs.items():
        removals, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = set(order[:step])
                gone = [d for d in mine if letter in d[0] and not d[0] & before]
                kept = sum(not d[0] & (before | {letter}) for d in mine)
                redundant = sum(letter in d[0] and bool(d[0] & before) for d in mine)
                lines.append((part, "".join(order), step + 1, letter, kept, len(gone), redundant, sum(d[0] == {letter} for d in mine), sum(d[1] for d in gone), sum(d[2] for d in gone)))
                removals[letter] += len(gone)
        out.update((*line, removals[line[3]]) for line in lines)
    return out


def test_filter_interactions(spark, make_docs, odd_rows):
    r = random.Random(1)
    rows = list(odd_rows)
    for i in range(60):
        text = " ".join(f"{r.choice('abcABC#')}{r.randrange(r.choice((4, 400)))}" for _ in range(r.choice((20, 150, 300))))
        rows += [(100 + i + 1000 * k, text) for k in range(r.choice((1, 1, 2, 4)))]
    docs = make_docs(rows, extra=CLASH).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, ""))
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1))) for i, _ in rows if r.random() < 0.7] + [(None, 1, 1), (105, 0, 0), (105, 1, 1)]
    got = filter_interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), corpus_filters(F.col("text")), copies="E")
    parts = [(i, t, None if i is None else {0: "x", 1: ""}.get(i % 3)) for i, t in rows]
    assert Counter(tuple(x) for x in got.collect()) == brute_audit(parts, labels)


def test_filter_interactions_of_nothing_and_of_one_filter(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_interactions(make_docs([]), none, corpus_filters(F.col("text")), copies="E").count() == 0
    rows = filter_interactions(make_docs([(1, "a"), (2, "a"), (3, None)]), none, {}, copies="Z").collect()
    assert [(x.part, x.filter_order, x.step, x.kept, x.removed, x.shapley) for x in rows] == [("s", "Z", 1, 2, 1, 1)]
    assert filter_interactions(make_docs([(1, "a"), (2, "a")]), none, {"Q": F.lit(None).cast("boolean")}).first().kept == 2
    with pytest.raises(ValueError):
        filter_interactions(make_docs([]), none, {"AB": F.lit(True)})


def test_steps_of_the_recursion_are_bounded_by_the_filters(spark):
    masks = spark.range(32).select(F.col("id").cast("int").alias("mask"))
    steps = filter_steps(masks, {c: 1 << i for i, c in enumerate("ABCDE")})
    assert steps.count() == 32 * (5 + 20 + 60 + 120 + 120)
    assert steps.where("stays and (goes or gone)").count() == 0


# packing


def sequential_rounds(totals, shares, window):
    """Rounds one by one, with deficits carried from each to the next while no queue runs dry in it."""
    credits = apportioned(window * packing.UNIT, shares)
    deficit, left, out = [0] * len(totals), list(totals), []
    while True:
        owed, served, window_counts = 0, 0, []
        for j, c in enumerate(credits):
            deficit[j] += c
            owed += deficit[j]
            give = owed // packing.UNIT - served
            served += give
            window_counts.append(give)
        if any(g > r for g, r in zip(window_counts, left)):
            return out
        for j, g in enumerate(window_counts):
            deficit[j] -= g * packing.UNIT
            left[j] -= g
            assert abs(deficit[j]) < packing.UNIT
        out.append(window_counts)


@pytest.mark.parametrize("totals, shares", [([9000, 4000, 777], [0.5, 0.2, 0.3]), ([10_000, 10_000, 3], [0.61803, 0.38, 0.00197]), ([5000], [1.0]), ([40_000, 90, 5000, 20], [0.9, 0.05, 0.049, 0.001])])
def test_the_state_after_many_rounds_is_that_of_single_rounds(totals, shares):
    window = 128
    stretches = plan(totals, shares, window)
    want, s = sequential_rounds(totals, shares, window), stretches[0]
    for k in range(min(s.n, len(want))):
        assert [s.given(j, k + 1) - s.given(j, k) for j in range(len(totals))] == want[k], k
    filled = [sum(s.given(j, k + 1) - s.given(j, k) for j in range(len(totals))) for s in stretches for k in range(s.n)]
    assert sum(filled) == sum(totals) and all(f == window for f in filled[:-1]) and 0 < filled[-1] <= window
    assert [sum(s.given(j, s.n) for s in stretches) for j in range(len(totals))] == totals


def test_rounds_stay_exact_over_billions_of_windows():
    s = Stretch(0, 1 << 33, (0, 0), (0, 7 * packing.UNIT + 13, 2048 * packing.UNIT))
    for token in (0, 12345678901, 55 * 10**9):
        k = s.round_of(0, token)
        assert s.given(0, k) <= token < s.given(0, k + 1)
    rounds = np.array([(1 << 33) - 1], np.int64)
    assert int(s.given(1, rounds)[0]) == s.given(1, (1 << 33) - 1) > 0


def unpacked(pieces, encode, rows, window):
    """Checks that the pieces hold each document's ids once, and gives the tokens of each document in each sequence."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        by_doc[p.doc_id].append((p.start, p.doc_tokens, ids))
        by_sequence[p.sequence_id].append((p.offset, p.length, p.doc_id))
    want = defaultdict(Counter)
    for i, t in rows:
        want[i][tuple(np.frombuffer(encode([t or ""])[0], "<u2").tolist() + [1])] += 1
    for i, texts in want.items():
        if sum(texts.values()) == 1:
            ((ids, _),) = texts.items()
            got = sorted(by_doc[i])
            assert sum((x for _, _, x in got), []) == list(ids) and all(n == len(ids) for _, n, _ in got)
            assert [s for s, _, _ in got] == [sum(len(x) for _, _, x in got[:k]) for k in range(len(got))]
        else:
            assert sum(len(x) for _, _, x in by_doc[i]) == sum(len(ids) * c for ids, c in texts.items())
    assert set(by_doc) == set(want) and sorted(by_sequence) == list(range(len(by_sequence)))
    for k, parts in by_sequence.items():
        end = 0
        for offset, length, _ in sorted(parts, key=lambda x: x[:2]):
            assert offset == end
            end += length
        assert end == window or k == len(by_sequence) - 1
    return by_sequence


@pytest.mark.parametrize("shares", [None, {"a": 0.5, "b": 0.25}, {"nobody": 1.0}, {"a": 3.0, "c": 1.0}])
def test_packing(make_docs, odd_rows, shares):
    r = random.Random(4)
    rows = odd_rows + [(100 + i, " ".join(f"w{r.randrange(500)}" for _ in range(r.choice((1, 30, 200))))) for i in range(150)]
    source = lambda i: None if i is None else "abbbbc"[i % 6]
    docs = make_docs(rows, extra=CLASH).withColumn("source", F.element_at(F.array(*[F.lit(c) for c in "abbbbc"]), (F.col("doc_id") % 6 + 1).cast("int")))
    encoder = lambda: ByteEncoder(BYTE_TOKENIZER)
    pieces = pack(docs, encoder, end_id=1, window=256, shares=shares).collect()
    by_sequence = unpacked(pieces, encoder(), rows, 256)
    totals = Counter()
    for parts in by_sequence.values():
        for _, length, i in parts:
            totals[source(i)] += length
    if shares is None:  # each source has its share of each window but the last ones, in which queues run dry
        whole = sum(totals.values())
        for k in range(len(by_sequence) - 8):
            mine = Counter()
            for _, length, i in by_sequence[k]:
                mine[source(i)] += length
            assert all(abs(mine[s] - 256 * n / whole) < 2 for s, n in totals.items() if 256 * n / whole >= packing.GRAIN)
    elif "b" in shares:
        mine = Counter()
        for _, length, i in by_sequence[0]:
            mine[source(i)] += length
        assert mine["a"] == 128 and mine["b"] == 64


def test_many_small_sources_share_a_queue(make_docs):
    rows = [(i, f"text {i}") for i in range(600)]
    docs = make_docs(rows).withColumn("source", (F.col("doc_id") % 300).cast("string"))
    encoder = lambda: ByteEncoder(BYTE_TOKENIZER)
    unpacked(pack(docs, encoder, end_id=1, window=64).collect(), encoder(), rows, 64)


def test_sequences_are_padded_but_for_powers_of_two(make_docs):
    docs = make_docs([(i, "one two three " * 9) for i in range(7)])
    pieces = pack(docs, lambda: ByteEncoder(BYTE_TOKENIZER), end_id=1, window=64)
    out = sorted((x.sequence_id, x.n_tokens, len(x.token_ids)) for x in sequences(pieces, window=64, pad_id=9).collect())
    assert sum(n for _, n, _ in out) == pieces.agg(F.sum("length")).first()[0] and all(size in (n, 64) and (size == n) == (n & (n - 1) == 0) for _, n, size in out)


def test_packing_nothing(make_docs):
    assert pack(make_docs([]), lambda: ByteEncoder(BYTE_TOKENIZER), end_id=1).count() == 0
    assert [x.length for x in pack(make_docs([(1, None)]), lambda: ByteEncoder(BYTE_TOKENIZER), end_id=1).collect()] == [1]


def test_ids_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(BYTE_TOKENIZER), ByteEncoder(BYTE_TOKENIZER)
    whole.encode_special_tokens = True
    texts = ["", " ", "  ", "a  b", " a ", "\n\t\r x \n\n y", "it's 'S  's", "é  x y　 z", "\x1c\x1d a\x1fb", "x<|endoftext|>y  <|endoftext|> ", "你好  🙂🙂", "\x85\x0b\x0c.", "a" * 3000, "!?  ...\n", "a b\nc d\n", "x\ny ", " z\t"]
    r = random.Random(7)
    assert len({encode.common(t) is None for t in texts}) == 2
    texts += ["".join(r.choices("ab1'sé.\n\t   🙂\x1c", k=40)) for _ in range(500)]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t, raw in zip(texts, encode(texts)):
        assert np.frombuffer(raw, "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


# manifests


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves, fanout):
    nodes, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for p, i in zip(proofs, at):
            start = i - i % fanout
            p.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + fanout])))
        nodes, at = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)], [i // fanout for i in at]
    return nodes[0], proofs


def brute_manifest(rows, fanout=8):
    """``rows`` have (doc_id, source, lang, n_chars, text); the leaves are in order of identifier and digest."""
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, digest("".join(map(framed, row))), row))
    order, roots, out = sorted(groups, key=lambda g: (g is not None, (g or "").encode())), [], []
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = brute_tree([x[2] for x in groups[g]], fanout)
        roots.append(trees[g][0])
    root, tops = brute_tree(roots, fanout)
    for g, top in zip(order, tops):
        for x, proof in zip(groups[g], trees[g][1]):
            out.append((x[3], x[2], trees[g][0], root, tuple(proof + top)))
    return out


@pytest.mark.parametrize("fanout, levels, sizes", [(2, 1, (1, 2, 3, 21, 32, 33)), (3, 1, (1, 9, 10, 55)), (3, 2, (90, 8)), (8, 1, (70, 8, 9)), (8, 4, (40, 1)), (2, 2, (1,) * 9)])
def test_manifest(make_docs, odd_rows, fanout, levels, sizes):
    rows, n = list(odd_rows), 100
    langs = [None, "", "é", "en", "zz", "a", "b", "c", "d"]
    of = {}
    for g, size in zip(langs, sizes):
        for _ in range(size):
            rows.append((n, f"Text {n}"))
            of[n] = g
            n += 1
    docs = make_docs(rows, extra=CLASH)
    for g in {g for g in of.values() if g is not None}:
        docs = docs.withColumn("lang", F.when(F.col("doc_id").isin([i for i, x in of.items() if x == g]), g).otherwise(F.col("lang")))
    got = manifest(docs, fields=LEAF, fanout=fanout, levels=levels).collect()
    want = brute_manifest([(i, "s", of.get(i), None, t) for i, t in rows], fanout)
    shown = lambda p: tuple((s["before"], s["after"]) for s in p)
    assert Counter((x.doc_id, x.leaf, x.subroot, x.root, shown(x.proof)) for x in got) == Counter((r[0], leaf, sub, root, p) for r, leaf, sub, root, p in want)


def test_proofs_lead_to_the_root_and_tampering_shows(make_docs):
    rows = [(i, f"Text {i}" if i % 2 else "small") for i in range(300)]
    docs = make_docs(rows)
    small = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    out = manifest(docs, fields=LEAF, claimed=leaf_digest([*map(F.col, LEAF[:-1]), small]), fanout=4, levels=2)
    out = out.select("doc_id", "root", fold(F.col("leaf"), F.col("proof")).alias("own"), fold(F.col("claimed"), F.col("proof")).alias("other"), proof_digest(F.col("proof")).alias("p"), "proof").collect()
    for x in out:
        assert x.own == x.root and (x.other == x.root) == (x.doc_id % 6 != 3)
        assert x.p == digest("".join(s.before + s.after for s in x.proof))


def test_many_groups_and_no_rows(make_docs):
    docs = make_docs([(i, "t") for i in range(100)]).withColumn("lang", (F.col("doc_id") % 50).cast("string"))
    got = manifest(docs, fields=LEAF, fanout=3, levels=1)
    want = brute_manifest([(i, "s", str(i % 50), None, "t") for i in range(100)], 3)
    assert {(x.doc_id, x.subroot, x.root) for x in got.collect()} == {(r[0], sub, root) for r, _, sub, root, _ in want}
    assert manifest(make_docs([]), fields=LEAF).count() == 0


def test_a_block_asks_no_one_below_for_its_proof(make_docs, monkeypatch):
    """Rounds of the exchange are as many as digits of the number of blocks; nothing is stored of a way down."""
    labels = []
    real = merkle.stored
    monkeypatch.setattr(merkle, "stored", lambda df, label: labels.append(label) or real(df, label))
    manifest(make_docs([(i, "t") for i in range(200)]), fields=LEAF, fanout=4, levels=1).count()
    assert labels.count("butterfly") == 3  # 50 blocks


def test_crc_of_query_is_unsigned(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"\x01\x00\x00\x00"))).first()[0] == zlib.crc32(b"\x01\x00\x00\x00")


def test_stored_blocks_hold_a_leaf_a_row(spark):
    """A stored row is a few kilobytes at most, whatever a block holds: Parquet buffers rows by the hundred and reads them by the thousand."""
    leaves = spark.range(5000).select(F.lit("=a").alias("key"), F.col("id").alias("ord"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.struct("id").alias("payload"))
    blocks, _ = merkle._tree(leaves, 8, 4)
    assert blocks.agg(F.max(F.length(F.to_json(F.struct(*blocks.columns))))).first()[0] < 5000
    assert blocks.count() == 5000 and blocks.where("first").count() == 2
