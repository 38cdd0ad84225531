"""Scores of texts by a hashed maximum-entropy model with a class-factored softmax.

Every word belongs to a cell (k, j): a class k and a member j of it. The most frequent words have cells of their own; all
others share the remaining ones by how they end and begin. A text's probability is the product over its tokens of

    P(class | history) * P(member | class, history) * P(word | cell)

The first two are softmaxes over sums of weight rows picked by hashed features of the history: a bias, the word before, the
word before that (skips), and the cells of the three tokens before. The third is the word's smoothed share of its cell, with
one place for unseen words in each cell, so the probabilities of all words and unseen places add up to one.

Texts are cut into words once, into blocks of some thousand texts, in which words are numbers; only a block's distinct
words are shuffled, to count the corpus and to bring the counts back. Weights start from counted features, as each
feature alone would have them, and are then improved by distributed gradient rounds: each task goes over its blocks of
training texts in small steps, and the new weights are the tasks' mean.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklattice.llm.common import WordCutter, chunks, mixed, text_bytes
from ticklattice.session import stored

CLASSES, MEMBERS = 32, 16
CELLS = CLASSES * MEMBERS
#: The first cells hold one frequent word each.
HEAD = CELLS // 2
BUCKETS = 1 << 13
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # the end of a text; no word is a line feed
BLOCK_BYTES = 32_000_000
PART_TOKENS = 32_000
#: So many tokens' sums at a time stay in a core's own cache.
RUN_TOKENS = 2_000
_PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?\"')&%$#*-"))


def _tail_cells(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A shared cell for each word: the class by its last two characters without punctuation, the member by its first three bytes."""
    first = np.zeros(len(starts), np.uint64)
    for i in range(3):
        first = (first << np.uint64(8)) | np.where(starts + i < ends, buf[np.minimum(starts + i, len(buf) - 1)], 0).astype(np.uint64)
    left, at = ends.copy(), np.arange(len(ends))
    while len(at := at[(left[at] > starts[at]) & _PUNCTUATION[buf[left[at] - 1]]]):
        left[at] -= 1
    last = np.zeros(len(starts), np.uint64)
    for _ in range(2):
        at = np.flatnonzero(left > starts)
        while len(at):  # a character's bytes, from its last one back
            left[at] -= 1
            last[at] = (last[at] << np.uint64(8)) | buf[left[at]]
            at = at[(left[at] > starts[at]) & (buf[left[at]] & 0xC0 == 0x80)]
    classes = np.uint64(CLASSES - HEAD // MEMBERS)
    return (HEAD + (mixed(last, 51) % classes).astype(np.int64) * MEMBERS + (mixed(first, 52) % np.uint64(MEMBERS)).astype(np.int64)).astype(np.int16)


def _list(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0), kind))


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, where each stands first, and each hash's number among them."""
    found = pa.array(hashes.view(np.int64)).dictionary_encode()
    number, distinct = found.indices.to_numpy(), found.dictionary.to_numpy().view(np.uint64)
    first = np.empty(len(distinct), np.intp)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)  # the last one written stays
    return distinct, first, number


def _block(ids: list, texts: list[bytes], modulus: int, cutter: WordCutter) -> pa.RecordBatch:
    hashes, cells, numbers, sizes, known = [], [], [], [], 0
    for some in chunks(texts, 2_000_000):
        buf, starts, ends, h, n = cutter.places(some)
        distinct, first, number = _numbered(h)
        hashes += [distinct, [END_HASH]]
        cells += [_tail_cells(buf, starts[first], ends[first]), [CELLS - 1]]
        numbers.append(np.insert(number + np.int32(known), np.cumsum(n), known + len(distinct)))
        known += len(distinct) + 1
        sizes.append(n + 1)
    sizes = np.concatenate(sizes)
    hashes, at, number = _numbered(np.concatenate(hashes, dtype=np.uint64))
    tok = number[np.concatenate(numbers)]
    often = np.argsort(-np.bincount(tok), kind="stable")  # small numbers for frequent words, which pack better
    rank = np.empty(len(often), np.int32)
    rank[often] = np.arange(len(often), dtype=np.int32)
    tok, hashes, cells = rank[tok], hashes[often], np.concatenate(cells, dtype=np.int16)[at[often]]
    held = np.array([zlib.crc32(str(i).encode()) % modulus == 0 if i is not None else False for i in ids])
    counts = np.bincount(tok[~np.repeat(held, sizes)], minlength=len(hashes)).astype(np.int64)
    packed = pa.compress(np.ascontiguousarray(tok.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)
    name = int.from_bytes(xxhash.xxh3_64_digest(repr(ids[:50]).encode() + str(len(tok)).encode() + hashes.tobytes()), "little", signed=True)
    one = lambda v, kind: _list([v], kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64())), one(held, pa.bool_()),
            one(np.array(sizes, np.int32), pa.int32()), pa.array([packed], pa.binary()), one(hashes.view(np.int64), pa.int64()), one(cells, pa.int16()), one(counts, pa.int64()),
        ],
        ["block", "doc_ids", "held", "sizes", "tokens", "words", "cells", "counts"],
    )


_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words array<long>, cells array<short>, counts array<long>"


def blocks_of(docs: DataFrame, modulus: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = WordCutter()
        for batch in batches:
            ids, start = batch.column(0).to_pylist(), 0
            texts = text_bytes(batch.column(1))
            for some in chunks(texts, BLOCK_BYTES):
                yield _block(ids[start : start + len(some)], some, modulus, cutter)
                start += len(some)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _BLOCKS)


@dataclass
class Corpus:
    """Bounded facts of the training texts: totals, the frequent words by falling count, and each cell's sums."""

    n: int
    v: int
    head: np.ndarray
    cell_tokens: np.ndarray
    cell_words: np.ndarray


class History:
    """Feature rows of every token of a block."""

    def __init__(self, corpus: Corpus):
        order = np.argsort(corpus.head)
        self.head, self.cell = corpus.head[order], order.astype(np.int16)

    def cells(self, words: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The cell of each word: its own if it is frequent."""
        if not len(self.head):
            return tail
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        return np.where(self.head[at] == words, self.cell[at], tail)

    def buckets(self, words: np.ndarray, cells: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The bucket of each feature but the bias; before a text's first token stand tokens that no text has."""
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        def before(v: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(len(v), np.uint64)
            if k < len(v):
                out[k:] = v[:-k].astype(np.uint64) + np.uint64(1)
            out[place < k] = 0
            return out

        c1, c2, c3 = (before(cells, k) for k in (1, 2, 3))
        m = np.uint64(1 << 10)
        keys = [mixed(before(words, 1), 21), mixed(before(words, 2), 22), mixed(c1 * m + c2, 23), mixed(c2 * m + c3, 24), mixed(c1 * m + c3, 25)]
        return [(k % np.uint64(BUCKETS - 1)).astype(np.intp) + 1 for k in keys]


@dataclass
class Weights:
    """Bucket 0 of ``classes`` is the bias; ``members`` are picked by class, and by class with each feature."""

    classes: np.ndarray  # BUCKETS x CLASSES
    members: np.ndarray  # BUCKETS x MEMBERS


#: The members' bucket of each bucket and class.
_OWN = (((np.arange(BUCKETS * CLASSES) * 2654435761 & 0xFFFFFFFF) >> 9) % (BUCKETS - CLASSES) + CLASSES).astype(np.int16)


def member_buckets(buckets: list[np.ndarray], k: np.ndarray) -> list[np.ndarray]:
    return [k.astype(np.intp), *(_OWN[b * CLASSES + k].astype(np.intp) for b in buckets)]


_LEAST, _MOST = np.exp(np.float32([-60, 60]))
_scratch: dict[tuple, np.ndarray] = {}


def _room(shape: tuple[int, int], kind, slot: int) -> np.ndarray:
    """Memory used again and again, as fresh pages would cost more than the sums."""
    held = _scratch.get((shape, kind, slot))
    if held is None:
        held = _scratch[shape, kind, slot] = np.empty(shape, kind)
    return held


def _runs(n: int, size: int) -> Iterator[slice]:
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def _factors(table: np.ndarray, bias: bool) -> tuple[np.ndarray, np.ndarray]:
    """The weights' exponentials for the first feature, which takes the bias along, and for the others.

    Weights are logs of shares and bounded steps from there, far from what would overflow, a few of them multiplied too.
    """
    e = np.exp(table)
    return e * e[0] if bias else e, e


def _softmax(factors: tuple[np.ndarray, np.ndarray], buckets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For ``RUN_TOKENS`` at most: the exponentials of the sums of weight rows by token and outcome, and by token. The first array is scratch."""
    n, width = len(buckets[0]), factors[0].shape[1]
    x, more = (_room((RUN_TOKENS, width), np.float32, i)[:n] for i in (0, 1))
    factors[0].take(buckets[0], axis=0, mode="clip", out=x)
    for b in buckets[1:]:  # products of exponentials, as the exponential of each sum would cost more than all else here
        factors[1].take(b, axis=0, mode="clip", out=more)
        np.multiply(x, more, out=x)
    np.clip(x, _LEAST, _MOST, out=x)
    return x, x @ np.ones(width, np.float32)


def _log_p(table: np.ndarray, buckets: list[np.ndarray], target: np.ndarray, bias: bool) -> np.ndarray:
    out, factors = np.empty(len(target)), _factors(table, bias)
    for run in _runs(len(target), RUN_TOKENS):
        x, total = _softmax(factors, [b[run] for b in buckets])
        out[run] = np.log(x[np.arange(len(x)), target[run]].astype(np.float64)) - np.log(total.astype(np.float64))
    return out


def _missed(factors: tuple[np.ndarray, np.ndarray], buckets: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """By outcome and token (``PART_TOKENS`` at most) what the target has and the model does not give it. The array is scratch."""
    left = _room((factors[0].shape[1], PART_TOKENS), np.float64, 0)[:, : len(target)]
    for run in _runs(len(target), RUN_TOKENS):
        x, total = _softmax(factors, [b[run] for b in buckets])
        np.multiply(x.T, -1 / total, out=left[:, run])
    left[target, np.arange(len(target))] += 1
    return left


def _step(table: np.ndarray, buckets: list[np.ndarray], target: np.ndarray, rate: float, bias: bool) -> None:
    """One gradient step for ``P(target | buckets)``, each bucket's by the mean over its tokens, damped for rare ones."""
    n, rows, factors = len(target), len(table), _factors(table, bias)
    shares = [rate / (np.bincount(b, minlength=rows) + 20) for b in buckets]
    moves = np.zeros(table.shape[::-1])
    for part in _runs(n, PART_TOKENS):
        left = _missed(factors, [b[part] for b in buckets], target[part])
        if bias:
            moves[:, 0] += rate / n * left.sum(axis=1)
        for b, share in zip(buckets, shares):
            for move, of_outcome in zip(moves, left):  # one outcome at a time: its tokens and sums stay in the cache
                move += share * np.bincount(b[part], weights=of_outcome, minlength=rows)
    for run in _runs(rows, RUN_TOKENS):
        table[run] += moves[:, run].T


class _Reader:
    """The arrays of a block row."""

    def __init__(self, batch: pa.RecordBatch, r: int):
        def part(name):
            a = batch.column(name)
            return a.values.slice(a.offsets[r].as_py(), a.offsets[r + 1].as_py() - a.offsets[r].as_py())

        def values(name):
            return part(name).to_numpy(zero_copy_only=False)

        self.ids, self.held, self.sizes = part("doc_ids"), values("held"), values("sizes")
        n = int(self.sizes.sum())
        planes = pa.decompress(batch.column("tokens")[r].as_py(), decompressed_size=4 * n, codec="zstd", asbytes=True)
        self.tokens = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view(np.int32)[:, 0]
        self.words, self.tail = values("words").view(np.uint64), values("cells")
        self.counts = values("corpus_counts") if "corpus_counts" in batch.schema.names else None

    def parts(self, history: History, training_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Some texts at a time: their tokens, sizes, cells and buckets."""
        sizes, tokens = self.sizes, self.tokens
        if training_only:
            tokens, sizes = tokens[np.repeat(~self.held, sizes)], sizes[~self.held]
        ends, every = np.cumsum(sizes), history.cells(self.words, self.tail)
        first = start = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, start + PART_TOKENS, side="right")))
            tok, own = tokens[start : ends[last - 1]], sizes[first:last]
            cells = every[tok].astype(np.int32)
            yield tok, own, cells, history.buckets(self.words[tok], cells, own)
            first, start = last, int(ends[last - 1])


def _packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _unpacked(raw: bytes) -> list[np.ndarray]:
    z = np.load(io.BytesIO(raw))
    return [z[k] for k in z.files]


def _summed(parts: DataFrame) -> list[np.ndarray]:
    """The sums of packed arrays ``(part, raw)``: in two rounds, so that no task adds up more than a share of them."""

    def add(group):
        total = None
        for raw in group.column("raw"):
            arrays = _unpacked(raw.as_py())
            total = arrays if total is None else [t + a for t, a in zip(total, arrays)]
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "raw": pa.array([_packed(*total)], pa.binary())})

    schema = "part int, raw binary"
    once = parts.groupBy("part").applyInArrow(add, schema)
    last = once.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(add, schema).first()
    return _unpacked(last.raw) if last else []


def _per_task(blocks: DataFrame, run, fan: int = 32) -> list[np.ndarray]:
    """Sums over all tasks of the arrays that ``run(readers)`` gives for a task's blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = run(_Reader(b, r) for b in batches for r in range(b.num_rows))
        if out is not None:
            raw = _packed(*out)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(raw) % fan], pa.int32()), pa.array([raw], pa.binary())], ["part", "raw"])

    return _summed(blocks.select("doc_ids", "held", "sizes", "tokens", "words", "cells").mapInArrow(task, "part int, raw binary"))


def _counted(history: History):
    """Start from what each feature alone says: smoothed counts of classes and members by bucket."""

    def run(readers):
        by_class, by_member = np.zeros(BUCKETS * CLASSES, np.int64), np.zeros(BUCKETS * MEMBERS, np.int64)
        for r in readers:
            for _, _, cells, buckets in r.parts(history, True):
                k, j = cells // MEMBERS, cells % MEMBERS
                by_class += np.bincount(np.concatenate([k, *(b * CLASSES + k for b in buckets)]), minlength=len(by_class))
                by_member += np.bincount(np.concatenate([b * MEMBERS + j for b in member_buckets(buckets, k)]), minlength=len(by_member))
        return by_class.astype(np.float32), by_member.astype(np.float32)

    return run


def _start(sums: list[np.ndarray]) -> Weights:
    """Log shares for the bias and for each class; for a feature, log ratios to them, each feature with a part of its own."""
    by_class, by_member = sums[0].reshape(BUCKETS, CLASSES).astype(np.float64), sums[1].reshape(BUCKETS, MEMBERS).astype(np.float64)

    def ratios(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        shares = (counts + 20 * total) / (counts.sum(axis=1, keepdims=True) + 20)
        return np.log(shares / total) / 2.5

    usual = (by_class[0] + 1) / (by_class[0].sum() + CLASSES)
    classes = ratios(by_class, usual)
    classes[0] = np.log(usual)
    own = (by_member[:CLASSES] + 1) / (by_member[:CLASSES].sum(axis=1, keepdims=True) + MEMBERS)
    inner = by_member[CLASSES:].sum(axis=0) + 1
    members = ratios(by_member, inner / inner.sum())
    members[:CLASSES] = np.log(own)
    return Weights(classes.astype(np.float32), members.astype(np.float32))


def _improved(history: History, w: Weights, rate: float):
    def run(readers):
        classes, members, seen = w.classes.copy(), w.members.copy(), False
        for r in readers:
            for _, _, cells, buckets in r.parts(history, True):
                k, j, seen = cells // MEMBERS, cells % MEMBERS, True
                _step(classes, buckets, k, rate, True)
                _step(members, member_buckets(buckets, k), j, rate, False)
        return (classes - w.classes, members - w.members, np.ones(1)) if seen else None

    return run


def train(blocks: DataFrame, corpus: Corpus, *, rounds: int = 1, rate: float = 0.3) -> tuple[History, Weights]:
    """Weights from the blocks' training texts, all of them in every round."""
    history = History(corpus)
    sums = _per_task(blocks, _counted(history))
    if not sums:
        return history, Weights(np.zeros((BUCKETS, CLASSES), np.float32), np.zeros((BUCKETS, MEMBERS), np.float32))
    w = _start(sums)
    for _ in range(rounds):
        if moved := _per_task(blocks, _improved(history, w, rate)):
            w = Weights(*(old + d / moved[2][0] for old, d in zip((w.classes, w.members), moved)))
    return history, w


def _scored(corpus: Corpus, history: History, w: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                b = _Reader(batch, r)
                sums = []
                for tok, sizes, cells, buckets in b.parts(history, False):
                    counts = b.counts[tok].astype(np.float64)
                    k = cells // MEMBERS
                    log_p = _log_p(w.classes, buckets, k, True) + _log_p(w.members, member_buckets(buckets, k), cells % MEMBERS, False)
                    in_cell = np.log10((counts + 0.1) / (corpus.cell_tokens + 0.1 * (corpus.cell_words + 1))[cells])
                    base = np.log10((counts + 0.1) / (corpus.n + 0.1 * (corpus.v + 1)))
                    starts = np.cumsum(sizes) - sizes
                    sums.append([np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), base, log_p / np.log(10) + in_cell)])
                known, base, score = (np.concatenate(x) for x in zip(*sums))
                columns = [b.ids, pa.array(b.held.astype(bool)), pa.array(b.sizes.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
                )

    return run


def corpus_of(blocks: DataFrame) -> tuple[Corpus, DataFrame]:
    """Training counts of all words ``(word, cell, c)``, and what of them is bounded."""
    each = blocks.select(F.explode(F.arrays_zip("words", "cells", "counts")).alias("e")).where("e.counts > 0")
    counts = stored(each.groupBy(F.col("e.words").alias("word")).agg(F.min("e.cells").alias("cell"), F.sum("e.counts").alias("c")), "counts")
    top = counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()
    own = {r.word: i for i, r in enumerate(top)}
    cells = np.zeros((CELLS, 2))
    for r in counts.groupBy("cell").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # CELLS rows at most
        cells[r.cell] = r.n, r.v
    n, v = cells.sum(axis=0)
    for r in top:
        cells[r.cell] -= r.c, 1
        cells[own[r.word]] += r.c, 1
    return Corpus(int(n), int(v), np.array([r.word for r in top], np.int64).view(np.uint64), cells[:, 0], cells[:, 1]), counts


def with_counts(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """The blocks with the corpus count of each of their words, 0 for unseen ones."""
    each = blocks.select("block", F.posexplode("words").alias("at", "word"))
    found = each.join(counts.select("word", "c"), "word").groupBy("block").agg(F.collect_list(F.struct("at", "c")).alias("found"))
    return blocks.join(found, "block", "left")


def score_texts(
    docs: DataFrame, *, modulus: int = 10, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows whose CRC-32 of the identifier as text does not divide by ``modulus``; a row without identifier is
    learnt from. Tokens are words at ASCII white space, in small ASCII letters, and one end per text, which is all that null
    and empty texts have. ``base_score`` is the smoothed unigram model's and ``score`` this model's log10 probability.
    Words are told apart by 64-bit hashes. Repeated rows count each; other columns are not looked at; an empty table gives no rows.
    """
    blocks = stored(blocks_of(docs, modulus, id_col, text_col), "blocks")
    corpus, counts = corpus_of(blocks)
    history, weights = train(blocks, corpus, rounds=rounds)
    ready = with_counts(blocks, counts)

    def unpack(batches):
        for batch in batches:
            found = batch.column("found")
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("found", "block", "counts")}
            sizes = np.diff(batch.column("words").offsets.to_numpy())
            flat, offsets = found.values, found.offsets.to_numpy()
            at, c = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out = []
            for r, size in enumerate(sizes):
                full = np.zeros(size, np.int64)
                full[at[offsets[r] : offsets[r + 1]]] = c[offsets[r] : offsets[r + 1]]
                out.append(full)
            columns["corpus_counts"] = _list(out, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    scored = _scored(corpus, history, weights)
    rows = ready.drop("counts").mapInArrow(
        lambda batches: scored(unpack(batches)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.n).cast("long").alias("train_tokens"), "base_score", "score")
