"""Packing of documents into training sequences whose sources keep given proportions.

Documents become token ids once and stay where they are. Each source is a queue, in order of its stored rows. Every window, that is
every sequence, is filled by one round over the queues: each is credited its share of the window, serves the whole tokens that
the round's credit so far comes to, and carries its deficit, less than a token, to the next window. Documents are cut where
a window ends. While no queue runs dry the state after any number of rounds is known without going through them, so each
document finds its own windows and places: deficits cross partitions with no task waiting for another. Where a queue
does run dry, the windows around that point are filled one by one and the others' shares grow.

Sources whose share of a window is below a grain of tokens stand in one common queue, so a round has a bounded number of queues.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.llm.common import small_side
from ticklattice.session import scratch_path, stored

#: Credits are counted in parts of a token; 2^33 windows of 2^11 tokens stay below 2^63 of them.
UNIT = 1 << 16
#: A queue of its own needs this many tokens of each window.
GRAIN = 8
#: Pieces are put out in batches of about so many tokens.
BATCH_TOKENS = 4_000_000

Encode = Callable[[list[str]], list[bytes]]


# token ids


class ByteEncoder:
    """Ids of a byte-level BPE tokenizer as unsigned 16-bit numbers; the strings of special tokens are ordinary text.

    Texts of common letters are merged by the ranks of the same vocabulary, which is quicker and gives the same ids; without white space in a
    row they need no looking ahead when they are cut. For all others the tokenizer itself, whose classes of characters count, is asked.
    """

    #: The tokenizer's own pattern, as its vocabulary needs it, in two parts: the second is for white space in a row.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
    AHEAD, BLANKS = r"|\s+(?!\S)", r"|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        special = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if i not in special}
        whole, simple = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (self.PATTERN + self.AHEAD + self.BLANKS, self.PATTERN + self.BLANKS))
        self.whole, self.simple = whole.encode_ordinary, simple.encode_ordinary
        self.common = re.compile("[\t-\r -~\u00c0-\u00ff]*").fullmatch
        self.in_a_row = re.compile("[\t-\r ][\t-\r ]").search

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if not self.common(t):
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
            else:
                ids = self.whole(t) if self.in_a_row(t) else self.simple(t)
            out.append(np.array(ids, "<u2").tobytes())
        return out


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows, else the next beyond 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, beyond = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else beyond))
        beyond += b not in shown
    return "".join(letters)


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for all tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def tokens_of(docs: DataFrame, encoder: Callable[[], Encode], end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``part, key, at, n, doc_id, ids``, stored: each text's ids with the end, and its place among its source's tokens in its partition."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, served = TaskContext.get().partitionId(), encoder(), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                keys, at, n, ids = some.column(1).to_pylist(), [], [], []
                for key, raw in zip(keys, encode([t or "" for t in some.column(2).to_pylist()])):
                    ids.append(raw + end)
                    n.append(len(raw) // 2 + 1)
                    at.append(served.get(key, 0))
                    served[key] = at[-1] + n[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), some.column(1), pa.array(at, pa.int64()), pa.array(n, pa.int64()), some.column(0), pa.array(ids, pa.binary())],
                    ["part", "key", "at", "n", "doc_id", "ids"],
                )

    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"part int, key string, at bigint, n bigint, doc_id {kind}, ids binary")
    path = scratch_path(docs.sparkSession, "tokens")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


# the rounds


def apportioned(room: int, weights: Sequence[float]) -> list[int]:
    """Whole parts of ``room`` by weight, of which one at least is above 0; running sums are rounded down, so that the parts add up."""
    total, last = sum(weights), max(j for j, w in enumerate(weights) if w)
    cuts, running = [], 0.0
    for j, w in enumerate(weights):
        running += w
        cuts.append(min(room, int(room * (running / total))) if j < last else room)
    return [b - a for a, b in zip([0, *cuts], cuts)]


def _active(shares: Sequence[float], left: Sequence[int]) -> list[float]:
    """The shares of the queues that still have tokens; equal ones if only queues without a share are left."""
    weights = [w if r else 0.0 for w, r in zip(shares, left)]
    return weights if any(weights) else [1.0 if r else 0.0 for r in left]


@dataclass(frozen=True)
class Stretch:
    """``n`` windows from window ``first`` on. Queue j has given ``start[j]`` tokens before; a window credits the queues up to and with it ``upto[j + 1]``."""

    first: int
    n: int
    start: tuple[int, ...]
    upto: tuple[int, ...]

    def given(self, j: int, rounds):
        """Tokens that queue j has given in so many rounds of the stretch."""
        return (rounds * self.upto[j + 1]) // UNIT - (rounds * self.upto[j]) // UNIT

    def place(self, j: int, rounds):
        """Where queue j's tokens begin in the window after so many rounds."""
        return ((rounds + 1) * self.upto[j]) // UNIT - (rounds * self.upto[j]) // UNIT

    def round_of(self, j: int, token: int) -> int:
        """The round in which queue j gives its ``token``, counted from the start of the stretch."""
        credit = self.upto[j + 1] - self.upto[j]
        k = max(0, token * UNIT // credit - 2)
        while self.given(j, k + 1) <= token:
            k += 1
        return k


def plan(totals: Sequence[int], shares: Sequence[float], window: int) -> list[Stretch]:
    """How queues of these tokens fill windows in these proportions: a few stretches for each queue that runs dry.

    A round credits each queue its share, in order; a queue serves what the whole tokens of the credits up to it come to, less
    what those before it served. What it is owed or has borrowed, less than a token, is its deficit for the next round.
    Only the last queue may have a share of less than a token.
    """
    left, taken, out, window_at = list(totals), [0] * len(totals), [], 0

    def stretch(n: int, credits: list[int]) -> None:
        nonlocal window_at
        upto = tuple(int(x) for x in np.concatenate([[0], np.cumsum(np.array(credits, object))]))
        s = Stretch(window_at, n, tuple(taken), upto)
        out.append(s)
        for j in range(len(left)):
            got = s.given(j, n)
            taken[j] += got
            left[j] -= got
        window_at += n

    while any(left):
        credits = apportioned(window * UNIT, _active(shares, left))
        rounds = min([sum(left) // window, *((r - 2) * UNIT // c for r, c in zip(left, credits) if c)])
        if rounds > 0:
            stretch(rounds, credits)
            continue
        room, counts = min(window, sum(left)), [0] * len(left)  # a queue runs dry here: the others fill its place
        while room:
            rest = [r - c for r, c in zip(left, counts)]
            for j, more in enumerate(apportioned(room, _active(shares, rest))):
                more = min(more, rest[j])
                counts[j] += more
                room -= more
        stretch(1, [c * UNIT for c in counts])
    return out


# pieces


def _cuts(stretches: list[Stretch], starts: list[list[int]], j: int, a: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of tokens ``a`` to ``a + n`` of queue j: their first tokens in the queue, windows, and offsets there."""
    end, out, at = a + n, [], bisect_right(starts[j], a) - 1
    while a < end:
        s = stretches[at]
        stop = min(end, starts[j][at + 1]) if at + 1 < len(stretches) else end
        if stop > a:
            base = s.start[j]
            rounds = np.arange(s.round_of(j, a - base), s.round_of(j, stop - 1 - base) + 1, dtype=np.int64)
            begin = base + s.given(j, rounds)
            served = base + s.given(j, rounds + 1) > begin
            own = np.maximum(begin, a)
            out.append((own[served], s.first + rounds[served], (s.place(j, rounds) + own - begin)[served]))
        a, at = stop, at + 1
    return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out))


def _pieces(stretches: list[Stretch]):
    starts = [list(x) for x in zip(*(s.start for s in stretches))]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def emit(ids: pa.Array, docs: list[int], columns: list[list[np.ndarray]], raw: list[bytes]) -> pa.RecordBatch:
        start, length, n, window, offset = (np.concatenate(c).astype(np.int64) for c in columns)
        data = np.frombuffer(b"".join(raw), "<u2").astype("<u4").tobytes()  # a document's pieces are in order and leave nothing out
        edges = (np.concatenate([[0], np.cumsum(length)]) * 4).astype(np.int32).tobytes()
        binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(docs))), *(pa.array(x) for x in (start, length, n, window, offset)), binary], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queue, place, n = (batch.column(c).to_pylist() for c in ("queue", "place", "n"))
            docs, columns, raw, held = [], [[], [], [], [], []], [], 0
            for i in range(batch.num_rows):
                own, window, offset = _cuts(stretches, starts, queue[i], place[i], n[i])
                docs.append(np.full(len(own), i))
                for c, x in zip(columns, (own - place[i], np.diff(np.append(own, place[i] + n[i])), np.full(len(own), n[i]), window, offset)):
                    c.append(x)
                raw.append(batch.column("ids")[i].as_py())
                held += n[i]
                if held > BATCH_TOKENS or i + 1 == batch.num_rows:
                    yield emit(batch.column("doc_id"), docs, columns, raw)
                    docs, columns, raw, held = [], [[], [], [], [], []], [], 0

    return run


def _queues(tokens: DataFrame, shares: Mapping[str, float] | None, window: int) -> tuple[DataFrame, list[Stretch]]:
    """``part, key, queue, start``: where a partition's tokens of a source begin in their queue; and how the queues fill the windows."""
    spark = tokens.sparkSession
    sums = stored(tokens.groupBy("part", "key").agg(F.sum("n").alias("n")), "sums")
    totals = sums.groupBy("key").agg(F.sum("n").alias("n"))
    whole = sums.agg(F.sum("n")).first()[0] or 0
    named = dict(shares or {})
    scale = max(1.0, sum(named.values()))
    goals = {"=" + k: x / scale for k, x in named.items()}
    others = totals.where(~F.col("key").isin(list(goals)))
    unnamed, open_share = others.agg(F.sum("n")).first()[0] or 0, 1 - sum(goals.values())
    if unnamed and open_share * window >= GRAIN:  # such sources share by their tokens what is left; window / GRAIN of them at most are a grain
        goals |= {r.key: open_share * r.n / unnamed for r in others.where(F.col("n") * (open_share * window) >= F.lit(float(unnamed * GRAIN))).collect()}
    own = {k: x for k, x in goals.items() if x * window >= GRAIN}
    keys = sorted(own)
    found = {r.key: r.n for r in totals.where(F.col("key").isin(keys)).collect()}
    counts = [found.get(k, 0) for k in keys]
    stretches = plan([*counts, whole - sum(counts)], [*(own[k] for k in keys), max(0.0, 1 - sum(own.values()))], window)
    numbers = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, queue int")  # as few
    sums = sums.join(F.broadcast(numbers), "key", "left").withColumn("queue", F.coalesce("queue", F.lit(len(keys))))
    ahead = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    parts = sums.groupBy("queue", "part").agg(F.sum("n").alias("n")).select("queue", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = W.partitionBy("queue", "part").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return sums.join(parts, ["queue", "part"]).select("part", "key", "queue", (F.col("start") + F.col("inside")).alias("start")), stretches


def pack(
    docs: DataFrame,
    encoder: Callable[[], Encode],
    *,
    end_id: int,
    window: int = 2048,
    shares: Mapping[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    A document is its text's ids, as ``encoder()`` gives them in 16 bits, and ``end_id``; ``doc_tokens`` counts both. ``start`` is where the piece begins in it,
    ``offset`` where it lies in its sequence, and ``ids`` are its ids as little-endian 32-bit numbers. Sequences are numbered from 0 and hold ``window``
    tokens, all but the last one. ``shares`` names the target shares of sources, and the others share what is left of one by their tokens, as all do by
    default, so that the mixture is even from the first window to the last. Once a queue is empty
    the others share its place. Sources of less than GRAIN tokens a window have a common queue.

    A null or empty text is its end alone, and a null source is a source of its own, as is the empty string. Repeated rows and null identifiers are documents like any other; texts are
    read whole. Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    tokens = tokens_of(docs, encoder, end_id, id_col, text_col, source_col)
    starts, stretches = _queues(tokens, shares, window)
    placed = tokens.join(small_side(stored(starts, "starts")), ["part", "key"]).select("doc_id", "ids", "n", "queue", (F.col("start") + F.col("at")).alias("place"))
    kind = docs.schema[id_col].dataType.simpleString()
    return placed.mapInArrow(_pieces(stretches), f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def sequences(pieces: DataFrame, *, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, token_ids``: whole sequences, padded to ``window`` unless their length is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                pad = 0 if len(ids) & (len(ids) - 1) == 0 else window - len(ids)
                out.append(np.concatenate([ids, np.full(pad, pad_id, np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("n_tokens"), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "n_tokens", "token_ids"])

    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # a window at most
    return rows.mapInArrow(run, "sequence_id bigint, n_tokens bigint, token_ids array<int>")
