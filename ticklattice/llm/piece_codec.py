"""SentencePiece encoding and decoding, one forward pass over a trie of the distinct words.

Text becomes marked words: blanks turn into U+2581, one more is put in front, and a cut is made before each run of marks,
which no piece spans. The distinct words of a batch are sorted, which lays them out as a trie in depth-first order; the
forward values of a word are kept for the prefix it shares with the next, and only the rest is worked out.

For a unigram model the forward value of a prefix is its best score and last piece (Viterbi). For a BPE model the best
path of a prefix is the one path in which no two neighbouring pieces, merged on their own, would come out otherwise; it
is found from the last pieces of shorter prefixes in the same way, and exactly one piece fits. Ids are those that the
library gives for the model's text form without normalisation.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklattice.llm.common import chunks, slices

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Characters of text that are cut and encoded at a time (but for a single longer text); they take some forty bytes of memory each.
CHUNK = 1_000_000
_END = ""  # the key under which a trie node holds its piece


class Pieces:
    """A model's pieces, from the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        self.bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        normal = proto.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces):
            raise ValueError("only models that take text as it is, with a mark in front, are read")
        sp = SentencePieceProcessor(model_proto=model)
        self.unknown = sp.unk_id()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if sp.is_byte(sp.piece_to_id("<0x00>")) else None
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            if sp.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            else:
                self.bytes.append(piece.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    self.ids[piece] = i
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece has a mark after another character, so words cannot be cut there")
        self.names = {i: p for p, i in self.ids.items()}
        self.least = min(self.scores[i] for i in self.ids.values())
        self.backwards: dict = {}  # a trie of the pieces from their last character on
        for piece, i in self.ids.items():
            node = self.backwards
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[_END] = i

    def merged(self, text: str) -> list[str]:
        """BPE by its rule: of all neighbours that make a piece, the best-scored and then leftmost pair is merged."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Encodes words, keeping the ids of those seen as packed 32-bit numbers, and pairs tried; both stores are emptied when full."""

    LIMIT = 300_000

    def __init__(self, pieces: Pieces):
        self.p, self.words, self.apart, self.alone = pieces, {}, {}, {}

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether two pieces side by side come out as they are. An unknown character (-1) is never merged."""
        if a < 0 or b < 0:
            return True
        if len(self.apart) > 2 * self.LIMIT:
            self.apart.clear()
        x, y = self.p.names[a], self.p.names[b]
        known = self.apart[a << 32 | b] = self.p.merged(x + y) == [x, y]
        return known

    def _stands(self, a: int) -> bool:
        if (known := self.alone.get(a)) is None:
            known = self.alone[a] = a < 0 or self.p.merged(self.p.names[a]) == [self.p.names[a]]
        return known

    def _step(self, word: str, end: int, forward: list[tuple[float, int, int]]) -> tuple[float, int, int]:
        """The forward value of ``word[:end]``: score, last piece, where that begins."""
        node, start, best, apart, bpe = self.p.backwards, end, None, self.apart, self.p.bpe
        while start:
            start -= 1
            node = node.get(word[start])
            if node is None:
                break
            i = node.get(_END)
            if i is None:
                continue
            if not bpe:
                score = forward[start][0] + self.p.scores[i]
                if best is None or score > best[0]:
                    best = (score, i, start)
                continue
            if start:
                before = forward[start][1]
                fits = apart.get(before << 32 | i)
                if fits is None:
                    fits = self._stay_apart(before, i)
            else:
                fits = self._stands(i)
            if fits:
                return (0.0, i, start)
        if word[end - 1] not in self.p.ids:
            unknown = (forward[end - 1][0] + self.p.least - 10, -1, end - 1)
            if best is None or unknown[0] > best[0]:
                best = unknown
        return best

    def learn(self, words: set[str]) -> None:
        """Work out the words not known yet, in sorted order."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.LIMIT:
            self.words.clear()
            new = words
        last, forward = "", [(0.0, -1, 0)]
        for word in sorted(new):
            shared = len(os.path.commonprefix((last, word)))
            del forward[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                forward.append(self._step(word, end, forward))
            self.words[word] = self._back(word, forward)
            last = word

    def _back(self, word: str, forward: list) -> bytes:
        path, end = [], len(word)
        while end:
            _, i, start = forward[end]
            path.append((i, start))
            end = start
        out: list[int] = []
        for i, start in reversed(path):
            if i >= 0:
                out.append(i)
            elif self.p.byte_ids:
                out.extend(self.p.byte_ids[b] for b in word[start].encode())
            elif not out or out[-1] != self.p.unknown:
                out.append(self.p.unknown)
        return array("i", out).tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit numbers one after the other."""
        cut = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(raw, np.int32).tolist() for raw in self.packed(texts)]


#: The encoder of this process, kept from task to task: (model, encoder).
_kept: list[tuple[bytes, Encoder]] = []


def encoder_of(model: bytes) -> Encoder:
    if not _kept or _kept[0][0] != model:
        _kept[:] = [(model, Encoder(Pieces(model)))]
    return _kept[0][1]


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """The text of ids: marks are blanks again, the first one is taken off, bytes that are no text become U+FFFD."""
    raw = b"".join(map(pieces.bytes.__getitem__, ids))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def _token_column(packed: list[bytes]) -> pa.Array:
    offsets = (np.cumsum([0, *map(len, packed)]) // 4).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, model: bytes, *, text_col: str = "text", ids_col: str = "token_ids", check_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text, and in ``check_col``, if named, whether they decode to it again.

    Null and empty texts have no ids. A text that holds U+2581 is encoded as if it were a blank, and so does not decode
    to itself. Texts of any length, repeated rows and further columns are taken as they are; columns of the new names are replaced.
    """
    new = [ids_col] + ([check_col] if check_col else [])
    docs = docs.drop(*new)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        pieces = encoder.p
        for batch in slices(batches):
            start = 0
            for some in chunks([t or "" for t in batch.column(at).to_pylist()], CHUNK):
                packed = encoder.packed(some)
                out = [*batch.slice(start, len(some)).columns, _token_column(packed)]
                if check_col:
                    same = [decode_ids(np.frombuffer(raw, np.int32).tolist(), pieces) == t for raw, t in zip(packed, some)]
                    out.append(pa.array(same, pa.bool_()))
                start += len(some)
                yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, *new])

    schema = docs.select("*", F.lit(None).cast("array<int>").alias(ids_col), *([F.lit(None).cast("boolean").alias(check_col)] if check_col else [])).schema
    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, model: bytes, *, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's ids; null ids give a null text, none an empty one."""
    docs = docs.drop(text_col)
    at = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder_of(model).p
        for batch in batches:
            texts = [None if ids is None else decode_ids(ids, pieces) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return docs.mapInArrow(run, docs.withColumn(text_col, F.lit(None).cast("string")).schema)


def model_bytes(path: str) -> bytes:
    """A tokenizer's file, read where the job is planned and sent to the tasks with it (a few MB at most)."""
    with open(path, "rb") as f:
        return f.read()
