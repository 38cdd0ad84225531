"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features are words and word starts, so that compounds of a marked stem count. Those that stand out among toxic labels by
a likelihood-ratio test are kept, and three more say whether, how often and how densely a text has any of them. The labels
only say toxic or not; how severe a toxic training text is follows from the share of its words that stand out, in thirds. One weight per feature is shared by all grades and ordered thresholds cut the
score: ``P(grade <= g) = sigmoid(threshold_g - w x)``. The expected severity is the mean grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklattice.llm.common import WORD_BYTES, WordCutter, mixed, shingle_sets, slices, small_batches, text_bytes, without
from ticklattice.session import stored

#: Lengths in bytes of the word starts that are features beside the whole word.
STARTS = (4, 5, 6)


@dataclass
class OrdinalModel:
    """Feature names with weights, and ascending thresholds, one fewer than there are grades."""

    features: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def grade_shares(self, x: np.ndarray) -> np.ndarray:
        """A row of probabilities of the grades 0, 1, … for each linear score."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - x[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1), axis=1)


def features_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:n] for n in STARTS if len(word) > n)]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def fit(texts: list[bytes], toxic: np.ndarray, *, grades: int = 4, least_g: float = 24.0, least_purity: float = 0.8, rounds: int = 400, ridge: float = 1e-4) -> OrdinalModel:
    """Fit on labelled texts, which the caller has bounded. Without both labels the model finds nothing toxic.

    Of texts that share any of four smallest 4-word hashes, so of copies and near copies, one of each label is used; the
    words of a text that was copied often would stand out otherwise.
    """
    own = _distinct(texts, toxic)
    texts, toxic = [texts[i] for i in own], toxic[own]
    ids: dict[bytes, int] = {}
    rows = [np.unique(np.fromiter((ids.setdefault(f, len(ids)) for w in set(words_of(t)) for f in features_of(w)), np.int64)) for t in texts]
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return OrdinalModel({}, np.zeros(3), np.arange(1, grades) + 20.0)
    y = np.repeat(toxic, [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    pos, neg = (np.bincount(flat[y == v], minlength=len(ids)) for v in (1, 0))
    base, seen = n1 / (n1 + n0), np.maximum(pos + neg, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(pos > 0, pos * np.log(pos / seen / base), 0) + np.where(neg > 0, neg * np.log(neg / seen / (1 - base)), 0))
    chosen = np.flatnonzero((g > least_g) & (pos / seen >= least_purity))
    place = {int(c): i for i, c in enumerate(chosen)}
    names = {f: place[i] for f, i in ids.items() if i in place}
    got = [_found(t, names) for t in texts]
    x, share = np.array([inputs(*f, len(names)) for f in got]), np.array([marked / max(1, words) for _, marked, words in got])
    grade = np.zeros(len(texts), int)
    cuts = np.quantile(share[toxic == 1], np.linspace(0, 1, grades)[1:-1])
    grade[toxic == 1] = 1 + np.searchsorted(cuts, share[toxic == 1], side="right")
    return OrdinalModel(names, *_ordinal(x, grade, grades, rounds, ridge))


def _distinct(texts: list[bytes], toxic: np.ndarray) -> list[int]:
    cutter, seen, kept = WordCutter(), set(), []
    for i, t in enumerate(texts):
        s = next(shingle_sets([t], 4, cutter))
        marks = {(int(toxic[i]), k, int(mixed(s, 31 + k).min())) for k in range(4)} if len(s) else {(int(toxic[i]), -1, 0)}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return kept


def _found(text: bytes, names: dict[bytes, int]) -> tuple[set[int], int, int]:
    """The features a text has, how many of its words have any, and how many words it has."""
    features, marked, words = set(), 0, words_of(text)
    for w in words:
        mine = [names[f] for f in features_of(w) if f in names]
        features.update(mine)
        marked += bool(mine)
    return features, marked, len(words)


def inputs(features: set[int], marked: int, words: int, n_features: int) -> np.ndarray:
    x = np.zeros(n_features + 3)
    x[list(features)] = 1
    x[n_features:] = marked > 0, np.log1p(marked), np.log1p(100 * marked / max(1, words))
    return x


def _ordinal(x: np.ndarray, grade: np.ndarray, grades: int, rounds: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model by Adam; thresholds are a first one and positive steps."""
    n, d = x.shape
    p = np.concatenate([np.zeros(d), [2.0], np.zeros(grades - 2)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, first, steps = p[:d], p[d], np.exp(p[d + 1 :])
        cuts = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
        score = x @ w
        hi, lo = (1 / (1 + np.exp(-np.clip(cuts[grade + s] - score, -40, 40))) for s in (1, 0))
        hi, lo = np.where(grade == grades - 1, 1.0, hi), np.where(grade == 0, 0.0, lo)
        inverse = 1 / np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) * inverse, lo * (1 - lo) * inverse  # of the log likelihood by its two thresholds
        by_cut = np.array([dhi[grade == k].sum() - dlo[grade == k + 1].sum() for k in range(grades - 1)])
        g = -np.concatenate([x.T @ (dlo - dhi), [by_cut.sum()], [by_cut[k + 1 :].sum() * steps[k] for k in range(grades - 2)]]) / n
        g[:d] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    steps = np.exp(p[d + 1 :])
    return p[:d], p[d] + np.concatenate([[0], np.cumsum(steps)])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, max_bytes: int = 20_000, holdout: tuple[int, int] | None = None, **options) -> OrdinalModel:
    """Fit on at most ``max_rows`` labelled documents, the first by a hash of their identifier, of ``max_bytes`` at most.

    Longer labelled texts are left to scoring. ``holdout=(m, r)`` keeps identifiers of that remainder out. Labels other
    than 0 and 1 and null texts are passed over; of several labels of a document the largest counts.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_toxic"))
    if holdout:
        marks = marks.where(F.pmod(F.col(id_col), F.lit(holdout[0])) != holdout[1])
    order = F.xxhash64(F.col(id_col))
    marks = marks.orderBy(order, id_col).limit(max_rows)
    rows = docs.select(id_col, text_col).where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= max_bytes)).join(F.broadcast(marks), id_col)
    rows = rows.select(F.col(id_col).alias("i"), F.encode(text_col, "UTF-8").alias("t"), "_toxic").toArrow().to_pydict()  # max_rows x max_bytes at most
    by_id = sorted(zip(rows["i"], rows["_toxic"], rows["t"]))
    return fit([r[2] for r in by_id], np.array([r[1] for r in by_id], int), **options)


class _Marked(dict):
    """Word to the places of its features in the model, kept for words seen; emptied when full."""

    LIMIT = 50_000

    def __init__(self, names: dict[bytes, int]):
        self.names = names

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        got = self[word] = tuple(self.names[f] for f in features_of(word) if f in self.names)
        return got


def severity(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, expected_severity, grade, grade_shares, toxic``.

    ``grade`` is the likeliest grade; a document is ``toxic`` when the grades above 0 together reach ``reject_at``. Whole
    texts are read; null and empty ones have no features. Repeated rows are scored each; other columns are not looked at.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = _Marked(model.features)
        for batch in slices(batches):
            x = np.zeros(batch.num_rows)
            for r, text in enumerate(text_bytes(batch.column(1))):
                words = words_of(text)
                got = [places for places in map(marked.__getitem__, words) if places]
                if got:
                    x[r] = inputs({i for places in got for i in places}, len(got), len(words), len(model.features)) @ model.weights
            shares = model.grade_shares(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(shares @ np.arange(shares.shape[1])),
                    pa.array(shares.argmax(axis=1).astype(np.int32)),
                    pa.array(list(shares), pa.list_(pa.float64())),
                    pa.array(1 - shares[:, 0] >= reject_at),
                ],
                ["doc_id", "expected_severity", "grade", "grade_shares", "toxic"],
            )

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, expected_severity double, grade int, grade_shares array<double>, toxic boolean"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that a model fitted on the labels does not find toxic, with all their columns."""
    found = severity(docs, train(docs, labels, id_col=id_col, text_col=text_col, **options), id_col=id_col, text_col=text_col)
    with small_batches(docs.sparkSession):
        gone = stored(found.where("toxic").select("doc_id").distinct(), "toxic")
    return without(docs, gone, id_col)
