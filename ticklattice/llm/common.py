"""What several operators share: reading tables, ASCII lower-casing, size-checked broadcasts, links to components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
WORD_PATTERN = r"[a-z\x{80}-\x{10FFFF}0-9]++"  # of small letters; letters first, as most characters are
#: For byte strings: the same words after ``translate`` and ``split``; capitals become small, other ASCII a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The most rows a side may have to be sent whole to every task.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z and nothing else changes. Text of one byte a character can take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row, for use inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fits(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the rows number ``limit`` at most; looks no further than that."""
    return df.limit(limit + 1).count() <= limit


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join, sent whole to every task when it was counted to be small, else left to be shuffled."""
    return F.broadcast(df) if fits(df, limit) else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose identifier is not in the one column of ``gone``, whatever their columns are called.

    ``gone`` should be a stored table: it is counted before it is joined.
    """
    name = fresh(docs, "gone_id")
    return docs.join(small_side(gone.toDF(name)), F.col(id_col).eqNullSafe(F.col(name)), "left_anti")


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = 512) -> None:
    """From now on the session sends at most so many rows at a time to Python tasks, for results that are written later; fewer stay as they are."""
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= rows:  # 0 and less: no bound
        spark.conf.set(_BATCH_ROWS, str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """Tables written within send whole texts to Python tasks so many at a time, which bounds the buffers on both sides; the setting is put back after."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches in turn, cut to so many rows: texts are made Python objects a few at a time, whatever the size of a batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_bytes(column) -> list[bytes]:
    """The byte strings of an Arrow text column; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers, another one for each seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CHUNK_BYTES = 250_000  # cutting takes some sixty bytes of memory for each
_BASE = 0x9E3779B97F4A7C15
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64), 5)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class WordCutter:
    """Cuts byte strings at ASCII white space and hashes the words, many texts at a time.

    A word's hash is a polynomial in its bytes' numbers, got from running sums; the factor its place puts on it is taken
    off again, which works because the base is odd.
    """

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, and how many each text has."""
        return self.places(texts)[3:]

    def places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts, where each word starts and ends in them, its hash, and how many each text has."""
        buf = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
        if len(self.up) <= len(buf):
            self.up, self.down = _powers(_BASE, len(buf) + 1), _powers(pow(_BASE, -1, 1 << 64), len(buf) + 1)
        space = _SPACE[buf]
        before = np.concatenate([[True], space[:-1]])
        starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[buf] * self.up[: len(buf)], dtype=np.uint64)])
        hashes = mixed((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64), 7)
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return buf, starts, ends, hashes, np.diff(np.searchsorted(starts, edges))


def chunks(texts: list, size: int = _CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The texts in turn, in lists of about ``size`` bytes; a longer text comes alone."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def shingle_sets(texts: list[bytes], k: int, cutter: WordCutter) -> Iterator[np.ndarray]:
    """For each text its distinct ``k``-word shingles as sorted 64-bit numbers.

    Words are cut at ASCII white space of the text in small ASCII letters. A text of fewer words is one shingle of all
    of them; one without words has none.
    """
    for some in chunks(texts):
        hashes, counts = cutter.cut(some)
        wide = np.full(max(0, len(hashes) - k + 1), k, np.uint64)
        for i in range(k):
            wide = mixed(wide + hashes[i : len(wide) + i], i + 1)
        end = 0
        for n in counts.tolist():
            start, end = end, end + n
            if n >= k:
                yield np.unique(wide[start : end - k + 1])
            elif n:
                s = np.full(1, n, np.uint64)
                for i in range(n):
                    s = mixed(s + hashes[start + i : start + i + 1], i + 1)
                yield s
            else:
                yield np.empty(0, np.uint64)


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Every node of the links ``(a, b)`` with the smallest node it is connected to: ``(node, component)``.

    Rounds of large-star and small-star, which need about log(size) of them; each is written to the shared folder and
    read back, so nothing but one fingerprint of the links reaches the driver. A hub's links may be many, but both steps
    only take minima per node (summed up before the shuffle) and join them back.
    """
    links = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label
    )
    last = None
    while True:
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        least2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least2, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        links = stored(small.where("a <> b").distinct(), label)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(
        F.min("component").alias("component")
    )
