"""Benchmark decontamination by winnowing.

Both sides are read as windows of ``span`` words. A window's fingerprint is the smallest hash among its k-grams, so equal
windows have equal fingerprints and neighbouring windows mostly share one. A run of windows with one fingerprint shows
it once, with the words the run covers; only runs whose fingerprint occurs in the benchmark go on, and there each
window is compared word for word. Every shared span of ``span`` words or more is found, and nothing else is.

Items shorter than ``span`` words are windows of their own length: each length that occurs gets a pass of its own with
k-grams cut to fit. All of it is DataFrame functions; the texts are read once per pass and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.llm.common import WORD_PATTERN, ascii_lower, let, small_side, without
from ticklattice.session import stored


#: Words before capitals are made small, for counting them.
ANY_CASE = r"[a-zA-Z\x{80}-\x{10FFFF}0-9]++"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def _fingerprints(words: Column, span: int, k: int) -> Column:
    """One number per window of ``span`` words: the smallest hash of its k-grams. Needs ``span`` words or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        if k == 1:
            return h
        return F.transform(F.sequence(F.lit(1), F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(k)]))

    def least(g: Column) -> Column:
        width = span - k + 1
        if width == 1:
            return g
        return F.transform(F.sequence(F.lit(1), F.size(g) - (width - 1)), lambda i: F.least(*[F.element_at(g, i + j) for j in range(width)]))

    return let(hashes, lambda h: let(grams(h), least))


def _runs(rows: DataFrame, span: int, k: int) -> DataFrame:
    """Adds a row per run of windows with one fingerprint: ``fp``, its first window ``at`` (from 1) and its ``words``."""
    long = rows.where(F.size("words") >= span).withColumn("f", _fingerprints(F.col("words"), span, k))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("f")), lambda i: (i == 1) | (F.element_at("f", i) != F.element_at("f", F.greatest(i - 1, F.lit(1))))
    )
    long = long.withColumn("starts", starts)
    run = F.transform(
        "starts",
        lambda at, i: F.struct(
            F.element_at("f", at).alias("fp"),
            at.alias("at"),
            F.slice("words", at, F.coalesce(F.get("starts", i + 1), F.size("f") + 1) - at + (span - 1)).alias("words"),
        ),
    )
    kept = [c for c in rows.columns if c != "words"]
    return long.select(*kept, F.explode(run).alias("r")).select(*kept, "r.fp", "r.at", "r.words")


def _windows(runs: DataFrame, span: int) -> DataFrame:
    """A row per window of each run: its first word ``at`` and its words as one string."""
    kept = [c for c in runs.columns if c not in ("fp", "words", "at")]
    each = F.transform(
        F.sequence(F.lit(1), F.size("words") - (span - 1)),
        lambda i: F.struct((F.col("at") + i - 1).alias("at"), F.array_join(F.slice("words", i, span), " ").alias("window")),
    )
    return runs.select(*kept, F.explode(each).alias("w")).select(*kept, "w.at", "w.window")


def hits(docs: DataFrame, items: DataFrame, *, span: int = 10, k: int = 5) -> DataFrame:
    """Occurrences of benchmark windows: ``doc_id, at, width, window`` over ``docs(doc_id, words)``.

    ``items`` has ``window`` and ``width`` of each benchmark window, each once.
    """
    found = None
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # span at most, each 1 to span
    for width in widths:
        gram = min(k, width) if width == span else max(1, (width + 1) // 2)
        mine = items.where(F.col("width") == width).select("window")
        fps = mine.select(F.split("window", " ").alias("words")).select(
            F.element_at(_fingerprints(F.col("words"), width, gram), 1).alias("fp")
        ).distinct()
        near = _runs(docs, width, gram).join(small_side(fps), "fp", "left_semi")
        got = _windows(near, width).join(small_side(mine), "window", "left_semi").select("doc_id", "at", F.lit(width).alias("width"), "window")
        found = got if found is None else found.union(got)
    return found


def benchmark_windows(benchmark: DataFrame, span: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, width, window``: windows of ``span`` words, or one of all words for a shorter item that has any."""
    words = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("width", F.least(F.lit(span), F.size("words")))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("width") + 1)
    rows = words.select("item_id", "width", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("width")), " "))).alias("window"))
    return rows.distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, span: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, item_ids, contaminated``.

    Words are runs of ASCII letters and digits and non-ASCII characters, in small ASCII letters. A word inside any
    occurrence of a window is hit. ``item_ids`` holds the items with occurring windows as sorted strings. Null and empty texts have no words
    and are clean, and so is everything when the benchmark is empty; items without words are passed over, and an item of
    a null identifier counts only as hit words. Rows repeated with one identifier are taken as one document in what is
    hit, each with its own word count. Very long texts are rows like any other. Other columns are not looked at.
    """
    items = stored(benchmark_windows(benchmark, span), "windows")
    texts = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(ANY_CASE))
    counts = docs.select(F.col(id_col).alias("doc_id"), n_words.cast("long").alias("n_words"))
    got = hits(texts, items.select("window", "width").distinct(), span=span, k=k)
    if got is None:
        none = F.array().cast("array<string>")
        return counts.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("item_ids"), F.lit(False).alias("contaminated"))
    got = stored(got.distinct(), "hits")
    before = W.partitionBy("doc_id").orderBy("at", "width").rowsBetween(W.unboundedPreceding, -1)
    spans = got.select("doc_id", "at", "width").distinct().withColumn("end", F.col("at") + F.col("width"))
    spans = spans.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("at", "reached"))
    n_hit = spans.groupBy("doc_id").agg(F.sum(fresh).cast("long").alias("n_hit"))
    owners = items.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item"))
    pairs = got.select("doc_id", "window").distinct().join(small_side(owners), "window").select("doc_id", "item").distinct()
    of_doc = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    facts = n_hit.join(of_doc, "doc_id", "left").withColumnRenamed("doc_id", "_id")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    rows = counts.join(facts, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), item_ids.alias("item_ids")
    )
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, span: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    found = contamination(docs, benchmark, span=span, id_col=id_col, text_col=text_col).where("contaminated")
    return without(docs, stored(found.select("doc_id").distinct(), "contaminated"), id_col)
