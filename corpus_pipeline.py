"""A text corpus from raw documents to token ids: toxicity, copies, near copies, benchmark passages, tokens.

Each stage takes what the stage before kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticklattice.llm.common import bound_batches, table
from ticklattice.llm.decontamination import drop_contaminated
from ticklattice.llm.exact_dedup import drop_exact_duplicates
from ticklattice.llm.jaccard_join import drop_near_duplicates
from ticklattice.llm.piece_codec import encode, model_bytes
from ticklattice.llm.queries import TOKENIZER
from ticklattice.llm.toxicity import drop_toxic
from ticklattice.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents found toxic by a model fitted on the labelled ones among them go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    return drop_exact_duplicates(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % equal five-word shingles the one with the smallest identifier stays."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item, or hold a shorter item, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), span=10)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the ids of the whole text and whether they decode to it again.

    The rows are made when the result is written, after this returns, so the smaller Arrow batches are the session's from here on.
    """
    bound_batches(spark)
    return encode(docs, model_bytes(TOKENIZER), ids_col="token_ids", check_col="decodes_back")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece", token_ids),
]

#: A trained model and a tokenizer are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
