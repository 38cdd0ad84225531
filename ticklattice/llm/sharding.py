"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from the record's key and its own; the largest draw, stretched by the shard's weight, wins.
A shard's draws do not depend on the other shards, so one more shard takes records to itself and moves no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbering is done in so many parts of a shard at once.
PARTS = 1024


def _draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential race: with u uniform in (0, 1), ``weight / -ln(u)`` wins in proportion to its weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return F.lit(float(weight)) / -F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to ``len(weights) - 1``, of a key."""
    draws = [F.struct(_draw(key, s, w).alias("draw"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["shard"]


def shards(docs: DataFrame, n_shards: int | None = None, *, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``grown_shard`` is the shard after one more of weight 1 is added. ``slot`` numbers a shard's rows from 0 without gaps,
    in parts: a part's rows are numbered on their own and moved up by the rows of the parts before it. Rows without an
    identifier all go to one shard, as they share the null key; repeated rows go to one shard and get slots of their own.
    A null or empty text has size 8 and checksum 0. An empty table gives no rows; other columns are not looked at.
    """
    weights = list(weights) if weights is not None else [1.0] * n_shards
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, 1.0]).alias("grown_shard"),
    )
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("part")), F.lit(PARTS)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    # starts has len(weights) x PARTS rows at most
    return rows.withColumn("inside", inside).join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("inside") - 1).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], *, id_col: str = "doc_id", files_per_shard: int = 16) -> None:
    """The rows with all their columns as Parquet, one folder ``_shard=N`` per shard, each in several files."""
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("file")), F.lit(files_per_shard))
    placed = docs.withColumn("_shard", rendezvous(F.col(id_col), weights))
    placed.repartition(len(weights) * files_per_shard, "_shard", part).write.partitionBy("_shard").parquet(path)
