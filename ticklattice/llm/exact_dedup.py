"""Exact deduplication by a tree of merges over sorted runs of digests.

Rows are dealt to leaves by a hash of their identifier, so copies of one text, however many, are spread evenly. A leaf
turns its rows into a run: one entry per text, in digest order, with the identifier to keep and the number of copies. In
each round ``fan_in`` neighbouring nodes exchange their runs with the node above, which merges them; a node of a higher
level is cut into as many digest ranges as it has children below, so each round has the same number of tasks, whatever
the level. The answer then travels down the same tree, so no join ever sees more than ``fan_in`` rows of one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.llm.common import fits, fresh, small_side, without
from ticklattice.session import stored

#: A text's key: its digest, and its length and a second hash by which equal digests are verified.
KEY = ["digest", "n_bytes", "check"]


def _merged(run: DataFrame, fan_in: int, level: int, best) -> DataFrame:
    """The runs one level up: neighbours' sorted runs meet per digest range and entries of one text become one."""
    ranges = fan_in**level
    moved = run.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")).withColumn(
        "range", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(ranges)).cast("int")
    )
    sorted_runs = moved.repartition("node", "range").sortWithinPartitions("node", "range", *KEY)
    return sorted_runs.groupBy("node", "range", *KEY).agg(best("keep_id").alias("keep_id"), F.sum("size").alias("size")).drop("range")


def exact_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", nodes: int = 256, fan_in: int = 4
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names which identifier of a group stays, ``smallest`` or ``largest``. A null text counts as empty, and
    empty texts are copies of each other. Of rows repeated with one identifier, one is kept. A null identifier counts as
    beyond all others, so it is kept only in a group without any. Other columns of ``docs`` are not looked at. An empty table
    gives no rows. Texts of any length are hashed whole.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.pmod(F.xxhash64(id_col), F.lit(nodes)).cast("int").alias("node"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )
    rows = stored(rows, "digests")
    levels = [stored(rows.groupBy("node", *KEY).agg(best("doc_id").alias("keep_id"), F.count("*").alias("size")), "runs")]
    width = nodes
    while width > 1:
        levels.append(stored(_merged(levels[-1], fan_in, len(levels), best), "runs"))
        width = -(-width // fan_in)
    answer = levels[-1]
    for run in reversed(levels[:-1]):
        below = run.select("node", *KEY, F.floor(F.col("node") / fan_in).cast("int").alias("above"))
        answer = below.join(answer.withColumnRenamed("node", "above"), ["above", *KEY]).drop("above")
    first = F.row_number().over(W.partitionBy("node", *KEY, "doc_id").orderBy(F.lit(1)))
    return rows.withColumn("copy", first).join(answer, ["node", *KEY]).select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Rows go by their identifier. Only identifiers of which some rows stay and some go are looked at once more, text by text.
    """
    found = stored(exact_duplicates(docs, id_col=id_col, text_col=text_col, keep=keep).select("doc_id", "kept", "text_sha256"), "kept")
    by_id = found.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all"))
    changed = stored(by_id.where(~F.col("all")), "changed")
    left = without(docs, changed.select("doc_id"), id_col)
    partly = changed.where("some").select("doc_id")
    if fits(partly, 0):
        return left
    ident, digest, sha = (fresh(docs, c) for c in ("kept_id", "kept_digest", "kept_sha"))
    again = docs.join(small_side(partly.toDF(ident)), F.col(id_col).eqNullSafe(F.col(ident)), "left_semi")
    again = again.withColumn(digest, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    stays = found.where("kept").join(small_side(partly.toDF("i")), F.col("doc_id").eqNullSafe(F.col("i")), "left_semi").select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha))
    again = again.join(small_side(stays), F.col(id_col).eqNullSafe(F.col(ident)) & (F.col(digest) == F.col(sha)), "left_semi")
    return left.union(again.dropDuplicates([id_col, digest]).drop(digest))
