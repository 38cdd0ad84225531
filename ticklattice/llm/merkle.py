"""Merkle manifest of a dataset: a digest per row, a tree per group of rows, a tree over the groups, and each row's proof.

The rows of a group are numbered in order of their identifier and cut into aligned blocks of ``fanout ** levels`` leaves; each
block works out its own subtree. Blocks then take part in a butterfly exchange. In round r the ``fanout`` blocks whose numbers differ in
digit r alone swap the roots they hold; each of them hashes all of these into the next ancestor, so that every block holds each
ancestor above it and has seen its siblings. After the last round all blocks hold the group's root and their whole upper
proof, and nothing has to be sent down again. A block of a ragged end stands in for the missing ones beside it.
The groups' roots are the leaves of one more tree, made the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.llm.common import small_side
from ticklattice.session import stored

#: Rows of a block's upper proof are a few kilobytes; so many are sent to every task at most.
PROOF_ROWS = 20_000


def hashed(*parts: Column) -> Column:
    """Small hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the value's length in bytes, a colon and the value, so that values cannot run into one another."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return hashed(*[framed(f) for f in fields])


def group_key(group: Column) -> Column:
    """A key without nulls in the group's order: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, s: hashed(s["before"], node, s["after"]))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _numbered(leaves: DataFrame) -> DataFrame:
    """Adds each leaf's place ``pos`` in its group, from 0, and the group's ``total``. Leaves come as ``key, ord, leaf, payload``.

    Rows are dealt to ranges of key, order and digest, so that a group may be spread over all tasks; a range numbers its own rows.
    """
    ranges = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "ord", "leaf"]
    placed = leaves.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = stored(placed.select("*", F.monotonically_increasing_id().alias("at")), "leaves").withColumn("range", F.shiftright("at", 33))
    runs = placed.groupBy("key", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    every = W.partitionBy("key")  # a row per range at most
    before = every.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("key", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(every).alias("total"))
    runs = stored(runs, "runs")
    return placed.join(small_side(runs), ["key", "range"]).select("key", "leaf", "payload", (F.col("start") + F.col("at") - F.col("first")).alias("pos"), "total")


def _joined(nodes: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(nodes, start, length), "")


def _blocks(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``key, block, n_blocks, root, first, payload, leaf, proof``: each leaf with its proof inside its block and the block's root; one leaf is ``first``.

    A block's leaves and proofs are megabytes, and Parquet writes and reads rows by the hundred or thousand, so blocks are stored leaf by leaf.
    """
    size = fanout**levels
    rows = leaves.withColumn("block", F.floor(F.col("pos") / size)).groupBy("key", "block", "total").agg(
        F.sort_array(F.collect_list(F.struct("pos", "leaf", "payload"))).alias("rows")
    )
    # a group of one block ends at a single node, all others' blocks are raised by all levels
    n, single = F.size("rows"), F.col("total") <= size
    height = F.when(single, sum(((n > fanout**j).cast("int") for j in range(levels)), F.lit(0))).otherwise(levels)
    rows = rows.withColumn("n_blocks", F.ceil(F.col("total") / size)).withColumn("height", height)
    rows = rows.withColumn("level0", F.transform("rows", lambda r: r["leaf"]))
    for j in range(levels):
        below = F.col(f"level{j}")
        raised = F.transform(F.sequence(F.lit(1), F.size(below), F.lit(fanout)), lambda i: F.sha2(_joined(F.col(f"level{j}"), i, F.lit(fanout)), 256))  # noqa: B023
        rows = rows.withColumn(f"level{j + 1}", F.when(F.col("height") > j, raised).otherwise(below))

    def siblings(j: int, i: Column) -> Column:
        at = F.floor(i / fanout**j).cast("int")
        start = at - at % fanout
        return F.struct(
            _joined(F.col(f"level{j}"), start + 1, at - start).alias("before"), _joined(F.col(f"level{j}"), at + 2, start + (fanout - 1) - at).alias("after")
        )

    proofs = F.transform(
        "rows",
        lambda r, i: F.struct(
            (i == 0).alias("first"), r["payload"].alias("payload"), r["leaf"].alias("leaf"),
            F.slice(F.array(*[siblings(j, i) for j in range(levels)]), F.lit(1), F.col("height")).alias("proof"),
        ),
    )
    return rows.select("key", "block", "n_blocks", F.element_at(f"level{levels}", 1).alias("root"), F.inline(proofs))


_UPPER = "array<struct<before:string,after:string>>"


def _butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """``key, block, root, upper``: the group's root and the siblings above each block, after as many rounds as the most blocks need."""
    state = blocks.select("key", "block", "n_blocks", "root", F.array().cast(_UPPER).alias("upper"))
    most = state.agg(F.max("n_blocks")).first()[0] or 1
    reach, real = 1, F.col("block") < F.col("n_blocks")
    while reach < most:
        state = stored(_round(state, fanout, reach), "butterfly")
        reach *= fanout
    return state.where(real).select("key", "block", "root", "upper")


def _round(state: DataFrame, fanout: int, reach: int) -> DataFrame:
    """One swap among the blocks that are ``reach`` apart. All blocks of a span of ``reach`` hold that span's root."""
    done, active = state.where(F.col("n_blocks") <= reach), state.where(F.col("n_blocks") > reach)
    if reach > 1:
        # the last span may lack blocks; those it has, a whole number of the spans below, stand in for the missing ones
        lower = reach // fanout
        spans = F.ceil(F.col("n_blocks") / reach)
        has = (F.ceil(F.col("n_blocks") / lower) * lower - (spans - 1) * reach).cast("bigint")
        start = ((spans - 1) * reach).cast("bigint")
        places = F.when(F.col("block") < start, F.array("block")).otherwise(F.sequence(F.col("block"), start + reach - 1, has))
        active = active.withColumn("block", F.explode(places))
    met = active.select(
        "key", "n_blocks", F.floor(F.col("block") / (reach * fanout)).alias("high"), (F.col("block") % reach).alias("low"),
        F.struct((F.floor(F.col("block") / reach) % fanout).alias("digit"), "root", "block", "upper").alias("me"),
    )
    groups = met.groupBy("key", "n_blocks", "high", "low").agg(F.sort_array(F.collect_list("me")).alias("all"))  # fanout blocks at most
    each = groups.select("key", "n_blocks", "all", F.explode("all").alias("me"))
    roots = lambda keep: F.array_join(F.transform(F.filter("all", keep), lambda x: x["root"]), "")
    before, after = roots(lambda x: x["digit"] < F.col("me.digit")), roots(lambda x: x["digit"] > F.col("me.digit"))
    swapped = each.select("key", F.col("me.block").alias("block"), "n_blocks", "me.root", "me.upper", before.alias("before"), after.alias("after"))
    swapped = swapped.select(
        "key", "block", "n_blocks", hashed(F.col("before"), F.col("root"), F.col("after")).alias("root"), F.concat("upper", F.array(F.struct("before", "after"))).alias("upper")
    )
    return swapped.union(done)


def _tree(leaves: DataFrame, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """The blocks with their leaves, and what each block knows of the nodes above it."""
    blocks = stored(_blocks(_numbered(leaves), fanout, levels), "blocks")
    return blocks, stored(_butterfly(blocks.where("first").select("key", "block", "n_blocks", "root"), fanout), "uppers")


def manifest(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    claimed: Column | None = None,
    fanout: int = 8,
    levels: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, claimed, subroot, root, proof``.

    ``leaf`` is the digest of the row's ``fields``, ``subroot`` the root of its group's tree, whose leaves ascend by identifier, and ``root`` that of the
    tree over the subroots in order of their groups, the null group first. ``proof`` holds the siblings of each level, from the leaf to the root, as two
    strings of digests, those before and those after the node: ``fold(leaf, proof)`` is the root. ``claimed`` is a digest handed along beside each
    row, such as that of a copy to be checked; it is the leaf's own by default.

    Null fields have a mark of their own, so null and empty differ. Rows of one identifier, a null one included, are in order of their digests; repeated rows
    are leaves of their own with equal digests. Texts of any length are hashed whole, before anything is moved. Other columns are not looked at; an
    empty table gives no rows. A block holds ``fanout ** levels`` digests at most, whatever the size of its group.
    """
    leaf = leaf_digest([F.col(f) for f in fields])
    own = docs.select(group_key(F.col(group_col)).alias("key"), F.col(id_col).alias("ord"), leaf.alias("leaf"), (leaf if claimed is None else claimed).alias("claimed"))
    other = F.when(~F.col("claimed").eqNullSafe(F.col("leaf")), F.struct(F.col("claimed")))  # kept only where it differs
    own = own.select("key", "ord", "leaf", F.struct(F.col("ord").alias("id"), other.alias("other")).alias("payload"))
    blocks, uppers = _tree(own, fanout, levels)

    subroots = uppers.where("block = 0").select(F.lit("").alias("key"), F.col("key").alias("ord"), F.col("root").alias("leaf"), F.struct(F.col("key").alias("group")).alias("payload"))
    top_blocks, top_uppers = _tree(subroots, fanout, levels)
    tops = top_blocks.drop("root").join(small_side(top_uppers, PROOF_ROWS), ["key", "block"]).select(
        F.col("payload.group").alias("key"), F.col("root").alias("top"), F.concat("proof", "upper").alias("over")
    )
    uppers = uppers.join(small_side(stored(tops, "tops"), PROOF_ROWS), "key").select("key", "block", F.col("root").alias("subroot"), "top", F.concat("upper", "over").alias("upper"))
    uppers = stored(uppers, "uppers")
    rows = blocks.drop("root", "n_blocks", "first").join(small_side(uppers, PROOF_ROWS), ["key", "block"])
    return rows.select(
        F.col("payload.id").alias("doc_id"),
        "leaf",
        F.when(F.col("payload.other").isNull(), F.col("leaf")).otherwise(F.col("payload.other.claimed")).alias("claimed"),
        "subroot",
        F.col("top").alias("root"),
        F.concat("proof", "upper").alias("proof"),
    )
