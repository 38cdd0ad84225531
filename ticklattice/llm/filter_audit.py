"""How filters of a corpus overlap: what each removes in every order in which they can be applied.

A document's outcome under all filters is a mask of bits, one per filter. Documents are counted once into cells of a part and
a mask; everything else is worked out from the cells. A recursive query starts from each mask with nothing applied, and each
level of it extends every prefix of filters by every letter not used in it, carries the bits applied so far and says what the
step does to the mask: removes it, finds it gone, or leaves it. The cells then join these steps by their mask. The recursion's
size depends on the number of filters alone, so nothing of it grows with the documents or the parts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklattice.session import stored

#: Six filters make 64 masks by 1,957 prefixes, which is within Spark's row limit of a recursion.
MOST_FILTERS = 6
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _cells(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], copies: str | None, bits: Mapping[str, int], id_col: str, text_col: str, part_col: str
) -> DataFrame:
    """``part, mask, docs, good, toxic``: documents by part and by the bits of the filters they fail."""
    fails = [F.when(F.coalesce(cond, F.lit(False)), F.lit(bits[name])).otherwise(F.lit(0)) for name, cond in filters.items()]
    mask = sum(fails, F.lit(0))
    has_id = F.col(id_col).isNotNull()
    facts = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.when(has_id, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))).alias("digest"),
    )
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    facts = facts.join(marks, "id", "left").select(
        "id", "part", "mask", "digest", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    own = ["part", "mask", "good", "toxic"]
    # copies of a text are summed up before they meet: first by identifier, then all of them
    by_id = facts.groupBy("digest", *own, "id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy("digest", *own).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    if copies is None:
        rows = groups.select(*own, "n")
    else:
        groups = stored(groups, "groups")
        firsts = groups.where("digest is not null").groupBy("digest").agg(F.min("least.id").alias("first"), F.count("*").alias("kinds"))
        # a text of one kind holds its first identifier itself
        met = groups.join(firsts.where("kinds > 1").drop("kinds"), "digest", "left")
        stays = F.when(F.col("digest").isNull(), F.col("n")).when(F.col("first").isNull() | (F.col("least.id") == F.col("first")), F.col("least.n")).otherwise(0)
        both = F.array(F.struct(F.col("mask").alias("mask"), stays.alias("n")), F.struct((F.col("mask") + bits[copies]).alias("mask"), (F.col("n") - stays).alias("n")))
        rows = met.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0").select("part", "x.mask", "good", "toxic", "x.n")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("docs"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


_STEPS = """
    WITH RECURSIVE steps(mask, prefix, letter, bit, before, applied, step) AS (
        SELECT mask, '', '', 0, 0, 0, 0 FROM {masks}
        UNION ALL
        SELECT t.mask, concat(t.prefix, t.next.letter), t.next.letter, t.next.bit, t.applied, t.applied | t.next.bit, t.step + 1
        FROM (SELECT s.mask, s.prefix, s.applied, s.step, explode(filter({letters}, l -> (s.applied & l.bit) = 0)) AS next
              FROM steps s JOIN {masks} m ON m.mask = s.mask) t
    )
    SELECT mask, prefix, letter, step,
           (mask & applied) = 0 AS stays,
           (mask & bit) <> 0 AND (mask & before) = 0 AS goes,
           (mask & bit) <> 0 AND (mask & before) <> 0 AS gone,
           mask = bit AS alone
    FROM steps WHERE step > 0
"""


def filter_steps(masks: DataFrame, letters: Mapping[str, int]) -> DataFrame:
    """``mask, prefix, letter, step, stays, goes, gone, alone`` for each mask and each sequence of different filters."""
    table = ", ".join(f"named_struct('letter', '{letter}', 'bit', {bit})" for letter, bit in letters.items())
    return masks.sparkSession.sql(_STEPS.replace("{letters}", f"array({table})"), masks=masks)


def filter_interactions(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column],
    *,
    copies: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """Per part, order of all filters and step: ``part, filter_order, step, filter``, the METRICS and ``shapley``.

    ``filters`` gives conditions over ``docs`` under names of one letter, true where a document fails; ``copies`` names one more,
    which a text fails that a smaller identifier has anywhere. At each step of an order: ``kept`` documents after it, ``removed`` by it,
    ``redundant`` ones that fail it but were removed before, ``unique_fails`` that fail nothing else, ``good_lost`` and ``toxic_lost`` among the
    removed (``quality`` or ``toxic`` is 1 in any of the document's ``labels``), and ``shapley``, the filter's removals summed over all orders.

    A null condition counts as passed, a null part as the empty string and a null text as empty. A row without an identifier
    is no one's copy and has no labels. Rows repeated with one identifier count each and are no copies of each other. A part has its
    rows, zeros included, as soon as it has a document; an empty table gives none. Other columns of ``docs`` are not looked at.
    """
    names = sorted([*filters, *([copies] if copies else [])])
    if len(names) > MOST_FILTERS or len(set(names)) < len(names) or not all(len(n) == 1 and n.isalnum() for n in names):
        raise ValueError(f"at most {MOST_FILTERS} different filters with names of one letter")
    bits = {name: 1 << i for i, name in enumerate(names)}
    cells = stored(_cells(docs, labels, filters, copies, bits, id_col, text_col, part_col), "cells")
    steps = stored(filter_steps(cells.select("mask").distinct(), bits), "steps")  # bounded by MOST_FILTERS

    def total(flag: str, of: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(of)).otherwise(0))

    sums = (total("stays", "docs"), total("goes", "docs"), total("gone", "docs"), total("alone", "docs"), total("goes", "good"), total("goes", "toxic"))
    met = cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "letter", "step").agg(*[s.alias(m) for m, s in zip(METRICS, sums)])
    # an order begins with a prefix of length step in (filters - step)! ways
    ways = F.element_at(F.array(*[F.lit(math.factorial(len(names) - s)) for s in range(1, len(names) + 1)]), F.col("step"))
    met = met.withColumn("shapley", F.sum(F.col("removed") * ways).over(W.partitionBy("part", "letter")))
    orders = steps.where(F.col("step") == len(names)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("n")).select("filter_order", F.expr("substring(filter_order, 1, n)").alias("prefix"))
    return met.join(F.broadcast(orders), "prefix").select("part", "filter_order", "step", F.col("letter").alias("filter"), *METRICS, "shapley")
