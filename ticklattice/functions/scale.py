"""Ordered operations over one key's rows that never need the whole key in one task.

A window ordered by time over ``partitionBy(symbol)`` puts every row of a symbol in one task, so a symbol holding a
third of the data decides the run time. The functions here cut each key's ordered rows into *slices* (ranges of the
order column), work inside a slice, and carry one small row per slice across the boundaries. The caller picks a slice
column that is monotone in the order and bounded in size, for instance ``trade_id div 65536`` or ``window div 4096``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE = "_slice"


def with_slice(df: DataFrame, column: str | Column, width: int, out: str = SLICE) -> DataFrame:
    """Add the slice number ``floor(column / width)``."""
    c = F.col(column) if isinstance(column, str) else column
    return df.withColumn(out, F.floor(c / F.lit(width)).cast("long"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` to ``spark.sql.shuffle.partitions`` tasks.

    The number is named so that adaptive execution keeps it: it merges partitions by their compressed size, and a few MB
    of sorted messages or ticks are hundreds in a task's memory.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_COMBINE = {
    "sum": (F.sum, lambda inside, carried: F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))),
    "max": (F.max, lambda inside, carried: F.greatest(inside, carried)),
    "min": (F.min, lambda inside, carried: F.least(inside, carried)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    exprs: Mapping[str, tuple[str, Column]],
    *,
    slice_col: str = SLICE,
    exclusive: bool = False,
) -> DataFrame:
    """Running ``sum``/``max``/``min`` per key in order, in two levels.

    ``exprs`` maps an output name to ``(kind, expression)``. With ``exclusive`` the current row is left out, and a row
    with nothing before it gets 0 for a sum and null for a max or min.
    """
    keys, order = list(keys), list(order)
    inside = W.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    before = W.partitionBy(*keys).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)

    totals = df.groupBy(*keys, slice_col).agg(*[_COMBINE[k][0](e).alias(f"_t_{n}") for n, (k, e) in exprs.items()])
    carried = totals.select(
        *keys, slice_col, *[_COMBINE[k][0](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (k, _) in exprs.items()]
    )
    out = df.select("*", *[_COMBINE[k][0](e).over(inside).alias(f"_i_{n}") for n, (k, e) in exprs.items()])
    out = out.join(carried, [*keys, slice_col], "left")
    return out.select(
        *[F.col(c) for c in df.columns],
        *[_COMBINE[k][1](F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n) for n, (k, _) in exprs.items()],
    )


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, slice_col: str = SLICE, out: str = "_idx"
) -> DataFrame:
    """Number each key's rows 0, 1, 2, … in order."""
    return running(df, keys, order, {out: ("sum", F.lit(1).cast("long"))}, slice_col=slice_col, exclusive=True)


def lag_one(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, str | Column], *, slice_col: str = SLICE
) -> DataFrame:
    """The previous row's values per key in order. ``cols`` maps output name to a source column or expression.

    Inside a slice this is ``lag``; the first row of a slice takes the last row of the nearest earlier slice.
    """
    keys, order = list(keys), list(order)
    packed = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])
    inside = W.partitionBy(*keys, slice_col).orderBy(*order)
    tails = df.groupBy(*keys, slice_col).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carried = tails.select(*keys, slice_col, F.lag("_tail").over(W.partitionBy(*keys).orderBy(slice_col)).alias("_carried"))
    out = df.withColumn("_prev", F.lag(packed).over(inside)).join(carried, [*keys, slice_col], "left")
    prev = F.coalesce("_prev", "_carried")
    return out.select(*[F.col(c) for c in df.columns], *[prev[n].alias(n) for n in cols])


def with_halo(
    df: DataFrame, index: str, width: int, back: int, ahead: int, *, block: str = "_block", home: str = "_home"
) -> DataFrame:
    """Copy rows near a block edge into the neighbouring blocks, so offset windows can run per block.

    Blocks are ``floor(index / width)``. A row is copied to every later block whose rows may look ``back`` positions
    back to it and every earlier block that may look ``ahead`` to it; ``home`` marks the one copy to keep.
    """
    i = F.col(index)
    own = F.floor(i / F.lit(width)).cast("long")
    first = F.floor((i - F.lit(ahead)) / F.lit(width)).cast("long")
    last = F.floor((i + F.lit(back)) / F.lit(width)).cast("long")
    return df.withColumn(block, F.explode(F.sequence(first, last))).withColumn(home, F.col(block) == own)


def rank_slices(value: Column) -> Column:
    """A slice number that is monotone in a positive value: 200 slices per factor of ten, one for what is infinite or no number."""
    return F.when(value < float("inf"), F.floor(F.log10(value) * F.lit(200)).cast("long")).otherwise(F.lit(2**31))
