"""Sequential folds over ordered messages.

Some operators depend on the order of every message (a depth-limited book, a sequence check). Messages are cut into groups
that need nothing from each other, such as runs of epochs that begin with a full snapshot. Spark deals the groups out and
sorts each task's rows; the fold then goes over them a batch at a time with the state in memory, so a task holds one batch
and one state, however long a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticklattice.functions.scale import spread

# fold(state or None, messages in order) -> (output rows, state after)
Fold = Callable[[dict | None, pa.Table], tuple[pa.Table, dict]]


def ordered_fold(messages: DataFrame, group: Sequence[str], order: Sequence[str], fold: Fold, out_schema: str) -> DataFrame:
    """Fold each group's messages in ``order``, starting without a state, and return the rows the fold puts out."""
    group = list(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for start, end in _stretches(table, group):
                part = table.slice(start, end - start)
                key = tuple(part.column(k)[0].as_py() for k in group)
                if key != now:
                    state, now = None, key
                out, state = fold(state, part)
                yield from out.to_batches()

    rows = spread(messages, *group).sortWithinPartitions(*group, *order)
    return rows.mapInArrow(run, out_schema)


def _stretches(table: pa.Table, group: Sequence[str]) -> Iterator[tuple[int, int]]:
    """From and to of the rows of each group in a sorted table."""
    new = np.zeros(table.num_rows, bool)
    for k in group:
        codes = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), table.num_rows]
    yield from zip(edges[:-1], edges[1:]) if table.num_rows else ()
