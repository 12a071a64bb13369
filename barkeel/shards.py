"""Arrow-batched work on bounded groups of rows.

``sharded_map`` is the engine's one way into Python for ordered per-group state.
It hashes rows by the group key, sorts inside the partitions and streams Arrow
batches, so a task holds one batch plus the one group that is still open.  The
callers choose keys that bound a group (a time block of a series, a block of
record numbers), never a whole source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Kernel = Callable[[pa.Table, np.ndarray], pa.Table]


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins, the first row included."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    new[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices
        c = codes.to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _stream(batches: Iterator[pa.RecordBatch], keys: list[str], kernel: Kernel) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        starts = group_starts(table, keys)
        first = tuple(table.column(k)[0].as_py() for k in keys)
        if held and first == last and len(starts) == 1:
            held.append(table)  # the open group goes on through the whole batch
            continue
        # the batch's last group stays open; everything before it is complete
        cut = int(starts[-1])
        done = pa.concat_tables([*held, table.slice(0, cut)]) if held else table.slice(0, cut)
        if done.num_rows:
            done = done.combine_chunks()
            yield from kernel(done, group_starts(done, keys)).to_batches()
        held = [table.slice(cut)]
        last = tuple(table.column(k)[cut].as_py() for k in keys)
    if held:
        done = pa.concat_tables(held).combine_chunks()
        yield from kernel(done, group_starts(done, keys)).to_batches()


def sharded_map(df: DataFrame, keys: list[str], order: list[str], kernel: Kernel, schema: str) -> DataFrame:
    """Apply ``kernel(table, group_starts)`` to whole groups, many groups a call."""
    arranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return arranged.mapInArrow(lambda batches: _stream(batches, keys, kernel), schema)


def ordered_stream(df: DataFrame, keys: list[str], order: list[str], fold: type, arguments: tuple, schema: str) -> DataFrame:
    """Run one ``fold`` object along each group, batch by batch, in order.

    ``fold(*arguments)`` is made at a group's start; ``feed(table)`` takes the next
    stretch of it and ``close()`` ends it; both return a table of results or None.
    A task holds one batch and one fold's state, however long a group is.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            starts = group_starts(table, keys)
            out = []
            for s, e in zip(starts, [*starts[1:], table.num_rows]):
                key = tuple(table.column(k)[int(s)].as_py() for k in keys)
                if current is None or key != last:
                    if current is not None:
                        out.append(current.close())
                    current, last = fold(*arguments), key
                out.append(current.feed(table.slice(int(s), int(e - s))))
            for t in out:
                if t is not None and t.num_rows:
                    yield from t.to_batches()
        if current is not None:
            t = current.close()
            if t is not None and t.num_rows:
                yield from t.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)
