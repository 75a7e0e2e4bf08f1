"""Runs of rows of one key inside a sorted partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def _edges(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The rows at which another key begins, the first row included."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def by_runs(keys: Sequence[str], fn: Callable[[pa.Table, list[int]], pa.RecordBatch | None]):
    """For ``mapInArrow`` over rows sorted by ``keys``: ``fn`` gets whole runs, as a table and the edges of its runs.

    Keys hold no nulls. What is held is one batch of rows and one run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            edges = _edges(table, keys)
            held = table.slice(int(edges[-1]))
            if len(edges) > 1:
                out = fn(table.slice(0, int(edges[-1])), edges.tolist())
                if out is not None and out.num_rows:
                    yield out
        if held is not None:
            out = fn(held, [0, held.num_rows])
            if out is not None and out.num_rows:
                yield out

    return run
