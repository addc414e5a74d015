"""Groups that stand next to one another in sorted Arrow batches, without one Python call per group in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the borders of the groups in them. The rows must be sorted by key, an integer without
    nulls; the last group of a batch waits for the next batch. A table is never more than a batch and one group."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            done = table.slice(0, cut).combine_chunks()
            yield done, borders(keys[:cut])
        rest = table.slice(cut)
    if rest is not None:
        rest = rest.combine_chunks()
        yield rest, np.array([0, rest.num_rows])


def borders(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def least_linked(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links the least id (of rows and cols) that it reaches inside the matrix."""
    row_least, col_least = rows.copy(), cols.copy()
    r, c = np.nonzero(linked)
    while True:
        before = row_least.copy(), col_least.copy()
        np.minimum.at(row_least, r, col_least[c])
        np.minimum.at(col_least, c, row_least[r])
        if np.array_equal(before[0], row_least) and np.array_equal(before[1], col_least):
            return row_least, col_least
