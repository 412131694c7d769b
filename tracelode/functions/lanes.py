"""Helpers for Python stages which work on many groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows a stage gathers before it works; keeps memory flat and arrays long.
CHUNK_ROWS = 250_000


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (the last may be less) that never cut a
    group; needs the input in runs of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        last = np.ones(n, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            last &= c == c[-1]
        cut = n - int(last[::-1].argmin()) if not last.all() else 0
        if not cut:
            continue  # one group so far: read on
        yield t.slice(0, cut)
        rest = t.slice(cut).combine_chunks()
        held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)


def runs(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(cols[0])
    if not n:
        return np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)
