"""Cells (day x metric x tag) that hold mergeable states, and their cube.

A state is a binary value.  Three stages share this code: tasks build partial
states from their rows; states of one cell are merged; merged cells are rolled
up to every combination of the three dimensions, again merged in each task
before they are shuffled.  A coarse cell thus receives one state a task, never
its rows, however hot it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.session import parallelism

KEYS = ["kind", "sets", "day", "metric", "tag"]
SCHEMA = "kind int, sets int, day date, metric string, tag string, state binary"
_ARROW = pa.schema([("kind", pa.int32()), ("sets", pa.int32()), ("day", pa.date32()), ("metric", pa.string()), ("tag", pa.string()), ("state", pa.binary())])
#: bits of ``sets``: which dimensions a cell is split by
BY_DAY, BY_METRIC, BY_TAG = 4, 2, 1
ALL_SETS = BY_DAY | BY_METRIC | BY_TAG


def emit(cells: dict[tuple, bytes]) -> Iterator[pa.RecordBatch]:
    items = list(cells.items())
    for a in range(0, len(items), 256):
        part = items[a : a + 256]
        cols = list(zip(*(k for k, _ in part)))
        arrays = [pa.array(c, f.type) for c, f in zip(cols, _ARROW)] + [pa.array([s for _, s in part], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def codes(columns: list[pa.Array | pa.ChunkedArray], names: bool = True) -> tuple[np.ndarray, list[tuple]]:
    """Codes 0, 1, ... of the distinct rows of ``columns`` and what the codes stand for."""
    code, known, size = np.zeros(len(columns[0]), np.int64), [()], 1
    if not len(code):
        return code, []
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        n = len(d.dictionary)
        both = code * n + d.indices.to_numpy(zero_copy_only=False)
        if size * n <= 8 * len(code) + 1024:  # a table of what occurs instead of sorting
            seen = np.zeros(size * n, bool)
            seen[both] = True
            uniq = np.flatnonzero(seen)
            place = np.cumsum(seen) - 1
            code = place[both]
        else:
            uniq, code = np.unique(both, return_inverse=True)
        size = len(uniq)
        if names:
            values = d.dictionary.to_pylist()
            known = [(*known[u // n], values[u % n]) for u in uniq.tolist()]
    return code, known


factor = codes


#: Merges states of many cells at once: (cell of each state, states, number of cells) ->
#: (cells, states) of all cells that have one, in any number of parts.
Many = Callable[[np.ndarray, pa.Array, int], Iterator[tuple[np.ndarray, pa.Array]]]


def payload(states: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all states one after the other, and where each begins."""
    if isinstance(states, pa.ChunkedArray):
        states = states.combine_chunks()
        if isinstance(states, pa.ChunkedArray):
            states = pa.concat_arrays(states.chunks) if states.num_chunks else pa.array([], pa.binary())
    if not len(states):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = states.buffers()
    at = np.frombuffer(at, np.int32)[states.offset : states.offset + len(states) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def binary(sizes: np.ndarray, data: bytes) -> pa.Array:
    """States of the given sizes from their bytes one after the other."""
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])


def batches_of(t: pa.Table | pa.RecordBatch, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """``t`` in batches of some ``most_bytes`` at most (one row at least)."""
    if t.num_rows:
        rows = max(1, min(10_000, int(t.num_rows * most_bytes / max(t.nbytes, 1))))
        yield from t.to_batches(max_chunksize=rows) if isinstance(t, pa.Table) else (t.slice(a, rows) for a in range(0, t.num_rows, rows))


def combine(t: pa.Table, many: Many) -> pa.Table:
    """One row a cell, from rows in any order."""
    cell, _ = codes([t.column(k) for k in KEYS], names=False)
    n = int(cell.max()) + 1 if len(cell) else 0
    if n == t.num_rows:
        return t
    first = np.zeros(n, np.int64)
    first[cell[::-1]] = np.arange(len(cell))[::-1]
    times = np.bincount(cell, minlength=n)
    alone = times[cell] == 1
    parts = [t.filter(pa.array(alone))]
    rest = np.flatnonzero(~alone)
    for c, s in many(cell[rest], t.column("state").take(pa.array(rest)), n):
        parts.append(t.select(KEYS).take(pa.array(first[c])).append_column("state", s))
    return pa.concat_tables(parts)


def merge_sorted(many: Many, most_bytes: int = 24_000_000) -> Callable:
    """A map over rows sorted by cell that merges the states of each.  What the last cell has so
    far is kept as one state, so a cell of any number of states takes the memory of a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in (p for b in batches for p in batches_of(b)):
            held.append(b)
            size += b.nbytes
            if size > most_bytes:
                t = pa.Table.from_batches(held)
                same = np.ones(t.num_rows, bool)
                for k in KEYS:
                    c = t.column(k).dictionary_encode(null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False)
                    same &= c == c[-1]
                cut = t.num_rows - int((~same[::-1]).argmax()) if not same.all() else 0
                yield from batches_of(combine(t.slice(0, cut), many))
                last = combine(t.slice(cut), many)
                held, size = last.to_batches(), last.nbytes
        if held:
            yield from batches_of(combine(pa.Table.from_batches(held), many))

    return run


def coarser_sets(sets: int, dimensions: int) -> list[int]:
    """``sets`` without any of the given dimensions, in all combinations."""
    return [w for w in range(ALL_SETS + 1) if w | dimensions == sets | dimensions and w & ~sets == 0]


def merger(merge: Callable[[list[bytes]], bytes], most_bytes: int, rollup: int) -> Callable:
    """A map over state rows that merges what it has seen of a cell; flushes when
    it holds ``most_bytes``.  Each cell also goes to the coarser ones without dimensions of ``rollup``."""
    wants = {sets: coarser_sets(sets, rollup) for sets in range(ALL_SETS + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            yield from emit({k: merge(v) for k, v in held.items()})
            held.clear()
            size = 0

        for b in batches:
            *keys, states = (c.to_pylist() for c in b.columns)
            for kind, sets, day, metric, tag, s in zip(*keys, states):
                for want in wants[sets]:
                    k = (kind, want, day if want & BY_DAY else None, metric if want & BY_METRIC else None, tag if want & BY_TAG else None)
                    got = held.setdefault(k, [])
                    got.append(s)
                    size += len(s)
                    if len(got) >= 16:
                        size -= sum(map(len, got))
                        held[k] = got = [merge(got)]
                        size += len(got[0])
                if size > most_bytes:
                    yield from flush()
        yield from flush()

    return run


def merge_cells(states: DataFrame, merge: Callable[[list[bytes]], bytes], many: Many, most_bytes: int = 48_000_000, rollup: int = 0) -> DataFrame:
    """States with one row a cell; also of the cells without dimensions of ``rollup``, in all combinations."""
    part = states.mapInArrow(merger(merge, most_bytes, rollup), SCHEMA) if rollup else states
    n = parallelism(states.sparkSession, 1)
    return part.repartition(n, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(merge_sorted(many), SCHEMA)


def roll_tags(states: DataFrame, many: Many) -> DataFrame:
    """Merged cells with their coarser ones, tag by tag; no tag is merged into another or into the
    cells without tag, as the rows of several tags are the same.  Each cell is shuffled once; a task
    sees the days and metrics of one tag, so this is for tags whose states are small."""
    n = parallelism(states.sparkSession, 1)
    return states.repartition(n, "tag").sortWithinPartitions("tag").mapInArrow(_tag_roller(many), SCHEMA)


def _tag_roller(many: Many, most_bytes: int = 24_000_000) -> Callable:
    def coarser(t: pa.Table, keep: int) -> pa.Table:
        sets = pa.array(np.bitwise_and(t.column("sets").to_numpy(), BY_TAG) | keep, pa.int32())
        none = lambda k: pa.nulls(t.num_rows, _ARROW.field(k).type)
        return pa.Table.from_arrays([t.column("kind"), sets, t.column("day") if keep == BY_DAY else none("day"), t.column("metric") if keep == BY_METRIC else none("metric"), t.column("tag"), t.column("state")], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        coarse = {keep: _ARROW.empty_table() for keep in (BY_DAY, BY_METRIC, 0)}
        size = 0

        def work(end: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).cast(_ARROW)
            yield from batches_of(t)
            tag = t.column("tag")[-1]
            for keep, was in coarse.items():
                now = combine(pa.concat_tables([was, coarser(t, keep)]), many)
                if not end:  # the last tag may go on
                    mine = now.column("tag").is_null() if not tag.is_valid else pc.fill_null(pc.equal(now.column("tag"), tag), False)
                    yield from batches_of(now.filter(pc.invert(mine)))
                    now = now.filter(mine)
                coarse[keep] = now

        for b in (p for b in batches for p in batches_of(b)):
            held.append(b)
            size += b.nbytes
            if size > most_bytes:
                yield from work(False)
                held, size = [], 0
        if held:
            yield from work(True)
        for t in coarse.values():
            yield from batches_of(t)

    return run


def describe(cells: DataFrame) -> DataFrame:
    """Readable columns: which dimensions a row is split by, and their values."""
    by = lambda bit: (F.col("sets").bitwiseAND(bit) != 0)
    return cells.withColumns({"by_day": by(BY_DAY), "by_metric": by(BY_METRIC), "by_tag": by(BY_TAG)}).drop("sets")
