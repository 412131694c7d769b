"""Percentiles of very large numeric columns from dyadic Count-sketches (problem 7).

A value is encoded to ``BITS`` bits so that codes sort as values do (sign,
exponent and first mantissa bits of the double).  For every binary resolution
of the codes there is one signed Count-sketch of how many values fall into each
dyadic range; the coarsest resolution down to ``EXACT`` bits is counted
exactly.  Sketches merge by addition, and a deletion is an addition with
negative weight.  A rank is inverted by descending the resolutions: at each one
the estimated count of the left half decides where to go.

A cell keeps its codes with their weights as long as it has seen at most
``lossless`` (by default ``LOSSLESS``) distinct ones; that merges the same way,
and turns into the sketch beyond.  Codes whose weight has fallen to zero still
count as seen, so which form a cell ends in is fixed by its content and not by
the order of merging or deleting.  With ``lossless=0`` every cell is a sketch.

Error: a reported value is off by at most 2^-(BITS-11) relative from encoding.
Its rank is off by the errors of the descended levels; each is the spread of
the ``DEPTH`` independent estimates of a count, and ``rank_error`` reports three
standard deviations of their sum, relative to n, for the worst of the asked
ranks (0 for cells that kept their codes).

Defined results: NULL and NaN are left out; infinities sort at the ends; a
repeated row counts each time; cells without values do not appear; codes that
were deleted more often than they were added count as absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.lanes import runs
from tracelode.functions.series import metric_name, tag_entries
from tracelode.llm import cells as C
from tracelode.llm.distinct import _mix
from tracelode.session import cut, small

BITS, EXACT, DEPTH, WIDTH, LOSSLESS = 26, 12, 5, 512, 4096
LEVELS = BITS - EXACT  # level l has ranges of 2^l codes, 0 <= l < LEVELS
_SIZE = (1 << EXACT) + LEVELS * DEPTH * WIDTH
_CHUNK, _MOST_BYTES = 100_000, 32_000_000
SEP = "\x01"  # what stands between key and value of a tag
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
# a kept code is one 64-bit word: code, then weight from -2^36 on; a sketch is told by its size
_WEIGHT, _CODE = 37, (1 << BITS) - 1
_HALF, _LOW = 1 << (_WEIGHT - 1), (1 << _WEIGHT) - 1
#: Standard deviation of the median of five, relative to the distance of the second and fourth of them.
_MEDIAN_SD = 0.54


def encode(v: np.ndarray) -> np.ndarray:
    i = (np.asarray(v, np.float64) + 0.0).view(np.int64)
    i = i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    return (i >> (64 - BITS)) + (1 << (BITS - 1))


def decode(code: np.ndarray) -> np.ndarray:
    """The middle of the values that share a code."""
    i = ((np.asarray(code, np.int64) - (1 << (BITS - 1))) << (64 - BITS)) + (1 << (63 - BITS))
    i = i ^ ((i >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    v = i.view(np.float64)
    v = np.where(np.isnan(v), np.copysign(np.inf, v), v)
    return np.where(np.abs(v) < 1e-300, 0.0, v)


def _place(node: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter positions (DEPTH, n) and signs of the nodes of a level."""
    at, sign = [], []
    for d in range(DEPTH):
        seed = np.uint64(level * 64 + d + 1)
        h = _mix(node.astype(np.uint64) * np.uint64(2) + (seed << np.uint64(40)))
        base = (1 << EXACT) + (level * DEPTH + d) * WIDTH
        at.append(base + (h % np.uint64(WIDTH)).astype(np.int64))
        sign.append(np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1))
    return np.stack(at), np.stack(sign)


def dense_of(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sketch of distinct codes in rising order with their weights."""
    out = np.bincount(code >> LEVELS, weight, _SIZE).astype(np.int64)
    for level in range(LEVELS):
        node = code >> level
        first = runs(node) if len(node) else np.zeros(0, np.int64)
        node, w = node[first], np.add.reduceat(weight, first) if len(first) else weight
        at, sign = _place(node, level)
        for d in range(DEPTH):
            lo = (1 << EXACT) + (level * DEPTH + d) * WIDTH
            out[lo : lo + WIDTH] += np.bincount(at[d] - lo, sign[d] * w, WIDTH).astype(np.int64)
    return out


def _sum(key: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order with the sum of their weights (None: one each)."""
    if weight is None:
        key = np.sort(key)
        first = runs(key) if len(key) else np.zeros(0, np.int64)
        return key[first], np.diff(np.append(first, len(key)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = runs(key) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)


def _states(cell: np.ndarray, code: np.ndarray, weight: np.ndarray | None, lossless: int, sketches: dict[int, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The states of many cells from their codes and, for some, what they have as a sketch already."""
    assert 2 * lossless < _SIZE  # else kept codes could be taken for a sketch
    u, w = _sum((cell << BITS) | code, weight)
    owner = u >> BITS
    first = runs(owner) if len(u) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(u)))
    dense = (size > lossless) | (np.maximum.reduceat(np.abs(w), first) >= _HALF if len(first) else np.zeros(0, bool))
    ids = owner[first]
    sketches = sketches or {}
    if sketches:
        dense |= np.isin(ids, list(sketches))
    if not dense.all():
        keep = np.repeat(~dense, size)
        words = ((u[keep] & _CODE) << _WEIGHT) | (w[keep] + _HALF)
        yield ids[~dense], C.binary(8 * size[~dense], words.tobytes())
    rest = [(int(ids[i]), slice(first[i], first[i] + size[i])) for i in np.flatnonzero(dense)]
    rest += [(i, slice(0, 0)) for i in sorted(sketches.keys() - {i for i, _ in rest})]
    for a in range(0, len(rest), 32):
        part = rest[a : a + 32]
        yield np.array([i for i, _ in part]), pa.array([_written(dense_of(u[s] & _CODE, w[s]) + sketches.pop(i, 0)) for i, s in part], pa.binary())


def _written(counters: np.ndarray) -> bytes:
    """A sketch as bytes, in 32 bits a counter where that is enough."""
    return counters.astype(np.int32 if np.abs(counters).max() < 2**31 else np.int64).tobytes()


def _counters(state: bytes | np.ndarray) -> np.ndarray:
    return np.frombuffer(state, np.int64 if len(state) == 8 * _SIZE else np.int32)


def _sketched(size: np.ndarray) -> np.ndarray:
    return (size == 4 * _SIZE) | (size == 8 * _SIZE)


def merge_many(lossless: int = LOSSLESS) -> C.Many:
    def many(cell: np.ndarray, states: pa.Array, n: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
        data, at = C.payload(states)
        dense = _sketched(np.diff(at))
        sketches: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(dense):
            c = int(cell[i])
            if c in sketches:
                sketches[c] += _counters(data[at[i] : at[i + 1]])
            else:
                sketches[c] = _counters(data[at[i] : at[i + 1]]).astype(np.int64)
        if dense.any():
            data, at = C.payload(states.filter(pa.array(~dense)))
            cell = cell[~dense]
        size = np.diff(at)
        words = np.frombuffer(data, np.int64)
        yield from _states(np.repeat(cell, size // 8), words >> _WEIGHT, (words & _LOW) - _HALF, lossless, sketches)

    return many


def pack(code: np.ndarray, weight: np.ndarray, lossless: int = LOSSLESS) -> bytes:
    """A state from distinct codes and weights."""
    return next((s[0].as_py() for _, s in _states(np.zeros(len(code), np.int64), np.asarray(code, np.int64), np.asarray(weight, np.int64), lossless)), b"")


def merge(states: list[bytes], lossless: int = LOSSLESS) -> bytes:
    if len(states) == 1:
        return states[0]
    return next((s[0].as_py() for _, s in merge_many(lossless)(np.zeros(len(states), np.int64), pa.array(states, pa.binary()), 1)), b"")


def is_sketch(state: bytes) -> bool:
    return bool(_sketched(np.array(len(state))))


def unpack(state: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of a state that kept them."""
    w = np.frombuffer(state, np.int64)
    return w >> _WEIGHT, (w & _LOW) - _HALF


def count(state: bytes) -> int:
    return int(_counters(state)[: 1 << EXACT].sum()) if is_sketch(state) else int(unpack(state)[1].sum())


def _descend(p: np.ndarray, qs: tuple[float, ...]) -> tuple[int, np.ndarray, float]:
    """Count, values at ranks ceil(q n) and rank error of a sketch."""
    p = p.astype(np.int64)
    n = int(p[: 1 << EXACT].sum())
    if n <= 0:
        return n, np.full(len(qs), np.nan), 0.0
    want = np.clip(np.ceil(np.array(qs) * n), 1, n)
    top = np.cumsum(np.maximum(p[: 1 << EXACT], 0))
    node = np.minimum(np.searchsorted(top, want), (1 << EXACT) - 1)
    rank = want - np.where(node > 0, top[node - 1], 0)
    size = p[node].astype(float)
    off = np.zeros(len(qs))
    for level in range(LEVELS - 1, -1, -1):
        kids = np.stack([node * 2, node * 2 + 1])
        est, var = [], []
        for k in kids:
            at, sign = _place(k, level)
            e = np.sort(p[at] * sign, axis=0)
            est.append(np.maximum(e[DEPTH // 2], 0))
            var.append((_MEDIAN_SD * (e[DEPTH // 2 + 1] - e[DEPTH // 2 - 1])) ** 2)
        # two looks at one number: the left count itself, and what the right leaves of the parent
        left = np.clip((est[0] + np.maximum(size - est[1], 0)) / 2, 0, size)
        off += (var[0] + var[1]) / 4
        go = rank > left
        node, rank, size = np.where(go, kids[1], kids[0]), np.where(go, rank - left, rank), np.where(go, size - left, left)
    return n, decode(node), float(min(1.0, 3 * np.sqrt(off.max()) / n))


def quantiles(state: bytes, qs: tuple[float, ...]) -> np.ndarray:
    """Values at ranks ceil(q n); lossless where codes were kept, by descent otherwise."""
    if is_sketch(state):
        return _descend(_counters(state), qs)[1]
    return _kept(*C.payload(pa.array([state], pa.binary())), qs)[1][0]


def rank_error(state: bytes, qs: tuple[float, ...] = QUANTILES) -> float:
    """Three standard deviations of a rank, relative to n; 0 where codes were kept."""
    return _descend(_counters(state), qs)[2] if is_sketch(state) else 0.0


def _built(lossless: int, tagged: bool, absent: tuple[str, ...]):
    """Rows to states.  A row counts once in its (day, metric) and tag; with ``tagged`` once without
    tag and once in that of each of its tags, named ``key SEP value``, and rows that lack a key of
    ``absent`` count in its cell without value.  A task merges what it has built before it goes out."""
    many = merge_many(lossless)

    def work(held: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(held)
        row, names = C.codes([t.column(c) for c in ("day", "metric")])
        code = encode(t.column("value").to_numpy())
        weight = t.column("weight").to_numpy() if "weight" in t.column_names else None
        if tagged:
            lists = t.column("tags").combine_chunks()
            of = np.repeat(np.arange(len(row)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            key, tags = C.codes([flat.field(0), flat.field(1)])
            for k in absent:
                ids = [i for i, x in enumerate(tags) if x[0] == k]
                lack = np.ones(len(row), bool)
                lack[of[np.isin(key, ids)]] = False
                of = np.concatenate([of, np.flatnonzero(lack)])
                key = np.concatenate([key, np.full(lack.sum(), len(tags))])
                tags.append((k, ""))
            text: list[str | None] = [k + SEP + v for k, v in tags] + [None]
            of = np.concatenate([of, np.arange(len(row))])
            key = np.concatenate([key, np.full(len(row), len(tags))])
        else:
            key, tags = C.codes([t.column("tag")])
            text, of = [x[0] for x in tags], np.arange(len(row))
        texts = pa.array(text, pa.string())
        days, metrics = pa.array([x[0] for x in names], pa.date32()), pa.array([x[1] for x in names], pa.string())
        parts = []
        for c, s in _states(row[of] * len(text) + key, code[of], None if weight is None else weight[of], lossless):
            r, k = pa.array(c // len(text)), c % len(text)
            sets = np.where(k == len(text) - 1, C.BY_DAY | C.BY_METRIC, C.ALL_SETS) if tagged else np.full(len(c), C.ALL_SETS)
            parts.append(pa.Table.from_arrays([pa.array(np.zeros(len(c), np.int32)), pa.array(sets.astype(np.int32)), days.take(r), metrics.take(r), texts.take(pa.array(k)), s], schema=C._ARROW))
        return pa.concat_tables(parts) if parts else C._ARROW.empty_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, done, size = [], 0, [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= _CHUNK:
                done.append(work(held))
                held, n = [], 0
                size += done[-1].nbytes
                if size > _MOST_BYTES:
                    t = C.combine(pa.concat_tables(done), many)
                    done, size = [t], t.nbytes
                    if size > _MOST_BYTES // 2:
                        yield from C.batches_of(t)
                        done, size = [], 0
        if n:
            done.append(work(held))
        if done:
            yield from C.batches_of(C.combine(pa.concat_tables(done), many))

    return run


def tagged_values(metrics: DataFrame) -> DataFrame:
    """``day, metric, value, tags`` of the rows with a value, with all tags as they count for series."""
    return metric_values(metrics.withColumn("__e", tag_entries(F.col("tags"))), keep=("__e",)).select("day", "metric", "value", F.col("__e").alias("tags"))


def tag_sketches(values: DataFrame, absent: tuple[str, ...] = ("group",), lossless: int = LOSSLESS) -> DataFrame:
    """Partial results: one mergeable state a (day, metric) and a (day, metric, tag key, tag value)."""
    return _merged(values.mapInArrow(_built(lossless, True, absent), C.SCHEMA), lossless)


def _merged(states: DataFrame, lossless: int, rollup: int = 0) -> DataFrame:
    return C.merge_cells(states, lambda s: merge(s, lossless), merge_many(lossless), rollup=rollup)


def tag_rollup(states: DataFrame, lossless: int = LOSSLESS) -> DataFrame:
    """Cells of each tag with those over all days, over all metrics and over both.

    Tags that have sketches are merged in the tasks first and then cell by cell, however many days and
    metrics they have; the many small ones are shuffled once, by tag."""
    states = cut(states, "cells")
    heavy = small(states.where(F.octet_length("state") >= 4 * _SIZE).select(F.col("tag").alias("heavy")).distinct())
    same = F.col("tag").eqNullSafe(F.col("heavy"))
    light = C.roll_tags(states.join(heavy, same, "left_anti"), merge_many(lossless))
    return light.unionByName(_merged(states.join(heavy, same, "left_semi"), lossless, C.BY_DAY | C.BY_METRIC))


def tag_columns(cells: DataFrame) -> DataFrame:
    """``tag`` parted into ``key`` and ``tag`` (NULL: rows without that key)."""
    return cells.withColumns({"key": F.expr(f"left(tag, instr(tag, '{SEP}') - 1)"), "tag": F.nullif(F.expr(f"substring(tag, instr(tag, '{SEP}') + 1)"), F.lit(""))})


def metric_values(metrics: DataFrame, tag: str = "group", keep: tuple[str, ...] = ()) -> DataFrame:
    """``day, metric, tag, value`` of the rows with a value that is neither NULL nor NaN."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("timestamp") / 86_400).cast("int"))
    m = metrics.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return m.select(day.alias("day"), metric_name(F.col("metric")).alias("metric"), F.nullif(F.col("tags")[tag], F.lit("")).alias("tag"), "value", *keep)


def sketches(values: DataFrame, lossless: int = LOSSLESS) -> DataFrame:
    """Partial results: one mergeable state a (day, metric, tag).  A column
    ``weight`` (bigint, negative: deletion) may be given."""
    cols = ["day", "metric", "tag", "value"] + (["weight"] if "weight" in values.columns else [])
    return _merged(values.select(*cols).mapInArrow(_built(lossless, False, ()), C.SCHEMA), lossless)


def rollup(states: DataFrame, lossless: int = LOSSLESS) -> DataFrame:
    return _merged(states, lossless, C.ALL_SETS)


def _kept(data: np.ndarray, at: np.ndarray, qs: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and values of many states that kept their codes, at once."""
    words = np.frombuffer(data, np.int64)
    at = at // 8
    weight = (words & _LOW) - _HALF
    sums = np.concatenate([[0], np.cumsum(weight)])
    n = sums[at[1:]] - sums[at[:-1]]
    cum = np.concatenate([[0], np.cumsum(np.maximum(weight, 0))])
    before = cum[at[:-1]]
    total = cum[at[1:]] - before
    want = np.clip(np.ceil(np.array(qs) * total[:, None]), 1, np.maximum(total, 1)[:, None])
    pos = np.minimum(np.searchsorted(cum[1:], before[:, None] + want), np.maximum(at[1:] - 1, 0)[:, None])
    return n, np.where((total > 0)[:, None], decode(words[pos] >> _WEIGHT), np.nan) if len(words) else np.full(want.shape, np.nan)


def column_of(q: float) -> str:
    """The column of a quantile: p50, p99_5."""
    return "p" + f"{q * 100:g}".replace(".", "_")


def _read(qs: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states = b.column("state")
            data, at = C.payload(states)
            dense = _sketched(np.diff(at))
            ns, es, vals = np.zeros(len(dense), np.int64), np.zeros(len(dense)), np.full((len(dense), len(qs)), np.nan)
            ns[~dense], vals[~dense] = _kept(*(C.payload(states.filter(pa.array(~dense))) if dense.any() else (data, at)), qs)
            for i in np.flatnonzero(dense):
                ns[i], vals[i], es[i] = _descend(_counters(data[at[i] : at[i + 1]]), qs)
            cols = [b.column(c) for c in ("sets", "day", "metric", "tag")] + [pa.array(ns), pa.array(es)] + [pa.array(np.ascontiguousarray(vals[:, j])) for j in range(len(qs))]
            yield pa.RecordBatch.from_arrays(cols, names=["sets", "day", "metric", "tag", "n", "rank_error", *map(column_of, qs)])

    return run


def percentiles(states: DataFrame, qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """One row a cell with a column for each quantile (``p50``, ...)."""
    out = "sets int, day date, metric string, tag string, n bigint, rank_error double, " + ", ".join(f"{column_of(q)} double" for q in qs)
    return C.describe(states.mapInArrow(_read(qs), out))
