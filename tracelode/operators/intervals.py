"""Overlapping and gapped intervals to continuous periods and gaps (problem 2).

The state of the mergeable aggregate is a sorted list of disjoint, non-touching
closed intervals per (key, time bucket).  Each task folds its rows to such
partial lists before anything is shuffled; two further levels of a reduction
tree, keyed by (key, bucket, node) and (key, bucket), merge them linearly.  An
interval is kept in the bucket of its start, however far it reaches; how far
the earlier buckets of a key reach comes from a window on bucket summaries
(numbers only) and is joined back to the lists by (key, bucket).

Bounds that hold at any size: a bucket of ``bucket_ms`` holds at most half as
many disjoint intervals as it has milliseconds, and a key has at most as many
buckets as its time range has; windows see one row of numbers a bucket.  So a
key that owns a third of all rows spreads over its buckets and no task ever
holds all of it.

Defined results: rows with a NULL key, a NULL bound or first > last are left out;
repeated and nested rows change nothing; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import cut, parallelism, small

BUCKET_MS = 6 * 3_600_000
#: Intervals that a task holds; nodes of the middle level of the tree.
MOST, NODES = 1_000_000, 64

_STATE = "key string, bucket bigint, first_ms array<bigint>, last_ms array<bigint>"


def merge_lists(group: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of closed integer intervals within each group, all groups at once.

    Needs ``group`` in runs and ``first`` ascending within a run."""
    if not len(group):
        return group, first, last
    # lift each run of a group above all former ones, so that one running maximum serves all
    run = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
    lo = int(first.min())
    span = int(last.max()) - lo + 3
    if span * (int(run[-1]) + 1) < 2**62:
        f, e = first - lo + run * span, last - lo + run * span
        reach = np.maximum.accumulate(e)
        new = np.concatenate([[True], f[1:] > reach[:-1] + 1])
        at = np.flatnonzero(new)
        ends = np.maximum.reduceat(last, at)
        return group[at], first[at], ends
    half = int(np.flatnonzero(run == run[-1] // 2 + 1)[0])
    parts = [merge_lists(group[s], first[s], last[s]) for s in (slice(None, half), slice(half, None))]
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def _lists(names: list, codes: np.ndarray, bucket: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Rows of the state from merged intervals sorted by (code, bucket, first)."""
    n = len(codes)
    at = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (bucket[1:] != bucket[:-1])])) if n else np.zeros(0, int)
    offsets = pa.array(np.concatenate([at, [n]]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([names[c] for c in codes[at]], pa.string()),
            pa.array(bucket[at], pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(first, pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array(last, pa.int64())),
        ],
        names=["key", "bucket", "first_ms", "last_ms"],
    )


def _fold(codes: np.ndarray, bucket: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((first, bucket, codes))
    codes, bucket, first, last = codes[order], bucket[order], first[order], last[order]
    change = np.concatenate([[0], np.cumsum((codes[1:] != codes[:-1]) | (bucket[1:] != bucket[:-1]))]) if len(codes) else codes
    g, f, e = merge_lists(change, first, last)
    at = np.searchsorted(change, g)
    return codes[at], bucket[at], f, e


def _partial(bucket_ms: int):
    """Rows -> partial states: the leaves of the reduction tree.  A task folds what it has
    seen into one list a (key, bucket), and lets go of it when ``MOST`` intervals stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def fold() -> tuple[np.ndarray, ...]:
            return _fold(*(np.concatenate(x) for x in zip(*held)))

        for b in batches:
            if not b.num_rows:
                continue
            d = b.column(0).dictionary_encode()
            of = np.array([ids.setdefault(k, len(ids)) for k in d.dictionary.to_pylist()])
            first, last = b.column(1).to_numpy(), b.column(2).to_numpy()
            held.append(_fold(of[d.indices.to_numpy()], first // bucket_ms, first, last))
            n += len(held[-1][0])
            if n > MOST:
                held = [fold()]
                n = len(held[0][0])
                if n > MOST // 2:
                    yield _lists(list(ids), *held[0])
                    ids, held, n = {}, [], 0
        if held:
            yield _lists(list(ids), *fold())

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states sorted by (key, bucket) -> one state each.  The last
    (key, bucket) of a batch may go on in the next one and is held back."""
    held: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        d = b.column(0).dictionary_encode()
        names, rows = d.dictionary.to_pylist(), np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
        codes, bucket = d.indices.to_numpy()[rows], b.column(1).to_numpy()[rows]
        first, last = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
        if held is not None:
            name, hb, hf, he = held
            if name not in names:
                names.append(name)
            c = names.index(name)
            codes, bucket, first, last = (np.concatenate(x) for x in (([c] * len(hf), codes), ([hb] * len(hf), bucket), (hf, first), (he, last)))
        codes, bucket, first, last = _fold(codes, bucket, first, last)
        c, k = names.index(d.dictionary[d.indices[-1].as_py()].as_py()), b.column(1)[-1].as_py()
        tail = (codes == c) & (bucket == k)
        held = (names[c], k, first[tail], last[tail])
        yield _lists(names, *(x[~tail] for x in (codes, bucket, first, last)))
    if held is not None:
        n = len(held[2])
        yield _lists([held[0]], np.zeros(n, int), np.full(n, held[1]), held[2], held[3])


def covered_lists(df: DataFrame, key: str, first: str, last: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """The merged states ``key, bucket, first_ms[], last_ms[]`` of ``df``.

    A reduction tree of three levels: tasks, then up to ``NODES`` nodes a (key, bucket) that merge
    the lists of some tasks each, then one.  A bucket that all tasks write to is thus merged by many."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(first).cast("bigint").alias("f"), F.col(last).cast("bigint").alias("l")).where("key is not null and f <= l")
    n = parallelism(df.sparkSession, 1)
    part = rows.mapInArrow(_partial(bucket_ms), _STATE).withColumn("node", F.spark_partition_id() % NODES)
    part = part.repartition(n, "key", "bucket", "node").sortWithinPartitions("key", "bucket").drop("node").mapInArrow(_merge, _STATE)
    return part.repartition(n, "key", "bucket").sortWithinPartitions("key", "bucket").mapInArrow(_merge, _STATE)


def _reaches(states: DataFrame) -> DataFrame:
    """``key, bucket, carry, key_end``: how far the earlier buckets of the key reach (NULL for its
    first), and how far all of them do.  The windows see one row of three numbers a bucket."""
    ends = states.select("key", "bucket", F.element_at("last_ms", -1).alias("end"))
    w = Window.partitionBy("key")
    before = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("key", "bucket", F.max("end").over(before).alias("carry"), F.max("end").over(w).alias("key_end"))


def gaps(states: DataFrame) -> DataFrame:
    """``key, gap_first_ms, gap_last_ms``: every maximal uncovered run between covered ones."""
    states = cut(states, "covered")
    e = states.join(small(_reaches(states).drop("key_end")), ["key", "bucket"])
    e = e.select("key", F.posexplode(F.arrays_zip("first_ms", F.concat(F.array(F.col("carry")), "last_ms").alias("before"))).alias("i", "x"), "carry")
    # the last element of the zip has no start; GREATEST skips NULLs
    e = e.select("key", F.greatest(F.col("x.before"), F.col("carry")).alias("reach"), F.col("x.first_ms").alias("next"))
    return e.where("next > reach + 1").select("key", (F.col("reach") + 1).alias("gap_first_ms"), (F.col("next") - 1).alias("gap_last_ms"))


def periods(states: DataFrame) -> DataFrame:
    """``key, first_ms, last_ms``: the maximal continuous periods.

    A period that starts in a bucket ends before the next gap: in the same
    bucket, else before the first gap of a later bucket, else where the key's
    cover ends.  All windows run over one row of a few numbers a bucket."""
    states = cut(states, "covered")
    c = states.join(small(_reaches(states)), ["key", "bucket"])
    pairs = F.arrays_zip(F.concat(F.array("carry"), F.slice("last_ms", 1, F.size("last_ms") - 1)).alias("b"), F.col("first_ms").alias("f"))
    jumps = F.filter(F.transform(pairs, lambda x: F.struct(F.greatest(x["b"], F.col("carry")).alias("reach"), x["f"].alias("start"))), lambda x: x["reach"].isNull() | (x["start"] > x["reach"] + 1))
    c = cut(c.select("key", "bucket", "key_end", jumps.alias("jumps")).where(F.size("jumps") > 0), "jumps")
    later = Window.partitionBy("key").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    heads = c.select("key", "bucket", F.get(F.col("jumps.reach"), F.lit(0)).alias("first_end"))
    heads = heads.select("key", "bucket", F.first("first_end", ignorenulls=True).over(later).alias("later_end"))
    c = c.join(small(heads), ["key", "bucket"])
    ends = F.concat(F.slice(F.col("jumps.reach"), 2, F.greatest(F.size("jumps") - 1, F.lit(0))), F.array(F.coalesce("later_end", "key_end")))
    out = c.select("key", F.explode(F.arrays_zip(F.col("jumps.start").alias("first_ms"), ends.alias("last_ms"))).alias("x"))
    return out.select("key", "x.first_ms", "x.last_ms")
