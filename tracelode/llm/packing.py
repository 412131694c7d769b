"""Filling containers of fixed capacity by harmonic classes (problem 8).

An item of size s belongs to class k = floor(capacity / s): it is larger than
capacity/(k+1), and k of them fit one container.  Each task fills containers of
each class with exactly k items, without knowing of any other task.  What is
left of a class in a task (fewer than k items) goes to a second round keyed by
class, and what is left there (fewer than k items a class in all) to a last
one, where the rest of all classes is packed first-fit by falling size.

Containers of the classes 1 to ``HOSTS`` would waste most, so they take guests,
again by class and by fixed counts: with a room of at least capacity/j left
(j the room's class), floor(g/j) items of class g fit for any g >= j, whatever
their sizes.  Each task pairs the hosts and guests it has.

Waste: a container of class k without guests is more than k/(k+1) full.  The last round sees
at most the sum of (k-1) over the at most 2*sqrt(capacity) classes, a number
that the capacity bounds whatever the number of items.

Items above the capacity are split into full containers and one remainder, all
others stay whole.  Defined results: NULL and empty texts have size 0 and are
put in no container; repeated rows are items of their own; a capacity that is
NULL or below 1 has no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.lanes import runs, whole_groups
from tracelode.session import cut, parallelism

#: Classes whose containers take guests; the smallest guests are of class ``GUESTS``.
HOSTS, GUESTS = 3, 96
#: The container sizes are a small table by nature; more rows than this are refused.
MOST_SPECS = 1_000

_ITEM = "spec_id int, capacity bigint, doc_id bigint, piece bigint, tokens bigint, bin string"


def items(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """One row an item and capacity, oversized documents cut in pieces."""
    rows = specs.where("capacity_tokens >= 1").select("spec_id", "capacity_tokens").limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container sizes")
    if not rows:
        return sizes.select(F.lit(0).alias("spec_id"), F.lit(0).cast("bigint").alias("capacity"), "doc_id", F.lit(0).cast("bigint").alias("piece"), "tokens").where("false")
    spec = F.explode(F.array(*[F.struct(F.lit(r.spec_id).cast("int").alias("spec_id"), F.lit(r.capacity_tokens).cast("bigint").alias("capacity")) for r in rows]))
    x = sizes.where("tokens > 0").select("doc_id", "tokens", spec.alias("s")).select("s.spec_id", "s.capacity", "doc_id", "tokens")
    pieces = F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("tokens") - 1, F.col("capacity"))))
    x = x.withColumn("piece", pieces)
    return x.select("spec_id", "capacity", "doc_id", "piece", F.least(F.col("tokens") - F.col("piece") * F.col("capacity"), F.col("capacity")).alias("tokens"))


def hosted(cap: int, tok: np.ndarray) -> np.ndarray:
    """Containers (numbers from 0; -1: none) of items of one capacity: k of class k <= HOSTS with guests."""
    klass = cap // tok
    out = np.full(len(tok), -1)
    free = {g: list(np.flatnonzero(klass == g)) for g in np.unique(klass[klass <= GUESTS]).tolist()}
    made = 0
    for k in range(1, HOSTS + 1):
        mine = np.array(free.get(k, []), np.int64)
        mine = mine[np.argsort(tok[mine], kind="stable")][: len(mine) // k * k].reshape(-1, k)
        room = cap - tok[mine].sum(axis=1)
        mine, room = mine[room > 0], room[room > 0]
        needs = -(-cap // np.maximum(room, 1))  # class of the room: capacity/needs <= room
        pools = {j: list(np.flatnonzero(needs == j)) for j in np.unique(needs[needs <= GUESTS]).tolist()}
        served: set[int] = set()
        for g in range(k + 1, GUESTS + 1):
            guests = free.get(g)
            if not guests:
                continue
            for j in sorted((j for j in pools if j <= g), reverse=True):  # the tightest rooms first
                m = g // j
                n = min(len(pools[j]), len(guests) // m)
                for _ in range(n):
                    h = pools[j].pop()
                    out[mine[h]] = made
                    out[[guests.pop() for _ in range(m)]] = made
                    served.update(mine[h].tolist())
                    made += 1
        if served:
            free[k] = [i for i in free[k] if i not in served]
    return out


def _fill(tag: str, sorted_input: bool):
    """Numbers containers of k items of each (capacity, class); the rest keeps a NULL container.

    Unsorted input is worked chunk by chunk with what was left carried on, so
    memory stays flat; container names are unique by round and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        who = f"{tag}{ctx.partitionId() if ctx else 0}"
        made = hosts = 0
        held: pa.Table | None = None

        def host(t: pa.Table) -> tuple[pa.Table, pa.Table]:
            """Containers with guests, and the items that are in none."""
            nonlocal hosts
            spec, cap, tok = (t.column(c).to_numpy() for c in ("spec_id", "capacity", "tokens"))
            place = np.full(len(spec), -1)
            for k in np.unique(spec).tolist():
                at = np.flatnonzero(spec == k)
                b = hosted(int(cap[at[0]]), tok[at])
                place[at] = np.where(b >= 0, b + hosts, -1)
                hosts += int(b.max(initial=-1)) + 1
            names = np.char.add(f"h{who}-", place[place >= 0].astype(str)) if (place >= 0).any() else np.array([], str)
            return t.take(pa.array(np.flatnonzero(place >= 0))).append_column("bin", pa.array(names, pa.string())), t.take(pa.array(np.flatnonzero(place < 0)))

        def work(t: pa.Table, last: bool) -> tuple[pa.Table, pa.Table | None]:
            nonlocal made
            spec, cap, tok = (t.column(c).to_numpy() for c in ("spec_id", "capacity", "tokens"))
            klass = cap // tok
            order = np.lexsort((t.column("piece").to_numpy(), t.column("doc_id").to_numpy(), klass, spec))
            first = runs(spec[order], klass[order])
            size = np.diff(np.append(first, len(order)))
            rank = np.arange(len(order)) - np.repeat(first, size)
            k = klass[order]
            full = rank < np.repeat(size // klass[order][first], size) * k
            starts = full & (rank % k == 0)
            number = np.cumsum(starts) - 1 + made
            made += int(starts.sum())
            names = pa.array(np.char.add(f"{who}-", number[full].astype(str)) if full.any() else np.array([], str), pa.string())
            done = t.take(pa.array(order[full])).append_column("bin", names)
            rest = t.take(pa.array(order[~full]))
            if last and rest.num_rows:
                done = pa.concat_tables([done, rest.append_column("bin", pa.nulls(rest.num_rows, pa.string()))])
            return done, None if last else rest

        source = whole_groups(batches, ["spec_id", "klass"]) if sorted_input else _tables(batches)
        for t in source:
            t = t.select(["spec_id", "capacity", "doc_id", "piece", "tokens"])
            if not sorted_input:
                done, t = host(t)
                yield from done.combine_chunks().to_batches()
            done, held = work(t if held is None else pa.concat_tables([held, t]), False)
            yield from done.combine_chunks().to_batches()
        if held is not None and held.num_rows:
            done, _ = work(held, True)
            yield from done.combine_chunks().to_batches()

    return run


def _tables(batches: Iterator[pa.RecordBatch], rows: int = 400_000) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First fit by falling size of what is left of each capacity."""
    for t in whole_groups(batches, ["spec_id"]):
        spec, cap, tok = (t.column(c).to_numpy() for c in ("spec_id", "capacity", "tokens"))
        names = np.empty(len(spec), object)
        for a, b in zip(runs(spec), np.append(runs(spec)[1:], len(spec))):
            free: list[int] = []
            room = np.zeros(0, np.int64)
            for i in a + np.argsort(-tok[a:b], kind="stable"):
                fit = np.flatnonzero(room[: len(free)] >= tok[i])
                if len(fit):
                    j = int(fit[0])
                else:
                    j = len(free)
                    free.append(j)
                    if j >= len(room):
                        room = np.concatenate([room, np.zeros(max(64, len(room)), np.int64)])
                    room[j] = cap[i]
                room[j] -= tok[i]
                names[i] = f"c{spec[i]}-{j}"
        yield from t.select(["spec_id", "capacity", "doc_id", "piece", "tokens"]).append_column("bin", pa.array(names, pa.string())).combine_chunks().to_batches()


def containers(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, capacity, doc_id, piece, tokens, bin``: every item in one container."""
    n = parallelism(sizes.sparkSession, 1)
    one = cut(items(sizes, specs).mapInArrow(_fill("a", False), _ITEM), "pack")
    left = one.where("bin is null").drop("bin").withColumn("klass", F.call_function("div", F.col("capacity"), F.col("tokens")))
    left = left.repartition(n, "spec_id", "klass").sortWithinPartitions("spec_id", "klass", "doc_id", "piece")
    two = cut(left.mapInArrow(_fill("b", True), _ITEM), "pack")
    rest = two.where("bin is null").drop("bin").repartition(n, "spec_id").sortWithinPartitions("spec_id", "doc_id", "piece")
    return one.where("bin is not null").unionByName(two.where("bin is not null")).unionByName(rest.mapInArrow(_last, _ITEM))


def fill_report(packed: DataFrame) -> DataFrame:
    """``spec_id, capacity, containers, items, tokens, filled``."""
    bins = packed.groupBy("spec_id", "capacity", "bin").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    return bins.groupBy("spec_id", "capacity").agg(F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens")).withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))
