"""Irregular readings onto a regular grid with a Kalman smoother (problem 1).

Model per source: an integrated Wiener process (continuous-time local trend)
observed with noise, state (level, slope), time in slots.  All slots of all
sources are cut into blocks of ``BLOCK`` slots.

1. Readings are reduced to one row a (target, slot), with partial aggregation,
   so copies and dense readings never travel.
2. Each block becomes one packed row together with its *element*: the affine
   map with noise from the state at its start to that at its end given the
   block's readings, and what they tell of the state at its start.  Elements
   compose associatively, which is what lets one long source be smoothed by
   many tasks with exactly the result of one long recursion.
3. Per source the elements are composed from both sides: the state before each
   block (past) and the information about the state after it (future).  A
   source has at most (seconds of its window / step / BLOCK) elements of about
   200 bytes, under a million even for ten years of seconds.
4. Each block runs its two recursions and combines them at the grid times.

Process noise relative to reading noise is picked per source from ``RATIOS``
by likelihood, the scale of the noise follows in closed form; both from sums
that blocks contribute to.  Blocks are processed as lanes of array operations.

Defined results: a slot is *missing* if no reading lies in it; a reading is a
row of the target's series whose timestamp lies in the slot and whose value is
neither NULL nor NaN.  Infinite values are readings but tell the smoother
nothing.  Targets without any finite reading give NULL values, all others a
value and a standard error for every slot.  Repeated rows weigh like one
reading each time they come.  Targets with NULL bounds or step <= 0 have no
slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.lanes import runs, whole_groups
from tracelode.functions.series import with_series_hash
from tracelode.session import cut, fits, parallelism, small

BLOCK, DAY = 256, 86_400
#: process noise over reading noise, per slot cubed
RATIOS = (1e-5, 1e-3, 1e-1)

_PACKED = "target_id bigint, block bigint, slots int, at array<smallint>, tau array<float>, y array<double>, n array<bigint>"
_ELEM = "a array<double>, yn bigint, ysum double, ysq double"


def with_targets(readings: DataFrame, targets: DataFrame) -> DataFrame:
    """Readings (``h1, h2, timestamp``) with the registration whose window holds them.

    Where the registrations are too many to be sent to all tasks, both sides are cut by time as well, so
    that a series with a third of all readings is spread over its days."""
    keys = ["h1", "h2"]
    if fits(targets):
        t = F.broadcast(targets)
    else:
        day = lambda c: F.floor(F.col(c) / DAY)
        t = targets.withColumn("day", F.explode(F.sequence(day("start_sec"), F.floor((F.col("end_sec") - 1) / DAY))))
        readings, keys = readings.withColumn("day", day("timestamp")), [*keys, "day"]
    j = readings.join(t, keys).where("timestamp >= start_sec and timestamp < end_sec")
    return j.drop("day") if len(keys) == 3 else j


def slot_readings(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """``target_id, block, at, tau, y, n``: readings reduced to slots, plus one
    marker row (``at`` = -1) for every block of every target."""
    t = with_series_hash(targets.where("step_sec > 0 and start_sec < end_sec")).select("h1", "h2", "target_id", "step_sec", "start_sec", "end_sec")
    m = metrics.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("timestamp").isNotNull())
    m = with_series_hash(m).select("h1", "h2", "timestamp", "value")
    j = with_targets(m, t)
    off = F.col("timestamp") - F.col("start_sec")
    finite = F.abs("value") < 1e300
    j = j.withColumns({"slot": F.call_function("div", off, F.col("step_sec")), "in_slot": (off % F.col("step_sec")) / F.col("step_sec")})
    s = j.groupBy("target_id", "slot").agg(
        F.count("*").alias("n"),
        F.avg(F.when(finite, F.col("value"))).alias("y"),
        F.avg(F.when(finite, F.col("in_slot"))).alias("tau"),
    )
    return s.select("target_id", F.call_function("div", F.col("slot"), F.lit(BLOCK)).alias("block"), (F.col("slot") % BLOCK).cast("smallint").alias("at"), F.col("tau").cast("float").alias("tau"), "y", "n", F.lit(0).alias("slots")).unionByName(_markers(targets))


def _markers(targets: DataFrame) -> DataFrame:
    slots = F.call_function("div", F.col("end_sec") - F.col("start_sec"), F.col("step_sec"))
    t = targets.where("step_sec > 0 and start_sec < end_sec").select("target_id", slots.alias("all"))
    t = t.where("all > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("all") - 1, F.lit(BLOCK)))))
    left = F.least(F.col("all") - F.col("block") * BLOCK, F.lit(BLOCK)).cast("int")
    return t.select("target_id", "block", F.lit(-1).cast("smallint").alias("at"), F.lit(None).cast("float").alias("tau"), F.lit(None).cast("double").alias("y"), F.lit(0).cast("bigint").alias("n"), left.alias("slots"))


# ---- two-by-two algebra over lanes -------------------------------------------------------------
def _move(P: list, d: np.ndarray, q: np.ndarray) -> None:
    """Covariance [p00, p01, p11] over time ``d``, in place."""
    p00, p01, p11 = P
    P[0] = p00 + d * (2 * p01 + d * p11) + q * d * d * d / 3
    P[1] = p01 + d * p11 + q * d * d / 2
    P[2] = p11 + q * d


class _Lanes:
    """Blocks as rows of dense arrays: for each slot whether, when and what was read."""

    def __init__(self, lane: np.ndarray, at: np.ndarray, tau: np.ndarray, y: np.ndarray, count: int) -> None:
        ok = ~np.isnan(y)
        lane, at, tau, y = lane[ok], at[ok], tau[ok], y[ok]
        self.has = np.zeros((BLOCK, count), bool)
        self.tau, self.y = np.zeros((BLOCK, count)), np.zeros((BLOCK, count))
        self.has[at, lane], self.tau[at, lane], self.y[at, lane] = True, tau, y
        self.yn = np.bincount(lane, minlength=count)
        # (of no readings at all bincount makes integers)
        self.ysum, self.ysq = np.bincount(lane, y, count).astype(float), np.bincount(lane, y * y, count).astype(float)
        self.mid = np.where(self.yn > 0, self.ysum / np.maximum(self.yn, 1), 0.0)


def _elements(x: _Lanes, slots: np.ndarray, q: float) -> np.ndarray:
    """For each lane: A (4), b (2), C (3), eta (2), J (3), rss, logdet; unit reading noise."""
    n = len(slots)
    one, zero = np.ones(n), np.zeros(n)
    a00, a01, a10, a11 = one.copy(), zero.copy(), zero.copy(), one.copy()
    b0, b1 = zero.copy(), zero.copy()
    C = [zero.copy(), zero.copy(), zero.copy()]
    e0, e1, j00, j01, j11, rss, ld = (zero.copy() for _ in range(7))
    for k in range(int(slots.max()) if n else 0):
        has, live = x.has[k], k < slots
        d = np.where(has, x.tau[k], 0.0)
        for part in (0, 1):
            step = d if part == 0 else np.where(live, 1 - d, 0.0)
            a00, a01, b0 = a00 + step * a10, a01 + step * a11, b0 + step * b1
            _move(C, step, q)
            if part == 0 and has.any():
                s = C[0] + 1
                k0, k1 = np.where(has, C[0] / s, 0), np.where(has, C[1] / s, 0)
                w = np.where(has, 1 / s, 0)
                r = x.y[k] - x.mid - b0
                j00, j01, j11 = j00 + w * a00 * a00, j01 + w * a00 * a01, j11 + w * a01 * a01
                e0, e1 = e0 + w * a00 * r, e1 + w * a01 * r
                rss, ld = rss + w * r * r, ld + np.where(has, np.log(s), 0)
                b0, b1 = b0 + k0 * r, b1 + k1 * r
                a10, a11 = a10 - k1 * a00, a11 - k1 * a01
                a00, a01 = a00 - k0 * a00, a01 - k0 * a01
                C[2] = C[2] - k1 * C[1]
                C[1] = C[1] - k0 * C[1]
                C[0] = C[0] - k0 * C[0]
    # profile out the unknown state at the start: only blocks that determine it count
    det = j00 * j11 - j01 * j01
    good = (x.yn > 2) & (det > 1e-12 * np.maximum(j00 * j11, 1e-300))
    sq = np.where(good, (j11 * e0 * e0 - 2 * j01 * e0 * e1 + j00 * e1 * e1) / np.where(good, det, 1), 0)
    dof = np.where(good, x.yn - 2, 0)
    rss, ld = np.where(good, np.maximum(rss - sq, 0), 0), np.where(good, ld + np.log(np.where(good, det, 1)), 0)
    # from "level minus the block's mean" back to levels
    b0, b1 = b0 + x.mid - a00 * x.mid, b1 - a10 * x.mid
    e0, e1 = e0 + j00 * x.mid, e1 + j01 * x.mid
    return np.stack([a00, a01, a10, a11, b0, b1, *C, e0, e1, j00, j01, j11, rss, ld, dof], axis=1)


_WIDTH = 17


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slot rows sorted by (target, block, at) -> one row a block, with its elements."""
    for t in whole_groups(batches, ["target_id", "block"]):
        target, block, at = (t.column(c).to_numpy() for c in ("target_id", "block", "at"))
        first = runs(target, block)
        lane = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        slots = t.column("slots").to_numpy()[first]  # the marker (-1) comes first in each block
        real = at >= 0
        tau, y, n = (t.column(c).to_numpy(zero_copy_only=False)[real] for c in ("tau", "y", "n"))
        lane_r, at_r = lane[real], at[real]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(lane_r, minlength=len(first)))]).astype(np.int32)
        x = _Lanes(lane_r, at_r, tau.astype(float), y.astype(float), len(first))
        elems = np.concatenate([_elements(x, slots, q) for q in RATIOS], axis=1)
        wide = np.arange(0, elems.size + 1, elems.shape[1], dtype=np.int32)
        lists = lambda v, typ: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v, typ))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(target[first]), pa.array(block[first]), pa.array(slots, pa.int32()),
                lists(at_r, pa.int16()), lists(tau, pa.float32()), lists(y, pa.float64()), lists(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(wide), pa.array(elems.ravel())),
                pa.array(x.yn, pa.int64()), pa.array(x.ysum), pa.array(x.ysq),
            ],
            names=["target_id", "block", "slots", "at", "tau", "y", "n", "a", "yn", "ysum", "ysq"],
        )


_STATE = "target_id bigint, block bigint, q double, scale double, m array<double>, p array<double>, eta array<double>, j array<double>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements sorted by (target, block) -> the state before and the information after each block."""
    for t in whole_groups(batches, ["target_id"], 50_000):
        target, block = t.column("target_id").to_numpy(), t.column("block").to_numpy()
        a = t.column("a").combine_chunks().flatten().to_numpy().reshape(len(target), len(RATIOS), _WIDTH)
        yn, ysum, ysq = (t.column(c).to_numpy() for c in ("yn", "ysum", "ysq"))
        first = runs(target)
        ends = np.append(first[1:], len(target))
        n = np.add.reduceat(yn, first)
        mean = np.add.reduceat(ysum, first) / np.maximum(n, 1)
        var = np.maximum(np.add.reduceat(ysq, first) / np.maximum(n, 1) - mean**2, 0)
        rss, ld, dof = (np.add.reduceat(a[:, :, i], first, axis=0) for i in (14, 15, 16))
        floor = 1e-12 * (1 + mean**2)[:, None]
        s2 = np.maximum(rss / np.maximum(dof, 1), floor)
        best = np.argmax(-0.5 * (dof * np.log(s2) + ld), axis=1)
        rows = np.arange(len(first))
        scale = np.where(dof[rows, best] > 0, s2[rows, best], np.maximum(var, floor[:, 0]))
        q = np.array(RATIOS)[best]
        out_m, out_p = np.zeros((len(target), 2)), np.zeros((len(target), 3))
        out_e, out_j = np.zeros((len(target), 2)), np.zeros((len(target), 3))
        for g in range(len(first)):
            e = a[first[g] : ends[g], best[g]].tolist()
            m0, m1 = mean[g], 0.0
            p00, p01, p11 = 100.0 + 4 * var[g] / scale[g], 0.0, 1.0
            for i, (a00, a01, a10, a11, b0, b1, c00, c01, c11, e0, e1, j00, j01, j11, *_r) in enumerate(e):
                out_m[first[g] + i], out_p[first[g] + i] = (m0, m1), (p00, p01, p11)
                # condition on what the block tells of its start, then move to its end
                g00, g01, g10, g11 = 1 + p00 * j00 + p01 * j01, p00 * j01 + p01 * j11, p01 * j00 + p11 * j01, 1 + p01 * j01 + p11 * j11
                det = g00 * g11 - g01 * g10
                u0, u1 = m0 + p00 * e0 + p01 * e1, m1 + p01 * e0 + p11 * e1
                m0, m1 = (g11 * u0 - g01 * u1) / det, (g00 * u1 - g10 * u0) / det
                r00, r01, r11 = (g11 * p00 - g01 * p01) / det, (g11 * p01 - g01 * p11) / det, (g00 * p11 - g10 * p01) / det
                m0, m1 = a00 * m0 + a01 * m1 + b0, a10 * m0 + a11 * m1 + b1
                x0, x1, z0, z1 = a00 * r00 + a01 * r01, a00 * r01 + a01 * r11, a10 * r00 + a11 * r01, a10 * r01 + a11 * r11
                p00, p01, p11 = x0 * a00 + x1 * a01 + c00, x0 * a10 + x1 * a11 + c01, z0 * a10 + z1 * a11 + c11
            n0 = n1 = k00 = k01 = k11 = 0.0
            for i in range(len(e) - 1, -1, -1):
                out_e[first[g] + i], out_j[first[g] + i] = (n0, n1), (k00, k01, k11)
                a00, a01, a10, a11, b0, b1, c00, c01, c11, e0, e1, j00, j01, j11, *_r = e[i]
                h00, h01, h10, h11 = 1 + k00 * c00 + k01 * c01, k00 * c01 + k01 * c11, k01 * c00 + k11 * c01, 1 + k01 * c01 + k11 * c11
                det = h00 * h11 - h01 * h10
                u0, u1 = n0 - k00 * b0 - k01 * b1, n1 - k01 * b0 - k11 * b1
                v0, v1 = (h11 * u0 - h01 * u1) / det, (h00 * u1 - h10 * u0) / det
                w00, w01, w11 = (h11 * k00 - h01 * k01) / det, (h11 * k01 - h01 * k11) / det, (h00 * k11 - h10 * k01) / det
                n0, n1 = a00 * v0 + a10 * v1 + e0, a01 * v0 + a11 * v1 + e1
                x0, x1, z0, z1 = a00 * w00 + a10 * w01, a00 * w01 + a10 * w11, a01 * w00 + a11 * w01, a01 * w01 + a11 * w11
                k00, k01, k11 = x0 * a00 + x1 * a10 + j00, x0 * a01 + x1 * a11 + j01, z0 * a01 + z1 * a11 + j11
        per = np.repeat(rows, ends - first)
        dead = (n == 0)[per]
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(target), pa.array(block), pa.array(q[per]), pa.array(np.where(dead, np.nan, scale[per])), lists(out_m), lists(out_p), lists(out_e), lists(out_j)],
            names=["target_id", "block", "q", "scale", "m", "p", "eta", "j"],
        )


_GRID = "target_id bigint, slot bigint, value double, std double, readings bigint"


def _smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks with their outer states -> one row a slot."""
    for t in whole_groups(batches, ["target_id", "block"], 2_000):
        for a in range(0, t.num_rows, 2_000):
            yield _smooth_blocks(t.slice(a, 2_000).combine_chunks())


def _list(t: pa.Table, c: str) -> tuple[np.ndarray, np.ndarray]:
    x = t.column(c).combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())


def _smooth_blocks(t: pa.Table) -> pa.RecordBatch:
    count = t.num_rows
    slots, q, scale = (t.column(c).to_numpy() for c in ("slots", "q", "scale"))
    at, per = _list(t, "at")
    lane = np.repeat(np.arange(count), per)
    tau, y, n = (_list(t, c)[0] for c in ("tau", "y", "n"))
    x = _Lanes(lane, at, tau.astype(float), y.astype(float), count)
    m0, m1 = (c.copy() for c in _list(t, "m")[0].reshape(count, 2).T)
    P = [c.copy() for c in _list(t, "p")[0].reshape(count, 3).T]
    e0, e1 = (c.copy() for c in _list(t, "eta")[0].reshape(count, 2).T)
    J = [c.copy() for c in _list(t, "j")[0].reshape(count, 3).T]
    longest = int(slots.max())
    fm, fp = np.zeros((longest, 2, count)), np.zeros((longest, 3, count))
    for k in range(longest):
        fm[k, 0], fm[k, 1] = m0, m1
        fp[k, 0], fp[k, 1], fp[k, 2] = P
        has = x.has[k]
        d = np.where(has, x.tau[k], 0.0)
        m0 = m0 + d * m1
        _move(P, d, q)
        if has.any():
            s = P[0] + 1
            g0, g1 = np.where(has, P[0] / s, 0), np.where(has, P[1] / s, 0)
            r = x.y[k] - m0
            m0, m1 = m0 + g0 * r, m1 + g1 * r
            P[2] = P[2] - g1 * P[1]
            P[1] = P[1] - g0 * P[1]
            P[0] = P[0] - g0 * P[0]
        d = 1 - d
        m0 = m0 + d * m1
        _move(P, d, q)
    value, var = np.zeros((longest, count)), np.zeros((longest, count))
    for k in range(longest - 1, -1, -1):
        has, live = x.has[k], k < slots
        tau_k = np.where(has, x.tau[k], 0.0)
        for d in (np.where(live, 1 - tau_k, 0.0), tau_k):
            j00, j01, j11 = J
            c00, c01, c11 = q * d * d * d / 3, q * d * d / 2, q * d
            h00, h01, h10, h11 = 1 + j00 * c00 + j01 * c01, j00 * c01 + j01 * c11, j01 * c00 + j11 * c01, 1 + j01 * c01 + j11 * c11
            det = h00 * h11 - h01 * h10
            v0, v1 = (h11 * e0 - h01 * e1) / det, (h00 * e1 - h10 * e0) / det
            w00, w01, w11 = (h11 * j00 - h01 * j01) / det, (h11 * j01 - h01 * j11) / det, (h00 * j11 - h10 * j01) / det
            e0, e1 = v0, d * v0 + v1
            J = [w00, d * w00 + w01, d * d * w00 + 2 * d * w01 + w11]
            if d is not tau_k and has.any():
                J[0] = J[0] + has
                e0 = e0 + np.where(has, x.y[k], 0)
        p00, p01, p11 = fp[k]
        g00, g01, g10, g11 = 1 + p00 * J[0] + p01 * J[1], p00 * J[1] + p01 * J[2], p01 * J[0] + p11 * J[1], 1 + p01 * J[1] + p11 * J[2]
        det = g00 * g11 - g01 * g10
        u0, u1 = fm[k, 0] + p00 * e0 + p01 * e1, fm[k, 1] + p01 * e0 + p11 * e1
        value[k] = (g11 * u0 - g01 * u1) / det
        var[k] = (g11 * p00 - g01 * p01) / det
    readings = np.zeros((longest, count), np.int64)
    readings[at, lane] = n
    keep = (np.arange(longest)[:, None] < slots).T
    dead = np.isnan(scale)[:, None]
    value = np.where(dead, np.nan, value.T)[keep]
    std = np.where(dead, np.nan, np.sqrt(np.maximum(var.T, 0) * np.where(dead, 0, scale[:, None])))[keep]
    slot = (t.column("block").to_numpy()[:, None] * BLOCK + np.arange(longest))[keep]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(t.column("target_id").to_numpy(), slots)), pa.array(slot), pa.array(value, from_pandas=True), pa.array(std, from_pandas=True), pa.array(readings.T[keep])],
        names=["target_id", "slot", "value", "std", "readings"],
    )


def regular_grid(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """``target_id, slot_sec, value, std, readings, missing``: one row per target and slot."""
    spark = metrics.sparkSession
    rows = slot_readings(metrics, targets)
    packed = rows.repartition(parallelism(spark, 1), "target_id", "block").sortWithinPartitions("target_id", "block", "at").mapInArrow(_pack, f"{_PACKED}, {_ELEM}")
    packed = cut(packed, "grid")
    scan = packed.select("target_id", "block", "a", "yn", "ysum", "ysq").repartition(parallelism(spark, 1), "target_id").sortWithinPartitions("target_id", "block").mapInArrow(_scan, _STATE)
    scan = cut(scan, "gridscan")
    both = packed.select("target_id", "block", "slots", "at", "tau", "y", "n").join(small(scan), ["target_id", "block"])
    g = both.mapInArrow(_smooth, _GRID)
    t = targets.select("target_id", "step_sec", "start_sec")
    g = g.join(small(t), "target_id")
    return g.select("target_id", (F.col("start_sec") + F.col("slot") * F.col("step_sec")).alias("slot_sec"), "value", "std", "readings", (F.col("readings") == 0).alias("missing"))
