"""Spikes, stuck values and impossible readings per source (problem 5).

State space per source: a level that moves (random walk; counters with a
drift), read with noise.  A Kalman filter predicts each reading; a standardised
innovation beyond ``GATE`` is withheld from the filter.  If within at most
three readings the series comes back inside the gate, the withheld ones are
spikes; otherwise the level has moved and the filter restarts on it.  Runs of
exactly equal readings whose innovations lose their variance while the rest of
the series keeps changing are stuck: a second filter, with gain one, follows
each reading, and where the variance of its innovations over ``STUCK_RUN``
readings vanishes against their usual variance, a run is looked at; equality
then fixes its ends.  Whether the series otherwise keeps changing is judged by
the block, and by all blocks of the series where the block has fewer than
``JUDGED`` other readings.  Values that the unit rules out are flagged by
themselves and never reach the filter.

Scale: a source is cut by time into blocks of ``BLOCK`` steps, each read
together with ``HALO`` steps on both sides, in which the filter settles and
looks ahead (gains are 0.13 or more, so a wrong start is forgotten to 2e-6 of
itself); noise levels are estimated per block ("around that time").  Pauses of
more than 50 steps let the level move as far as 50 steps do.  A
source with a third of all rows thus spreads over its blocks.  Copies of a
reading are reduced to one before they travel (partial aggregation) and are
found again by a join of the few flagged readings with the rows.

Defined results: NULL and NaN values are never flagged and do not interrupt a
run; repeated rows are all flagged or none; two values at one second are two
successive readings, the smaller first; rows of unregistered series are left
out; a source with fewer than 4 readings only has impossible values flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.lanes import runs, whole_groups
from tracelode.functions.series import metric_name, with_series_hash
from tracelode.session import cut, fits, parallelism

BLOCK, HALO = 1024, 96
GATE = 6.0
SPIKE, STUCK_RUN = 3, 10
#: What a variance must fall below, relative to the usual one, to count as vanished; other readings that a block needs to judge a run.
VANISHED, JUDGED = 1e-18, 8

# What a unit allows (lowest, highest); infinite values exist for no unit.
UNIT_BOUNDS = {
    "percent": (0.0, 100.0), "celsius": (-273.15, None), "kpa": (0.0, None), "rpm": (0.0, None), "kmh": (0.0, None),
    "grams_per_second": (0.0, None), "km": (0.0, None), "turns": (0.0, None), "bool": (0.0, 1.0), "gear": (-1.0, 20.0),
    "milliseconds": (0.0, None), "millilitres": (0.0, None), "bytes": (0.0, None), "seconds": (0.0, None), "count": (0.0, None),
}
_LOWEST, _HIGHEST = -1.7e308, 1.7e308
_KINDS = {"gauge": 0, "counter": 1, "state": 2}


def registered_series(targets: DataFrame, defs: DataFrame) -> DataFrame:
    """``h1, h2, sid, step, kind, lowest, highest``, one row a registered series."""
    bounds = lambda i, d: F.coalesce(F.create_map(*[F.lit(x) for u, b in UNIT_BOUNDS.items() for x in (u, b[i] if b[i] is not None else d)])[F.col("unit")], F.lit(d))
    d = defs.select(metric_name(F.col("metric")).alias("m"), bounds(0, _LOWEST).alias("lowest"), bounds(1, _HIGHEST).alias("highest"), F.coalesce(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.col("kind")], F.lit(2)).alias("kind")).dropDuplicates(["m"])
    t = with_series_hash(targets).groupBy("h1", "h2").agg(F.min("target_id").alias("sid"), F.min(F.when(F.col("step_sec") > 0, F.col("step_sec"))).alias("step"), F.min(metric_name(F.col("metric"))).alias("m"))
    return t.join(d, "m", "left").select("h1", "h2", "sid", F.coalesce("step", F.lit(60)).alias("step"), F.coalesce("kind", F.lit(2)).alias("kind"), F.coalesce("lowest", F.lit(_LOWEST)).alias("lowest"), F.coalesce("highest", F.lit(_HIGHEST)).alias("highest"))


# ---- one block: arrays in, flags out -----------------------------------------------------------
def _mad_var(d: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Variance of each column's ``d`` where ``ok``, from the median of its size; robust against spikes."""
    x = np.where(ok, np.abs(d), np.nan)
    x = np.sort(x, axis=0)
    n = ok.sum(axis=0)
    cols = np.arange(x.shape[1])
    mid = np.where(n > 0, x[np.maximum(n - 1, 0) // 2, cols], 0.0)
    # of a few equal steps the median may be 0 although the series moves: fall back on the trimmed mean
    trim = np.where(n > 0, np.nansum(np.where(np.arange(len(x))[:, None] < np.maximum(n * 4 // 5, 1), x, 0), axis=0) / np.maximum(n * 4 // 5, 1), 0.0)
    return np.maximum(1.4826 * mid, 1.2 * trim) ** 2


def _long_runs(y: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which readings equal the one before, and which lie in a run of ``STUCK_RUN`` or more."""
    n, lanes = y.shape
    same = np.zeros((n, lanes), bool)
    same[1:] = (y[1:] == y[:-1]) & there[1:]
    row = np.arange(n)[:, None]
    length = row - np.maximum.accumulate(np.where(same, 0, row), axis=0) + 1
    total = np.zeros((n, lanes), int)
    run = np.zeros(lanes, int)
    for j in range(n - 1, -1, -1):
        run = np.where(same[j + 1], run, length[j]) if j + 1 < n else length[j]
        total[j] = run
    return same, there & (total >= STUCK_RUN)


def _vanished(y: np.ndarray, there: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Readings in a stretch of ``STUCK_RUN`` over which the innovations of the filter with gain one lose their variance."""
    n, lanes = y.shape
    e2 = np.full((n, lanes), np.inf)
    e2[1:] = np.where(there[1:], (y[1:] - y[:-1]) ** 2, np.inf)
    k = STUCK_RUN - 1
    calm = np.zeros((n, lanes), bool)
    if n > k:
        total = sum(e2[1 + i : n - k + 1 + i] for i in range(k))  # window of the k innovations after each reading
        ends = total <= VANISHED * k * usual
        for i in range(STUCK_RUN):
            calm[i : n - k + i] |= ends
    return calm & there


def flag_block(t: np.ndarray, v: np.ndarray, live: np.ndarray, impossible: np.ndarray, kind: np.ndarray, step: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spike and stuck flags for readings laid out as (position, lane).

    ``live`` tells which positions hold a reading; they are in order of time.  Then for each lane whether its
    stuck flags stand (else the series has to tell), and of its ``own`` readings outside of runs their number
    and how many differ from the one before."""
    n, lanes = v.shape
    spike, stuck = np.zeros((n, lanes), bool), np.zeros((n, lanes), bool)
    use = live & ~impossible
    # positions of the usable readings, packed to the front of each lane
    order = np.argsort(~use, axis=0, kind="stable")
    m = use.sum(axis=0)
    y, s = np.take_along_axis(v, order, 0), np.take_along_axis(t, order, 0) / step
    there = np.arange(n)[:, None] < m
    y = np.where(there, y, 0.0)
    gap = np.zeros((n, lanes))
    gap[1:] = np.clip(np.where(there[1:], s[1:] - s[:-1], 1.0), 0.0, 50.0)

    # drift of counters: median increment per step; noise and movement from robust differences
    d1 = np.diff(y, axis=0)
    # a stuck stretch says nothing of the noise; elsewhere equal neighbours count
    _, idle = _long_runs(y, there)
    idle &= kind == 0
    ok1 = there[1:] & there[:-1] & ~(idle[1:] & idle[:-1])
    inc = np.sort(np.where(ok1 & (d1 >= 0), d1 / np.maximum(gap[1:], 0.5), np.nan), axis=0)
    up = (ok1 & (d1 >= 0)).sum(axis=0)
    drift = np.where((kind == 1) & (up > 0), np.nan_to_num(inc[np.maximum(up - 1, 0) // 2, np.arange(lanes)]) if n > 1 else 0.0, 0.0)
    e1 = d1 - drift * gap[1:]
    v1 = _mad_var(e1, ok1) if n > 1 else np.zeros(lanes)
    k = 8
    if n > k:
        span = s[k:] - s[:-k]
        vk = _mad_var(y[k:] - y[:-k] - drift * np.minimum(span, 50.0 * k), there[k:] & there[:-k] & ~(idle[k:] & idle[:-k]))
        q = np.where((there[k:] & there[:-k]).any(axis=0), np.clip((vk - v1) / (k - 1), 0.02 * v1, 0.9 * v1), 0.1 * v1)
    else:
        q = 0.1 * v1
    size = np.max(np.abs(y), axis=0) if n else np.zeros(lanes)
    r = np.maximum((v1 - q) / 2, (1e-9 * size) ** 2 + 1e-18)
    # what rounding hides: noise below the spacing of the values says nothing
    active = (kind < 2) & (m >= 4)

    # the level at first: median of up to five readings, so that a spike there does not set it
    head = np.sort(np.where(there[:5], y[:5], np.inf), axis=0)
    level = np.where(m > 0, head[np.maximum(np.minimum(m, 5) - 1, 0) // 2, np.arange(lanes)], 0.0)
    P = r * 4 + q
    innov = np.zeros((n, lanes))
    rows = np.arange(lanes)
    skip = np.zeros(lanes, int)  # readings yet to be withheld of a spike under way
    out = np.zeros((n, lanes), bool)
    for j in range(n):
        now = there[j] & active
        level = np.where(now, level + drift * gap[j], level)
        P = np.where(now, P + q * np.maximum(gap[j], 0.05), P)
        S = P + r
        e = np.where(now, y[j] - level, 0.0)
        innov[j] = e / np.sqrt(S)
        withheld = now & (skip > 0)
        out[j] |= withheld
        skip = np.where(withheld, skip - 1, skip)
        odd = now & ~withheld & (np.abs(innov[j]) > GATE)
        jump = np.zeros(lanes, bool)
        if odd.any():
            back = np.zeros(lanes, int)
            lead = np.zeros(lanes)
            for a in range(1, SPIKE + 1):
                if j + a >= n:
                    break
                lead = lead + gap[j + a]
                spread = np.sqrt(P + q * lead + r)
                # back home: inside the gate and nearer to the old level than to where the reading went
                home = np.abs(y[j + a] - level - drift * lead) <= np.minimum(GATE * spread, 0.5 * np.abs(e))
                # a counter only leaves and returns if it falls: a large step up that lasts is none
                falls = (kind != 1) | np.where(e > 0, y[j + a] < y[j], y[j] < y[np.maximum(j - 1, 0)])
                back = np.where((back == 0) & there[j + a] & home & falls, a, back)
            hit = odd & (back > 0)
            out[j] |= hit
            skip = np.where(hit, back - 1, skip)
            withheld = withheld | hit
            jump = odd & ~hit
        take = now & ~withheld & ~jump
        K = P / S
        level = np.where(take, level + K * e, level)
        P = np.where(take, (1 - K) * P, P)
        if jump.any():
            ahead = y[np.minimum(j + np.arange(4), n - 1)]
            seen = there[np.minimum(j + np.arange(4), n - 1)]
            ahead = np.sort(np.where(seen, ahead, np.inf), axis=0)
            some = ahead[np.maximum(seen.sum(axis=0) - 1, 0) // 2, rows]
            level = np.where(jump, np.where(kind == 1, y[j], some), level)
            P = np.where(jump, r * 2 + q, P)
    at = np.where(there & out)
    spike[order[at], at[1]] = True

    # stuck: runs of one value, over all live readings
    order = np.argsort(~live, axis=0, kind="stable")
    m = live.sum(axis=0)
    y = np.take_along_axis(v, order, 0)
    there = np.arange(n)[:, None] < m
    same, long = _long_runs(y, there)
    d = np.where(there[1:] & there[:-1] & ~same[1:], np.abs(y[1:] - y[:-1]), np.nan) if n > 1 else np.zeros((0, lanes))
    changed = (~np.isnan(d)).sum(axis=0)
    d = np.sort(d, axis=0)
    usual = np.where(changed > 0, np.nan_to_num(d[np.maximum(changed - 1, 0) // 2, np.arange(lanes)]) ** 2, 0.0) if n > 1 else np.zeros(lanes)
    with np.errstate(over="ignore", invalid="ignore"):
        calm = _vanished(y, there, usual)
    others = there & ~long
    moving = (others & ~same).sum(axis=0) >= np.maximum(0.5 * others.sum(axis=0), 3)
    sure = others.sum(axis=0) >= JUDGED
    hold = calm & long & (kind == 0) & (moving | ~sure)
    at = np.where(hold)
    stuck[order[at], at[1]] = True
    mine = others if own is None else others & np.take_along_axis(own, order, 0)
    return spike, stuck, sure, mine.sum(axis=0), (mine & ~same).sum(axis=0)


_FLAGS = "sid bigint, ts bigint, value double, spike boolean, stuck boolean, impossible boolean, sure boolean, others bigint, changes bigint"


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings sorted by (sid, block, ts, value) -> the flagged ones among each block's own, and one row
    without time for each block of gauges: readings outside of runs, and how many of them changed."""
    for tab in whole_groups(batches, ["sid", "block"], 120_000):
        sid, block, ts, value, own = (tab.column(c).to_numpy() for c in ("sid", "block", "ts", "value", "own"))
        lowest, highest, kind, step = (tab.column(c).to_numpy() for c in ("lowest", "highest", "kind", "step"))
        bad = (value < lowest) | (value > highest) | ~np.isfinite(value)
        first = runs(sid, block)
        size = np.diff(np.append(first, len(sid)))
        spike, stuck, sure = np.zeros(len(sid), bool), np.zeros(len(sid), bool), np.zeros(len(sid), bool)
        others, changes = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        # lanes of like length together, so that padding stays small
        by_size = np.argsort(size, kind="stable")
        a = 0
        while a < len(by_size):
            b = a + 1
            while b < len(by_size) and size[by_size[b]] <= 1.3 * size[by_size[a]] + 16 and (b - a) * size[by_size[b]] < 2_000_000:
                b += 1
            g = by_size[a:b]
            n = int(size[g[-1]])
            rows = first[g] + np.minimum(np.arange(n)[:, None], size[g] - 1)
            live = np.arange(n)[:, None] < size[g]
            f0 = first[g]
            rel = (ts[rows] - ts[f0]).astype(float)
            v = np.where(live & np.isfinite(value[rows]), value[rows], 1e300)
            s1, s2, known, others[g], changes[g] = flag_block(rel, v, live, bad[rows] | ~live, kind[f0], step[f0].astype(float), live & own[rows])
            sure[rows[live]] = np.broadcast_to(known, live.shape)[live]
            spike[rows[live]] = s1[live]
            stuck[rows[live]] = s2[live]
            a = b
        keep = own & (bad | spike | stuck)
        told = (kind[first] == 0) & (others > 0)
        names = [f.split()[0] for f in _FLAGS.split(", ")]
        nothing = [pa.nulls(int(keep.sum()), pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (sid, ts, value, spike, stuck, bad, sure)), *nothing], names=names)
        k = int(told.sum())
        yield pa.RecordBatch.from_arrays([pa.array(sid[first][told]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), *[pa.nulls(k, pa.bool_())] * 4, pa.array(others[told]), pa.array(changes[told])], names=names)


#: Copies of each series when they are joined by shuffle: a series with a third of all readings meets them in that many tasks.
SALTS = 32


def _merged(df: DataFrame) -> DataFrame:
    """``df`` that is too large to be sent.  Without a hint Spark judges by bytes on disk, packed and before
    ``explode``, and may gather the whole in the driver."""
    return df.hint("merge")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df) else _merged(df)


def _with_series(readings: DataFrame, series: DataFrame, *on: str) -> DataFrame:
    keys = list(on) or ["h1", "h2"]
    if fits(series):
        return readings.join(F.broadcast(series), keys)
    salted = series.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return readings.withColumn("salt", F.pmod(F.xxhash64("ts"), F.lit(SALTS)).cast("int")).join(_merged(salted), [*keys, "salt"]).drop("salt")


def implausible(metrics: DataFrame, targets: DataFrame, defs: DataFrame) -> DataFrame:
    """``point_id, sid, ts, value, spike, stuck, impossible``: one row per flagged row of a registered series."""
    spark = metrics.sparkSession
    reg = registered_series(targets, defs)
    m = metrics.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("timestamp").isNotNull())
    m = with_series_hash(m).select("h1", "h2", F.col("timestamp").alias("ts"), "value", "point_id")
    info = cut(reg, "series")
    rows = cut(_with_series(m, info.select("h1", "h2", "sid")).select("sid", "ts", F.expr("value + 0.0D").alias("value"), "point_id"), "readings")
    readings = rows.select("sid", "ts", "value").distinct()
    readings = _with_series(readings, info.drop("h1", "h2"), "sid")
    width, halo = F.col("step").cast("bigint") * BLOCK, F.col("step").cast("bigint") * HALO
    block = F.floor(F.col("ts") / width)
    inside = F.col("ts") - block * width
    blocks = F.array_compact(F.array(block, F.when(inside < halo, block - 1), F.when(inside >= width - halo, block + 1)))
    x = readings.withColumn("home", block).withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == F.col("home")).drop("home")
    flagged = x.repartition(parallelism(spark, 1), "sid", "block").sortWithinPartitions("sid", "block", "ts", "value").mapInArrow(_flag, _FLAGS)
    out = cut(flagged, "flags")
    per = out.where("ts is null").groupBy("sid").agg((F.sum("changes") >= F.greatest(0.5 * F.sum("others"), F.lit(3))).alias("moving"))
    flagged = out.where("ts is not null").drop("others", "changes")
    if not flagged.where("stuck and not sure").isEmpty():
        flagged = flagged.join(_small(per), "sid", "left").withColumn("stuck", F.col("stuck") & (F.col("sure") | F.coalesce("moving", F.lit(False)))).where("spike or stuck or impossible")
    return rows.join(_small(flagged), ["sid", "ts", "value"]).select("point_id", "sid", "ts", "value", "spike", "stuck", "impossible")
