"""Regular grid: missing slots by brute force, values by one plain Kalman smoother."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import grid

M = "point_id bigint, metric string, tags map<string,string>, timestamp bigint, value double, ingest_ms bigint"
T = "target_id bigint, metric string, tags map<string,string>, step_sec int, start_sec bigint, end_sec bigint"


def smooth(times, ys, at, q, r, m0, P0):
    """Reference: all readings and grid times in one sequence, forward filter and RTS backward pass."""
    seq = sorted([(t, 0, y) for t, y in zip(times, ys)] + [(t, 1, None) for t in at], key=lambda x: (x[0], -x[1]))
    m, P, prev = np.array(m0, float), np.array(P0, float), at[0]
    fm, fP, pm, pP, As = [], [], [], [], []
    for t, _, y in seq:
        d = t - prev
        A = np.array([[1, d], [0, 1.0]])
        Q = q * np.array([[d**3 / 3, d**2 / 2], [d**2 / 2, d]])
        m, P = A @ m, A @ P @ A.T + Q
        As.append(A), pm.append(m), pP.append(P)
        if y is not None:
            S = P[0, 0] + r
            K = P[:, 0] / S
            m, P = m + K * (y - m[0]), P - np.outer(K, P[0])
        fm.append(m), fP.append(P)
        prev = t
    sm, sP = fm[-1], fP[-1]
    out = {}
    for i in range(len(seq) - 1, -1, -1):
        if i < len(seq) - 1:
            G = fP[i] @ As[i + 1].T @ np.linalg.pinv(pP[i + 1])
            sm, sP = fm[i] + G @ (sm - pm[i + 1]), fP[i] + G @ (sP - pP[i + 1]) @ G.T
        if seq[i][1]:
            out[seq[i][0]] = (sm[0], sP[0, 0])
    return out


def test_blocks_give_the_result_of_one_recursion(spark):
    rng = np.random.default_rng(3)
    n, step, start = 900, 10, 1_600_000_000
    keep = np.sort(rng.choice(n, 500, replace=False))
    keep = keep[(keep < 300) | (keep > 420)]
    ts = start + keep * step + rng.integers(0, step, len(keep))
    ys = 50 + np.cumsum(rng.normal(0, 0.3, n))[keep] + rng.normal(0, 0.5, len(keep))
    m = spark.createDataFrame([(i, "a.b", {"x": "1", "e": ""}, int(t), float(y), 0) for i, (t, y) in enumerate(zip(ts, ys))], M)
    t = spark.createDataFrame([(7, "a_b", {"x": "1"}, step, start, start + n * step)], T)
    g = grid.regular_grid(m, t).orderBy("slot_sec").collect()
    assert len(g) == n and [r.missing for r in g] == [k not in set(keep) for k in range(n)]
    # the same model in one piece, with the noise the operator picked
    scan = grid.slot_readings(m, t)
    assert scan.where("at >= 0").count() == len(keep)
    packed = scan.repartition(1).sortWithinPartitions("target_id", "block", "at").mapInArrow(grid._pack, f"{grid._PACKED}, {grid._ELEM}")
    st = packed.select("target_id", "block", "a", "yn", "ysum", "ysq").repartition(1).sortWithinPartitions("target_id", "block").mapInArrow(grid._scan, grid._STATE).orderBy("block").collect()
    q, s2 = st[0].q, st[0].scale
    P0 = [[st[0].p[0], st[0].p[1]], [st[0].p[1], st[0].p[2]]]
    tau = np.float32((ts - start) % step / step)
    ref = smooth(list(keep + tau.astype(float)), list(ys), list(range(n)), q, 1.0, st[0].m, P0)
    np.testing.assert_allclose([r.value for r in g], [ref[k][0] for k in range(n)], rtol=1e-5)
    np.testing.assert_allclose([r.std for r in g], [np.sqrt(ref[k][1] * s2) for k in range(n)], rtol=1e-4)
    gap = [r.std for r in g][340:380]
    assert min(gap) > 2 * np.median([r.std for r in g][:280])  # uncertainty grows in a gap


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "m", None, 100, 1.0, 0), (2, "m", {}, 100, 1.0, 0), (3, "m", {"a": ""}, 131, nan, 0), (4, "m", {"a": None}, 145, None, 0), (5, "m", None, None, 3.0, 0), (6, "m", None, 160, inf, 0), (7, None, None, 100, 1.0, 0)]
    m = spark.createDataFrame(rows, M).withColumn("slot", F.lit(1)).withColumn("n", F.lit(2))
    t = spark.createDataFrame([(1, "m", None, 20, 100, 180), (2, "none", {"a": "b"}, 20, 100, 140), (3, "m", None, 0, 100, 180), (4, "m", None, 20, None, 180)], T)
    g = {(r.target_id, r.slot_sec): r for r in grid.regular_grid(m, t).collect()}
    assert sorted(g) == [(1, 100), (1, 120), (1, 140), (1, 160), (2, 100), (2, 120)]
    assert [g[1, s].missing for s in (100, 120, 140, 160)] == [False, True, True, False]
    assert g[1, 100].readings == 2 and g[1, 100].value == pytest.approx(1.0, abs=0.1)
    assert g[2, 100].value is None and g[2, 100].std is None and g[2, 100].missing
    empty = spark.createDataFrame([], M)
    assert grid.regular_grid(empty, t).count() == 6
    assert grid.regular_grid(m, spark.createDataFrame([], T)).count() == 0


def test_many_targets_join_by_time(spark, monkeypatch):
    rng = np.random.default_rng(8)
    start, step = 1_600_000_000 // 86_400 * 86_400 + 50_000, 3_600
    m = spark.createDataFrame([(i, "a.b", {"x": "1"}, int(t), 1.0, 0) for i, t in enumerate(start - 5_000 + rng.integers(0, 6 * 86_400, 3_000))], M)
    t = spark.createDataFrame([(1, "a_b", {"x": "1"}, step, start, start + 60 * step), (2, "a_b", {"x": "1"}, step, start + 60 * step, start + 110 * step), (3, "a_b", {"x": "2"}, step, start, start + 5 * step)], T)
    want = sorted(map(tuple, grid.slot_readings(m, t).select("target_id", "block", "at", "n").collect()))
    monkeypatch.setattr(grid, "fits", lambda df: False)
    assert sorted(map(tuple, grid.slot_readings(m, t).select("target_id", "block", "at", "n").collect())) == want and len(want) > 100


def test_bands_hold_the_withheld_values(spark):
    rng = np.random.default_rng(21)
    n, step, start = 2_000, 10, 1_600_000_000
    level = np.cumsum(np.cumsum(rng.normal(0, 0.02, n)))  # a local trend
    held = rng.random(n) < 0.25
    rows = [(int(i), "a_b", {"x": "1"}, start + int(i) * step, float(level[i] + rng.normal(0, 0.5)), 0) for i in np.flatnonzero(~held)]
    t = spark.createDataFrame([(1, "a_b", {"x": "1"}, step, start, start + n * step)], T)
    g = grid.regular_grid(spark.createDataFrame(rows, M), t).where("missing").orderBy("slot_sec").collect()
    inside = [abs(r.value - level[(r.slot_sec - start) // step]) <= 1.96 * r.std for r in g]
    assert len(inside) == held.sum() and 0.85 <= np.mean(inside) <= 1.0
