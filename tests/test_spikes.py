"""Implausible readings: planted cases come out, normal behaviour does not."""

import numpy as np
from pyspark.sql import functions as F

from tracelode.operators import spikes

M = "point_id bigint, metric string, tags map<string,string>, timestamp bigint, value double, ingest_ms bigint"
T = "target_id bigint, metric string, tags map<string,string>, step_sec int, start_sec bigint, end_sec bigint"
DEFS = [("temp_celsius", "celsius", "gauge"), ("load_percent", "percent", "gauge"), ("odo_km", "km", "counter"), ("gear_position", "gear", "state"), ("door_bool", "bool", "state")]
T0 = 1_600_000_000


def flags(spark, series, step=10):
    rows, i = [], 0
    for metric, vals in series.items():
        for k, v in enumerate(vals):
            rows.append((i, metric, {"u": "1"}, T0 + k * step, None if v is None else float(v), 0))
            i += 1
    m = spark.createDataFrame(rows, M).withColumn("kind", F.lit("clash")).withColumn("block", F.lit(0))
    t = spark.createDataFrame([(j, n, {"u": "1"}, step, T0, T0 + 10**6) for j, n in enumerate(series)], T)
    d = spark.createDataFrame(DEFS, "metric string, unit string, kind string")
    got = {r.point_id: r for r in spikes.implausible(m, t, d).collect()}
    out, i = {}, 0
    for metric, vals in series.items():
        out[metric] = {k: (got[i + k].spike, got[i + k].stuck, got[i + k].impossible) for k in range(len(vals)) if i + k in got}
        i += len(vals)
    return out


def test_planted(spark):
    rng = np.random.default_rng(5)
    n = 5000
    temp = 20 + 5 * np.sin(np.arange(n) / 300) + np.cumsum(rng.normal(0, 0.05, n)) + rng.normal(0, 0.4, n)
    temp[3000:] += 15  # a level that lasts
    temp = np.round(temp, 2)
    want = {}
    for at, k in ((5, 1), (700, 3), (1023, 2), (1024 * 2 - 1, 2), (4000, 1), (4500, 3)):
        temp[at : at + k] += rng.choice([-1, 1]) * 12
        want |= {j: "spike" for j in range(at, at + k)}
    temp[2500:2515] = temp[2500]
    temp[1018:1020] = temp[1018]
    want |= {j: "stuck" for j in range(2500, 2515)}
    temp[100] = -300.0
    want[100] = "impossible"
    odo = 5000 + np.cumsum(rng.integers(0, 8, n)) / 10
    odo[2000:] -= odo[2000] - 0.3  # a reset
    odo[500:502] += 40
    odo[900:920] = odo[900]  # a counter may stand still
    load = np.clip(np.round(50 + rng.normal(0, 2, n), 1), 0, 100)
    load[10] = 100.5
    gear = rng.integers(1, 7, n // 20).repeat(20).astype(float)
    door = rng.integers(0, 2, n // 50).repeat(50).astype(float)
    door[7] = 2
    got = flags(spark, {"temp_celsius": temp, "odo_km": odo, "load_percent": load, "gear_position": gear, "door_bool": door})
    name = lambda f: "impossible" if f[2] else "stuck" if f[1] else "spike"
    assert {k: name(f) for k, f in got["temp_celsius"].items()} == want
    assert sorted(got["odo_km"]) == [500, 501]
    assert got["load_percent"][10][2] and set(got["load_percent"]) == {10}
    assert got["gear_position"] == {} and set(got["door_bool"]) == {7}


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    wave = list(np.round(20 + np.random.default_rng(1).normal(0, 1, 60), 2))
    stuck = wave[:30] + [21.0] * 5 + [None, nan] + [21.0] * 5 + wave[30:]
    got = flags(spark, {"temp_celsius": stuck, "load_percent": [50.0, 50.0, inf], "odo_km": []})
    assert sorted(got["temp_celsius"]) == [30, 31, 32, 33, 34, 37, 38, 39, 40, 41]
    assert sorted(got["load_percent"]) == [2]
    # a source that never changes is not stuck
    assert flags(spark, {"temp_celsius": [5.0] * 100})["temp_celsius"] == {}
    # copies are flagged with the reading; unregistered series and empty tables give nothing
    m = spark.createDataFrame([(i, "load.percent", {"u": "1", "e": ""}, T0, 255.0, 0) for i in range(3)] + [(9, "other", None, T0, 1e300, 0)], M)
    t = spark.createDataFrame([(1, "load_percent", {"u": "1"}, 10, T0, T0 + 100)], T)
    d = spark.createDataFrame(DEFS, "metric string, unit string, kind string")
    assert sorted(r.point_id for r in spikes.implausible(m, t, d).collect()) == [0, 1, 2]
    assert spikes.implausible(spark.createDataFrame([], M), t, d).count() == 0
    assert spikes.implausible(m, spark.createDataFrame([], T), d).count() == 0


def test_stuck_longer_than_blocks(spark):
    rng = np.random.default_rng(3)
    v = np.round(20 + rng.normal(0, 1, 6000), 3)
    v[1500:5200] = 21.5
    v[1499], v[5200] = 20.0, 20.1
    got = flags(spark, {"temp_celsius": v})["temp_celsius"]
    assert sorted(got) == list(range(1500, 5200)) and all(f[1] for f in got.values())


def test_vanishing_variance_needs_a_whole_window():
    y = np.array([[1.0], [2.0], *[[3.0]] * 10, [3.0 + 1e-7], [4.0]])
    there = np.ones(y.shape, bool)
    assert spikes._vanished(y, there, np.array([1.0]))[:, 0].tolist() == [False] * 2 + [True] * 10 + [False] * 2
    assert not spikes._vanished(y[:9], there[:9], np.array([1.0])).any() and spikes._vanished(y[2:12], there[2:12], np.array([0.0])).all()


def test_series_too_many_to_be_sent(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.round(20 + rng.normal(0, 0.5, 400), 2)
    v[100] = 60.0
    want = flags(spark, {"temp_celsius": v})
    monkeypatch.setattr(spikes, "fits", lambda df: False)
    assert flags(spark, {"temp_celsius": v}) == want and 100 in want["temp_celsius"]


def test_joins_too_large_to_be_sent_are_merged(spark, monkeypatch, tmp_path):
    # packed these tables are far below Spark's own threshold, unpacked and salted they would fill the driver
    monkeypatch.setattr(spikes, "fits", lambda df: False)
    spark.range(40_000).selectExpr("id AS h1", "id AS h2", "id AS sid").write.parquet(f"{tmp_path}/series")
    spark.range(40_000).selectExpr("id AS h1", "id AS h2", "id % 7 AS ts").write.parquet(f"{tmp_path}/readings")
    series, readings = spark.read.parquet(f"{tmp_path}/series"), spark.read.parquet(f"{tmp_path}/readings")
    for df in (spikes._with_series(readings, series), spikes._with_series(readings.withColumnRenamed("h1", "sid").drop("h2"), series.select("sid"), "sid")):
        assert df.count() == 40_000
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    m = spark.createDataFrame([(i, "load_percent", {"u": "1"}, T0 + i, 255.0 if i == 3 else 50.0, 0) for i in range(9)], M)
    t = spark.createDataFrame([(1, "load_percent", {"u": "1"}, 1, T0, T0 + 9)], T)
    got = spikes.implausible(m, t, spark.createDataFrame(DEFS, "metric string, unit string, kind string"))
    assert [r.point_id for r in got.collect()] == [3]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
