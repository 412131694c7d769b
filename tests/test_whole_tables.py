"""Registered queries that take in the whole of their tables, and what brute force makes of the same rows."""

import os

import pytest

from tracelode import corequeries as cq

M = "metric string, tags map<string,string>, timestamp bigint, value double"


def test_metric_queries_reach_the_last_days(spark, tmp_path):
    rows = [(m, {"group": g}, cq.M0 + day * 86_400, v) for m in ("fuel_level_percent", "battery_volts", "bus_load_percent", "speed_kmh") for g, day, v in (("group 0", 2, 3.0), ("group 2", 13, 9.0))]
    spark.createDataFrame(rows, M).write.parquet(f"{tmp_path}/metrics.parquet")
    last = cq.M0 + 13 * 86_400
    q = cq.queries()
    for name, want in (("promql_avg_by", 9.0), ("promql_abs", 9.0), ("promql_sqrt", 3.0), ("promql_hot_max_by", 9.0), ("otsdb_downsample", 9.0)):
        assert {r.ts: r.value for r in q[name](spark, str(tmp_path)).collect()}[last] == want, name


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_window_covers_the_given_tables(spark, sf):
    path = f"/root/testdata/{sf}/metrics.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    lo, hi = spark.read.parquet(path).selectExpr("min(timestamp)", "max(timestamp)").first()
    assert cq.M0 <= lo and hi <= cq.M1


def test_timechart_limit_counts_every_line(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, 1, "NRA"[i % 3 if i % 4 else 0], datetime(1995, 1, 2) + timedelta(days=i * 2499 // 299)) for i in range(300)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = cq.pipe("* | timechart span=5d count by l_returnflag limit=top 1", "lineitem")(spark, str(tmp_path)).toPandas().fillna(0).set_index("timestamp")
    start, width, want = 789_004_800_000, 5 * 86_400_000, {}
    for _, _, k, t in rows:
        ms = min(max(int((t - datetime(1970, 1, 1)).total_seconds() * 1000), start), 10**15)
        at = start + (ms - start) // width * width
        col = "N" if k == "N" else "other"
        want[at, col] = want.get((at, col), 0) + 1
    assert sorted(got.columns) == ["N", "other"]
    assert {(int(t), c): int(n) for t, r in got.iterrows() for c, n in r.items() if n} == want
    assert got.to_numpy().sum() == len(rows)


def test_stats_list_takes_all_events_in_time_order(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    rnd = random.Random(2)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(400)), rnd.choice([1, 1, 1, 5, 9]), rnd.choice(["click", "view", "signup"]), i + 0.5) for i in range(600)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    first = lambda k, at, v: ",".join(str(r[v]) for r in sorted((r for r in rows if r[at] == k), key=lambda r: (r[1], str(r[v])))[:100])
    for name, key, at, v in (("stats_list_by_user", "user_id", 2, 3), ("stats_list_by_type", "event_type", 3, 3), ("stats_list_values", "event_type", 3, 4)):
        got = {r[key]: r["l"] for r in cq.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {k: first(k, at, v) for k in {r[at] for r in rows}}, name


def test_timechart_without_limit_keeps_every_row(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from tracelode.lang.lex import QueryError
    from tracelode.operators import groups

    rows = [(i, datetime(2024, 1, 2), i % 5, "click", 1.0) for i in range(23)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    chart = lambda s: cq.engine(spark, str(tmp_path)).search(s, "events").toPandas()
    assert chart("* | timechart span=1d count by user_id limit=0").drop(columns="timestamp").to_numpy().sum() == 23
    monkeypatch.setattr(groups, "SPLIT_MOST", 3)
    got = chart("* | timechart span=1d count by user_id limit=0").drop(columns="timestamp").iloc[0].to_dict()
    assert got == {"0": 5, "1": 5, "2": 5, "other": 8}
    with pytest.raises(QueryError):
        chart("* | timechart span=1d count by user_id limit=0 useother=false")


def test_histogram_takes_every_spelling(spark, tmp_path):
    rows = [(m, {}, cq.M0, v) for m, v in (("request_latency_ms", 5.0), ("request.latency.ms", 50.0), ("request-latency_ms", 60.0))]
    spark.createDataFrame(rows, M).write.parquet(f"{tmp_path}/metrics.parquet")
    assert cq.queries()["promql_histogram_quantile"](spark, str(tmp_path)).first()["value"] == pytest.approx(10 + 90 * (2.7 - 1) / 2)
