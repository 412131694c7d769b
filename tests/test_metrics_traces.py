"""Range functions and matching by a plain model; traces; streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelode.metrics.evaluate import Evaluator, labels_text, step_for
from tracelode.streaming import live
from tracelode.traces import spans

M = "metric string, tags map<string,string>, timestamp bigint, value double"


def run(spark, rows, text, start, end, step):
    v = Evaluator(spark.createDataFrame(rows, M), start, end, step).query(text)
    return {(r.l, r.ts): r.value for r in v.select(labels_text(F.col("labels")).alias("l"), "ts", "value").collect()}


def model_rate(pts, t, w):
    p = [(a, v) for a, v in pts if t - w <= a <= t]
    if len(p) < 2:
        return None
    d = sum(b if b < a else b - a for (_, a), (_, b) in zip(p, p[1:]))
    span, mean = p[-1][0] - p[0][0], (p[-1][0] - p[0][0]) / (len(p) - 1)
    lead, tail = p[0][0] - (t - w), t - p[-1][0]
    lead = mean / 2 if lead >= 1.1 * mean else lead
    if d > 0 and p[0][1] >= 0:
        lead = min(lead, span * p[0][1] / d)
    tail = mean / 2 if tail >= 1.1 * mean else tail
    return d * (span + lead + tail) / span


def test_range_functions_against_model(spark):
    rnd = random.Random(3)
    series = {k: [(10 * i, float(rnd.randint(0, 40))) for i in range(60) if rnd.random() < 0.8] for k in "ab"}
    rows = [("m", {"k": k, "e": ""}, t, v) for k, p in series.items() for t, v in p]
    got = run(spark, rows, "increase(m[100s])", 100, 580, 10)
    for k, p in series.items():
        for t in range(100, 590, 10):
            want = model_rate(p, t, 100)
            assert (want is None) == ((f"k={k}", t) not in got)
            if want is not None:
                assert got[f"k={k}", t] == pytest.approx(want)
    avg = run(spark, rows, "sum_over_time(m[50s])", 100, 580, 10)
    for k, p in series.items():
        for t in range(100, 590, 10):
            assert avg[f"k={k}", t] == pytest.approx(sum(v for a, v in p if t - 50 < a <= t))
    res = run(spark, rows, "resets(m[100s])", 100, 580, 10)
    for k, p in series.items():
        for i, (t, _) in enumerate(p):
            if t >= 100:
                w = [v for a, v in p[: i + 1] if a >= t - 100]
                assert res[f"k={k}", t] == sum(b < a for a, b in zip(w, w[1:]))


def test_matching_and_errors(spark):
    rows = [("a", {"x": "1", "y": "p"}, 0, 6.0), ("a", {"x": "1", "y": "q"}, 0, 8.0), ("b", {"x": "1"}, 0, 2.0), ("b", None, 0, 9.0), ("b", {"x": "1"}, 0, None), ("b", {"x": "1"}, 0, float("nan"))]
    go = lambda q: run(spark, rows, q, 0, 0, 10)
    assert go("a / on(x) group_left b") == {("x=1,y=p", 0): 3.0, ("x=1,y=q", 0): 4.0}
    assert go("b * on(x) group_right a") == {("x=1,y=p", 0): 12.0, ("x=1,y=q", 0): 16.0}
    with pytest.raises(Exception, match="many series"):
        go("a / on(x) b")
    assert go("a and on(x) b") == {("__name__=a,x=1,y=p", 0): 6.0, ("__name__=a,x=1,y=q", 0): 8.0} and go("a unless on(x) b") == {}
    assert go("b / 0") == {} and go("1 + 2 * 3 ^ 2") == {("", 0): 19.0} and go("-b > -5") == {("x=1", 0): -2.0}
    assert go('b{x=""}') == {("__name__=b", 0): 9.0} and go("nosuch") == {} and go("clamp(b, 5, 1)") == {}
    assert go("count(sum by (x) (a or b))") == {("", 0): 2.0}
    assert step_for(0, 86_400) == 300 and Evaluator(spark.createDataFrame([], M), 0, 100).query("rate(m[50s])").count() == 0


def test_histogram_rules(spark):
    e = Evaluator(spark.createDataFrame([], M), 0, 0, 10)
    h = lambda b, phi: (lambda r: r[0].value if r else None)(e.histogram_quantile(phi, spark.createDataFrame([([("le", le)], 0, float(v)) for le, v in b], "labels array<struct<key:string,value:string>>, ts bigint, value double")).collect())
    assert h([("1", 2), ("2", 6), ("+Inf", 8)], 0.5) == pytest.approx(1.5) and h([("1", 2), ("2", 6), ("+Inf", 8)], 0.99) == 2.0
    assert h([("1", 2), ("2", 6)], 0.5) != h([("1", 2), ("2", 6)], 0.5)  # no +Inf: NaN
    assert h([("-1", 5), ("+Inf", 8)], 0.1) == -1.0


def test_traces(spark):
    s = "trace_id string, span_id string, parent_span_id string, service string, name string, status string, start_time bigint, end_time bigint, duration bigint"
    E = "STATUS_CODE_ERROR"
    rows = [("t", "1", "", "web", "get", "OK", 0, 100, 100), ("t", "2", "1", "web", "in", "OK", 10, 50, 40), ("t", "3", "2", "db", "q", E, 20, 40, 20_000_000), ("t", "4", "nope", "db", "q", "OK", 30, 40, 10), ("u", "1", None, "db", None, None, None, None, None), ("r", "1", "2", "x", "a", "OK", 0, 1, 1), ("r", "2", "1", "x", "a", "OK", 0, 1, 1)]
    df = spark.createDataFrame(rows, s)
    assert {(r.parent, r.child): r.callCount for r in spans.dependencies(df).collect()} == {("web", "db"): 1}
    red = {r.service: r for r in spans.red(df).collect()}
    assert red["web"].rate == pytest.approx(1 / 60) and red["db"].error_rate == pytest.approx(100 / 3) and red["db"].p99 == pytest.approx(19.6, rel=0.05)
    tree = {r.trace_id: r for r in spans.span_trees(df).collect()}
    assert tree["t"].spans == 4 and tree["t"].orphans == 1 and tree["t"].depth == 3 and tree["r"].tree == "null"
    assert spans.trace_summaries(df).where("trace_id = 't'").first().service_name == "web" and spans.total_traces(df).first()[0] == 3
    e = spark.createDataFrame([], s)
    assert spans.red(e).count() == spans.span_trees(e).count() == spans.dependencies(e).count() == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(f"2024-01-01 00:{m:02d}:00", k, float(m)) for m in range(0, 50, 5) for k in ("a", "b")] + [("2024-01-01 00:00:00", "a", 0.0)]
    spark.createDataFrame(rows, "t string, k string, v double").selectExpr("cast(t as timestamp) t", "k", "v").coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema("t timestamp, k string, v double").parquet(src)

    def done(df, name, mode="append"):
        q = live.to_memory(df, name, mode, str(tmp_path / name))
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert done(live.tail(read(), "k=a | where v>20 | eval w=v*2 | fields w"), "tailed").count() == 5
    w = done(live.windowed_stats(read(), "t", "10 minutes", "count, sum(v) AS s by k", late="0 seconds"), "windows", "complete")
    assert w.count() == 10 and w.where("k = 'a'").agg(F.sum("s")).first()[0] == sum(range(0, 50, 5))
    assert done(live.dedup(read(), ["k", "v"], "t"), "deduped").count() == 20
    assert done(live.sessions(read(), "t", ["k"], "6 minutes"), "sess", "complete").count() == 2
    a = spark.createDataFrame([(i, "x", v) for i, v in enumerate([1.0, 9.0, 9.0, 9.0, None, 9.0])], "i int, k string, v double")
    assert [r.state for r in live.alert_states(a, ">", 5, 3, ["k"], "i", "v").orderBy("i").collect()] == ["Normal", "Pending", "Pending", "Firing", "Normal", "Pending"]


def test_sort_formula_names_and_loose_labels(spark):
    rows = [("a", {"x": "1"}, 0, 6.0), ("a", {"x": "2"}, 0, 8.0), ("b", {"z": "9"}, 0, 2.0)]
    ev = Evaluator(spark.createDataFrame(rows, M), 0, 0, 10)
    assert [r.value for r in ev.query("sort_desc(a)").collect()] == [8.0, 6.0] and [r.value for r in ev.query("sort(a)").collect()] == [6.0, 8.0]
    assert [r.value for r in ev.instant("sort_desc(a)").collect()] == [8.0, 6.0]
    out = lambda df: {(r.l, r.value) for r in df.select(labels_text(F.col("labels")).alias("l"), "value").collect()}
    assert out(ev.formula("first + second", {"first": "a", "second": "b"})) == set()
    assert out(ev.formula("first - second", {"first": "a", "second": "b"}, match_labels=False)) == {("x=1", 4.0), ("x=2", 6.0)}
    assert out(ev.formula("second - first", {"first": "a", "second": "b"}, match_labels=False)) == {("x=1", -4.0), ("x=2", -6.0)}
    assert out(ev.formula("q1 * q1", {"q1": "a"}, match_labels=False)) == {("x=1", 36.0), ("x=2", 64.0)}


def test_opentsdb_refuses_what_it_does_not_do(spark):
    from tracelode.lang.lex import QueryError
    from tracelode.metrics import otsdb

    m = spark.createDataFrame([("m", {"k": "web-1"}, 5, 1.0), ("m", {"k": "web-2"}, 5, 3.0), ("m", {"k": "db"}, 5, 9.0), ("m", None, 5, 7.0)], M)
    with pytest.raises(QueryError):
        otsdb.query(m, "sum:rate:m", 0, 10)
    total = lambda t: sorted(r.value for r in otsdb.query(m, t, 0, 10).collect())
    assert total("sum:m{k=web*}") == [1.0, 3.0] and total("sum:m{k=*}") == [1.0, 3.0, 9.0] and total("sum:m{k=*b|web-2}") == [3.0, 9.0] and total("sum:m") == [20.0]


def test_subtree_and_search(spark):
    s = "trace_id string, span_id string, parent_span_id string, service string, name string, status string, start_time bigint, end_time bigint, duration bigint"
    rows = [("t", "1", "", "web", "get", "OK", 0, 90_000, 90_000), ("t", "2", "1", "web", "in", "OK", 10_000, 50_000, 40_000), ("t", "3", "2", "db", "q", "OK", 20_000, 40_000, 20_000), ("u", "9", None, "db", "x", "OK", 70_000, 80_000, 10_000)]
    df = spark.createDataFrame(rows, s)
    sub = spans.subtree(df, "t", "2").first()
    tree = json.loads(sub.tree)
    assert (sub.spans, sub.depth, tree["span_id"], [c["span_id"] for c in tree["children"]]) == (2, 2, "2", ["3"])
    assert json.loads(spans.subtree(df, "t", "nosuch").first().tree) is None and spans.subtree(df, "none", "2").count() == 0
    got = spans.trace_search(df, "db", 0, 75_000).collect()
    assert [r.traceID for r in got] == ["u", "t"] and got[1].processes == {"p1": "db", "p2": "web"} and len(got[1].spans) == 3
    assert got[1].spans[2].references[0].spanID == "2" and got[1].spans[2].processID == "p1" and got[0].spans[0].references == []
    assert [r.traceID for r in spans.trace_search(df, "web").collect()] == ["t"] and spans.trace_search(df, limit=1).count() == 1


def test_expression_requests(spark):
    from tracelode.lang.lex import QueryError
    from tracelode.metrics import otsdb

    m = spark.createDataFrame([("m", {"k": "a"}, 5, 1.0), ("m", {"k": "b"}, 65, 3.0), ("m", {"k": "c"}, 400, 9.0)], M)
    body = {"time": {"start": 0, "end": "120000000000", "aggregator": "max"}, "filters": [{"id": "f", "tags": []}], "metrics": [{"id": "1", "metric": "m", "filter": "f"}], "outputs": [{"id": "1", "alias": "x"}, {"id": "2"}]}
    out = otsdb.expressions(m, body, 10)
    assert set(out) == {"x"} and sorted((r.ts, r.value) for r in out["x"].collect()) == [(0, 1.0), (60, 3.0), (360, 9.0)]
    for wrong in ({"time": {}}, {"time": {"start": 1, "aggregator": "nosuch"}}, {"time": {"start": 1, "aggregator": "sum", "downsampler": {"interval": "1m"}}}):
        with pytest.raises(QueryError):
            otsdb.expressions(m, wrong, 10)


def test_running_values_of_a_stream_and_fresh_rows(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    schema = "i int, k string, v double"
    rows = [(i, "ab"[i % 2], None if i % 5 == 4 else float((i * 7) % 11)) for i in range(30)]
    stored = spark.createDataFrame([(-1, "z", 1.0)], schema)
    for a in (0, 15):  # two micro-batches: state goes on
        spark.createDataFrame(rows[a : a + 15], schema).coalesce(1).write.mode("append").parquet(src)
        q = live.running(spark.readStream.schema(schema).parquet(src), "k", "v").writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.i: r for r in spark.read.parquet(sink).collect()}
    assert len(got) == 30
    for k in "ab":
        seen = []
        for i, _, v in [r for r in rows if r[1] == k]:
            seen += [] if v is None else [v]
            g = got[i]
            assert (g.running_count, g.running_sum, g.running_min, g.running_max) == (len(seen), sum(seen) if seen else None, min(seen, default=None), max(seen, default=None))
    assert live.with_fresh(stored, sink).count() == 31
