"""Readers of the ingest formats, lookups, catalog."""

import gzip
import json

from tracelode.plans.engine import Engine
from tracelode.sources import catalog, readers


def put(p, text):
    p.write_text(text)
    return str(p)


def test_readers(spark, tmp_path):
    b = readers.read_bulk(spark, put(tmp_path / "b.ndjson", "\n".join(['{"index":{"_index":"i","_id":"1"}}', '{"a":{"b":1},"t":["x","y"]}', '{"create":{"_index":"j"}}', '{"a":{"b":2},"c":true}']) + "\n")).collect()
    assert {(r._index, r._id, r["a.b"], r["t.0"], r.c) for r in b} == {("i", "1", 1, "x", None), ("j", None, 2, None, True)}
    h = readers.read_hec(spark, put(tmp_path / "h.json", '{"event":{"m":1,"n":{"o":"p"}},"host":"h","index":"main"}\n')).first()
    assert h.m == 1 and h["n.o"] == "p" and h.host == "h"
    lk = readers.read_loki_push(spark, put(tmp_path / "l.json", json.dumps({"streams": [{"stream": {"job": "j"}, "values": [["1", "a"], ["bad", "b"]]}]}))).collect()
    assert [(r.ts_nano, r.line) for r in lk] == [(1, "a"), (None, "b")]
    o = readers.read_opentsdb(spark, put(tmp_path / "o.json", '{"metric":"m","tags":{"a":"b"},"timestamp":1700000000123,"value":1.5}\n')).first()
    assert o.timestamp == 1700000000 and o.tags == {"a": "b"}
    kv = [{"key": "service.name", "value": {"stringValue": "svc"}}, {"key": "n", "value": {"intValue": "5"}}]
    lg = readers.read_otlp_logs(spark, put(tmp_path / "ol.json", json.dumps({"resourceLogs": [{"resource": {"attributes": kv}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [{"timeUnixNano": "7", "severityText": "INFO", "body": {"stringValue": "hi"}, "attributes": kv}]}]}]}))).first()
    assert lg.body == "hi" and lg.time_unix_nano == 7 and lg.resource["service.name"] == "svc" and lg.attributes["n"] == "5"
    pts = [{"timeUnixNano": "5000000000", "asDouble": 2.5, "attributes": kv}, {"timeUnixNano": "6000000000", "asInt": "4"}]
    mt = readers.read_otlp_metrics(spark, put(tmp_path / "om.json", json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "g", "gauge": {"dataPoints": pts}}, {"name": "h", "histogram": {"dataPoints": [{"timeUnixNano": "1", "count": "3", "sum": 9.0}]}}]}]}]}))).collect()
    assert sorted((r.metric, r.timestamp, r.value) for r in mt) == [("g", 5, 2.5), ("g", 6, 4.0), ("h", 0, 9.0)]
    tr = readers.read_otlp_traces(spark, put(tmp_path / "ot.json", json.dumps({"resourceSpans": [{"resource": {"attributes": kv}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "1", "endTimeUnixNano": "4"}]}]}]}))).first()
    assert tr.service == "svc" and tr.duration == 3 and tr.parent_span_id == ""
    p = tmp_path / "l.csv.gz"
    p.write_bytes(gzip.compress(b"k,v,w\n1,2.5,x\n2,,3\n"))
    lu = readers.read_lookup(spark, str(p))
    assert dict(lu.dtypes) == {"k": "double", "v": "double", "w": "string"}
    e = Engine(spark)
    assert [tuple(r) for r in e.search(f"| inputlookup start=1 max=1 {p}").collect()] == [(2.0, None, "3")]


def test_catalog(spark, tmp_path):
    e = Engine(spark)
    for n in ("app-1", "app-2", "web"):
        e.register(n, spark.createDataFrame([(1, n)], "timestamp bigint, x string" if n != "web" else "timestamp bigint, y string"), "timestamp")
    e.catalog.alias("all", "app-1", "web")
    assert e.search("*", "app-*").count() == 2 and e.search("_index=all | fields x y").count() == 2 and e.search("*", "app-1,web").columns == ["timestamp", "x", "y"]
    e.catalog.drop("web")
    assert [n for n, _ in e.catalog.indices()] == ["app-1", "app-2"]
    m = spark.createDataFrame([("m.a", {"k": "v", "e": ""}), ("m_a", {"k": "v"}), ("m_a", None)], "metric string, tags map<string,string>")
    assert catalog.cardinality(m).first().series == 2 and catalog.tag_keys_with_most_series(m).first().key == "k"
    readers.write_events(spark.createDataFrame([(1700000000000, "x")], "timestamp bigint, s string"), str(tmp_path / "ev"), bloom=("s",))
    assert spark.read.parquet(str(tmp_path / "ev")).first().s == "x"


def test_arrays_are_kept_whole(spark, tmp_path):
    rows = [{"t": list(range(40)), "s": ["a", "b"], "o": [{"x": 1, "y": [1, 2, 3]}]}, {"t": [1], "s": None, "o": []}]
    d = readers.read_events_json(spark, put(tmp_path / "a.json", "\n".join(map(json.dumps, rows))))
    got = d.collect()
    assert [len(r.t) for r in got] == [40, 1] and got[0]["s.1"] == "b" and got[0]["o.0.x"] == 1 and got[0]["o.0.y"] == [1, 2, 3]


def test_bulk_over_split_edges(spark, tmp_path):
    lines, want = [], []
    for i in range(3000):
        lines.append(json.dumps({["index", "create"][i % 2]: {"_index": f"i{i % 3}", "_id": str(i)}}))
        doc = {"index": {"n": i}} if i % 7 == 3 else {"v": i, "pad": "x" * (i % 50)}  # some documents look like actions
        lines.append(json.dumps(doc))
        want.append((str(i), doc))
        if i % 11 == 5:
            lines += ["", json.dumps({"delete": {"_id": str(i)}})]
    path = put(tmp_path / "b.ndjson", "\n".join(lines))
    assert {(json.loads(r.action).popitem()[1]["_id"], r.doc) for r in readers.bulk_pairs(spark, path).collect()} == {(k, json.dumps(d)) for k, d in want}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    plain = []  # splits may begin anywhere
    for k, d in want:
        if "v" in d:
            plain += [json.dumps({"index": {"_index": "i", "_id": k}}), json.dumps(d), *([json.dumps({"delete": {"_id": k}}), ""] if d["v"] % 11 == 5 else [])]
    path = put(tmp_path / "c.ndjson", "\n".join(plain))
    n = sum("_index" in x for x in plain)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        b = readers.read_bulk(spark, path)
        assert b.count() == n and b.where("cast(_id as int) <> v").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert readers.read_bulk(spark, put(tmp_path / "e.ndjson", "\n")).count() == 0
    assert readers.read_bulk(spark, path, "v int").columns == ["_index", "_id", "v"]


def test_catalog_spelling(spark):
    m = spark.createDataFrame([("m.a", {"k": "v", "e": ""}), ("m_a", {"client": " X "}), ("m_a", {"client": "x"}), (None, None)], "metric string, tags map<string,string>")
    assert sorted(r.metric or "" for r in catalog.metric_names(m).collect()) == ["", "m_a"]
    assert sorted(r.key for r in catalog.tag_keys(m).collect()) == ["client", "k"] and [r.value for r in catalog.tag_values(m, "client").collect()] == ["x"]
    assert catalog.tag_keys_with_most_values(m).first() == ("client", 1)


def test_single_documents(spark):
    e = Engine(spark)
    e.register("d", spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")], "_id string, v string"))
    e.catalog.put("d", spark.createDataFrame([("2", "B", 7), ("3", "n", 8)], "_id string, v string, w int"), "_id")
    e.catalog.delete("d", "_id", "1")
    assert sorted((r._id or "", r.v, r.w) for r in e.search("*", "d").collect()) == [("", "c", None), ("2", "B", 7), ("3", "n", 8)]


def test_clean_names_equal_the_rule(spark):
    from pyspark.sql import functions as F

    from tracelode.functions import series

    names = [("a.b",), ("ä🎉x",), ("ok_1",), ("",), (None,), ("  ",), (" \tA b\n\x0b\f\r",), ("x ",), ("A-B-c",)]
    d = spark.createDataFrame(names, "m string")
    for ours, rule in ((series.metric_name(F.col("m")), F.regexp_replace("m", "[^A-Za-z0-9_]", "_")), (series.client_id(F.col("m")), F.nullif(F.lower(F.regexp_replace("m", r"^\s+|\s+$", "")), F.lit("")))):
        assert d.where(~ours.eqNullSafe(rule)).count() == 0
