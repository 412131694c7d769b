"""Protobuf forms of ingest: encoded here field by field, read as their JSON forms are."""

import math
import struct

import pyarrow as pa

from tracelode.sources import readers, wire


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n >= 0x80:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def f(number, value, kind="len"):
    """One field: ``len`` bytes, ``var`` integers, ``d`` doubles, ``q`` 64 fixed bits."""
    wiretype = {"len": 2, "var": 0, "d": 1, "q": 1, "i": 5}[kind]
    if kind == "len":
        value = value.encode() if isinstance(value, str) else value
        body = varint(len(value)) + value
    else:
        body = varint(value) if kind == "var" else struct.pack({"d": "<d", "q": "<Q", "i": "<I"}[kind], value)
    return varint(number << 3 | wiretype) + body


def kv(k, v):
    value = f(1, v) if isinstance(v, str) else f(2, int(v), "var") if isinstance(v, bool) else f(3, v, "var") if isinstance(v, int) else f(4, v, "d")
    return f(1, k) + f(2, value)


def put(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def snap(data):
    return pa.Codec("snappy").compress(data, asbytes=True)


def test_otlp(spark, tmp_path):
    res = f(1, kv("service.name", "svc")) + f(99, "unknown") + f(98, 7, "var") + f(97, 1, "i")
    log = f(1, 7, "q") + f(2, 9, "var") + f(3, "INFO") + f(5, f(1, "hi é")) + f(6, kv("n", -5)) + f(6, kv("b", True)) + f(6, kv("d", 1.5)) + f(9, bytes(range(16)))
    d = readers.read_otlp_logs(spark, put(tmp_path, "l.pb", f(1, f(1, res) + f(2, f(1, f(1, "scope")) + f(2, log)))), protobuf=True).first()
    assert (d.body, d.time_unix_nano, d.severity_number, d.resource, d.scope, d.trace_id) == ("hi é", 7, 9, {"service.name": "svc"}, "scope", bytes(range(16)).hex())
    assert d.attributes == {"n": "-5", "b": "true", "d": "1.5"}
    num = f(3, 5 * 10**9, "q") + f(4, 2.5, "d") + f(7, kv("k", "v"))
    whole = f(3, 6 * 10**9, "q") + f(6, (1 << 64) - 4, "q")
    hist = f(3, 8 * 10**9, "q") + f(4, 3, "q") + f(5, 9.0, "d")
    ms = f(2, f(1, "g") + f(5, f(1, num) + f(1, whole))) + f(2, f(1, "h") + f(9, f(1, hist))) + f(2, f(1, "e") + f(10, f(1, hist))) + f(2, f(1, "s") + f(11, f(1, hist)))
    m = readers.read_otlp_metrics(spark, put(tmp_path, "m.pb", f(1, f(2, ms))), protobuf=True).collect()
    assert sorted((r.metric, r.timestamp, r.value) for r in m) == [("e", 8, 9.0), ("g", 5, 2.5), ("g", 6, -4.0), ("h", 8, 9.0), ("s", 8, 9.0)]
    span = f(1, b"\x01" * 16) + f(2, b"\x02" * 8) + f(5, "op") + f(6, 2, "var") + f(7, 10, "q") + f(8, 14, "q") + f(15, f(3, 2, "var")) + f(11, f(2, "ev"))
    t = readers.read_otlp_traces(spark, put(tmp_path, "t.pb", f(1, f(1, res) + f(2, f(2, span)))), protobuf=True).first()
    assert (t.trace_id, t.parent_span_id, t.service, t.name, t.kind, t.duration, t.status) == ("01" * 16, "", "svc", "op", "SPAN_KIND_SERVER", 4, "STATUS_CODE_ERROR")
    assert "ev" in t.events and wire.otlp_logs(b"") == {}


def test_push_and_remote_write(spark, tmp_path):
    entry = f(1, f(1, 1_700_000_000, "var") + f(2, 123, "var")) + f(2, 'line "x"')
    body = f(1, f(1, '{job="a b", host="h\\"1"}') + f(2, entry) + f(2, f(2, "no time")))
    r = readers.read_loki_push(spark, put(tmp_path, "p.pb", snap(body)), protobuf=True).collect()
    assert [(x.stream, x.ts_nano, x.line) for x in r] == [({"job": "a b", "host": 'h"1'}, 1_700_000_000_000_000_123, 'line "x"'), ({"job": "a b", "host": 'h"1'}, 0, "no time")]
    series = f(1, f(1, "__name__") + f(2, "up")) + f(1, f(1, "k") + f(2, "v")) + f(2, f(1, 1.25, "d") + f(2, 1_700_000_000_500, "var")) + f(2, f(1, math.nan, "d") + f(2, -5, "var"))
    w = readers.read_remote_write(spark, put(tmp_path, "w.pb", snap(f(1, series)))).collect()
    assert [(x.metric, x.tags, x.timestamp) for x in w] == [("up", {"k": "v"}, 1_700_000_000), ("up", {"k": "v"}, 0)] and w[0].value == 1.25 and math.isnan(w[1].value)
    assert readers.read_remote_write(spark, put(tmp_path, "e.pb", snap(b""))).count() == 0
