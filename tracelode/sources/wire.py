"""Protobuf forms of ingest requests as the dictionaries of their JSON forms.

A message is described by its fields: number -> (name, kind).  Kinds are scalar
types, nested descriptions, or one of them in a list for repeated fields.
Fields that a description does not name are skipped."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[i]
        n |= (c & 0x7F) << shift
        i += 1
        if c < 0x80:
            return n, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int, Any]]:
    """(field number, wire type, raw value) of a message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            v, i = _varint(b, i)
        elif wire == 1:
            v, i = b[i : i + 8], i + 8
        elif wire == 5:
            v, i = b[i : i + 4], i + 4
        elif wire == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            raise ValueError(f"wire type {wire}")
        yield number, wire, v


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


_SCALARS = {
    "text": lambda v: v.decode("utf-8", "replace"), "hex": lambda v: v.hex(), "bool": bool, "int": _signed, "long": lambda v: str(_signed(v)), "float": lambda v: struct.unpack("<d", v)[0],
    "fixed64": lambda v: str(struct.unpack("<Q", v)[0]), "sfixed64": lambda v: str(struct.unpack("<q", v)[0]), "fixed32": lambda v: struct.unpack("<I", v)[0],
}
Kind = Any


def message(b: bytes, kinds: dict[int, tuple[str, Kind]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for number, _, v in fields(b):
        if number not in kinds:
            continue
        name, kind = kinds[number]
        many = isinstance(kind, list)
        one = kind[0] if many else kind
        x = one[v] if isinstance(one, tuple) else message(v, one) if isinstance(one, dict) else _SCALARS[one](v)
        if many:
            out.setdefault(name, []).append(x)
        else:
            out[name] = x
    return out


# Field numbers of the public OpenTelemetry protocol.
_VALUE: dict[int, tuple[str, Kind]] = {1: ("stringValue", "text"), 2: ("boolValue", "bool"), 3: ("intValue", "long"), 4: ("doubleValue", "float")}
_PAIR = {1: ("key", "text"), 2: ("value", _VALUE)}
_RESOURCE = {1: ("attributes", [_PAIR])}
_SCOPE = {1: ("name", "text"), 2: ("version", "text")}
_LOG = {1: ("timeUnixNano", "fixed64"), 2: ("severityNumber", "int"), 3: ("severityText", "text"), 5: ("body", _VALUE), 6: ("attributes", [_PAIR]), 7: ("droppedAttributesCount", "int"), 8: ("flags", "fixed32"), 9: ("traceId", "hex"), 10: ("spanId", "hex"), 11: ("observedTimeUnixNano", "fixed64")}
_LOGS = {1: ("resourceLogs", [{1: ("resource", _RESOURCE), 2: ("scopeLogs", [{1: ("scope", _SCOPE), 2: ("logRecords", [_LOG])}])}])}
_NUMBER = {3: ("timeUnixNano", "fixed64"), 4: ("asDouble", "float"), 6: ("asInt", "sfixed64"), 7: ("attributes", [_PAIR])}
_HISTOGRAM = {3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "float"), 9: ("attributes", [_PAIR])}
_EXPONENTIAL = {1: ("attributes", [_PAIR]), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "float")}
_SUMMARY = {3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "float"), 7: ("attributes", [_PAIR])}
_POINTS = lambda kind: {1: ("dataPoints", [kind])}
_METRIC = {1: ("name", "text"), 5: ("gauge", _POINTS(_NUMBER)), 7: ("sum", _POINTS(_NUMBER)), 9: ("histogram", _POINTS(_HISTOGRAM)), 10: ("exponentialHistogram", _POINTS(_EXPONENTIAL)), 11: ("summary", _POINTS(_SUMMARY))}
_METRICS = {1: ("resourceMetrics", [{2: ("scopeMetrics", [{2: ("metrics", [_METRIC])}])}])}
_KINDS = ("SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER")
_CODES = ("STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR")
_EVENT = {1: ("timeUnixNano", "fixed64"), 2: ("name", "text")}
_LINK = {1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "text")}
_SPAN = {
    1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "text"), 4: ("parentSpanId", "hex"), 5: ("name", "text"), 6: ("kind", _KINDS), 7: ("startTimeUnixNano", "fixed64"), 8: ("endTimeUnixNano", "fixed64"), 9: ("attributes", [_PAIR]),
    10: ("droppedAttributesCount", "int"), 11: ("events", [_EVENT]), 12: ("droppedEventsCount", "int"), 13: ("links", [_LINK]), 14: ("droppedLinksCount", "int"), 15: ("status", {2: ("message", "text"), 3: ("code", _CODES)}),
}
_TRACES = {1: ("resourceSpans", [{1: ("resource", _RESOURCE), 2: ("scopeSpans", [{1: ("scope", _SCOPE), 2: ("spans", [_SPAN])}])}])}


def otlp_logs(b: bytes) -> dict:
    return message(b, _LOGS)


def otlp_metrics(b: bytes) -> dict:
    return message(b, _METRICS)


def otlp_traces(b: bytes) -> dict:
    return message(b, _TRACES)


def snappy(b: bytes) -> bytes:
    """The contents of a snappy block, which begins with its size."""
    n, _ = _varint(b, 0)
    return pa.Codec("snappy").decompress(b, decompressed_size=n, asbytes=True) if n else b""


# Field numbers of the public push and remote-write messages.
_STAMP = {1: ("seconds", "int"), 2: ("nanos", "int")}
_PUSH = {1: ("streams", [{1: ("labels", "text"), 2: ("entries", [{1: ("at", _STAMP), 2: ("line", "text")}])}])}
_WRITE = {1: ("series", [{1: ("labels", [{1: ("name", "text"), 2: ("value", "text")}]), 2: ("samples", [{1: ("v", "float"), 2: ("t", "int")}])}])}


def label_set(text: str) -> dict[str, str]:
    """``{a="b", c="d"}`` with the escapes of JSON texts."""
    import json
    import re

    return {m[1]: json.loads(m[2], strict=False) for m in re.finditer(r'(\w+)\s*=\s*("(?:[^"\\]|\\.)*")', text)}


def loki_push(b: bytes) -> dict:
    at = lambda e: str(e.get("at", {}).get("seconds", 0) * 1_000_000_000 + e.get("at", {}).get("nanos", 0))
    return {"streams": [{"stream": label_set(s.get("labels", "")), "values": [[at(e), e.get("line", "")] for e in s.get("entries", [])]} for s in message(snappy(b), _PUSH).get("streams", [])]}


def remote_write(b: bytes) -> dict:
    labels = lambda s: {x.get("name", ""): x.get("value", "") for x in s.get("labels", [])}
    return {"series": [{"labels": labels(s), "samples": [{"t": p.get("t", 0), "v": repr(p.get("v", 0.0))} for p in s.get("samples", [])]} for s in message(snappy(b), _WRITE).get("series", [])]}
