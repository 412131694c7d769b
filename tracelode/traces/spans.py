"""Traces: summaries, service metrics, dependencies, span trees.

Spans are rows ``trace_id, span_id, parent_span_id, service, name, start_time,
end_time, duration (ns), status``; the parent of a root is empty or NULL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.lanes import runs, whole_groups
from tracelode.session import parallelism

ERROR = "STATUS_CODE_ERROR"


def _is_root(c: str = "parent_span_id"):
    return F.coalesce(F.col(c), F.lit("")) == ""


def trace_summaries(spans: DataFrame) -> DataFrame:
    """One row a trace: bounds, spans, errors, and service and operation of its root."""
    root = F.when(_is_root(), F.struct("service", "name"))
    g = spans.groupBy("trace_id").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("span_count"), F.count_if(F.col("status") == ERROR).alias("span_errors_count"), F.min(root).alias("r"))
    return g.select("trace_id", "start_time", "end_time", "span_count", "span_errors_count", F.col("r.service").alias("service_name"), F.col("r.name").alias("operation_name"))


def trace_page(spans: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """A page of summaries, newest first."""
    return trace_summaries(spans).orderBy(F.desc("start_time"), "trace_id").offset((page - 1) * size).limit(size)


def total_traces(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count_distinct("trace_id").alias("total_traces"))


def _parents(spans: DataFrame) -> DataFrame:
    return spans.select(F.col("trace_id").alias("p_trace"), F.col("span_id").alias("p_span"), F.col("service").alias("p_service"))


def entry_spans(spans: DataFrame) -> DataFrame:
    """Spans by which a request enters a service: no parent, unseen parent, or parent in another service."""
    s = spans.where(F.col("service").isNotNull())
    j = s.join(_parents(spans), (F.col("trace_id") == F.col("p_trace")) & (F.col("parent_span_id") == F.col("p_span")), "left")
    return j.where(F.col("p_service").isNull() | (F.col("p_service") != F.col("service"))).drop("p_trace", "p_span", "p_service")


def red(spans: DataFrame, seconds: int = 60, exact: bool = False) -> DataFrame:
    """Rate, error share and latency percentiles (ms) of each service over its entry spans.

    Percentiles come from a summary of bounded size (rank error 1e-4); ``exact`` keeps all values."""
    ms = F.col("duration") / 1_000_000
    e = F.col("status") == ERROR
    at = [0.5, 0.9, 0.95, 0.99]
    ps = F.percentile(ms, at) if exact else F.percentile_approx(ms, at, 10_000)
    g = entry_spans(spans).groupBy("service").agg((F.count("*") / seconds).alias("rate"), (F.count_if(e) * 100 / F.count("*")).alias("error_rate"), ps.alias("p"))
    return g.select("service", "rate", "error_rate", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))])


def dependencies(spans: DataFrame) -> DataFrame:
    """``parent, child, callCount`` between different services."""
    j = spans.join(_parents(spans), (F.col("trace_id") == F.col("p_trace")) & (F.col("parent_span_id") == F.col("p_span")))
    j = j.where(F.col("p_service") != F.col("service"))
    return j.groupBy(F.col("p_service").alias("parent"), F.col("service").alias("child")).agg(F.count("*").alias("callCount"))


_TREE = "trace_id string, spans bigint, orphans bigint, depth int, tree string"


def _builder(root: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _build(batches, root)

    return run


def _build(batches: Iterator[pa.RecordBatch], root: str | None) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["t"], 50_000):
        key = t.column("t").to_numpy()
        rows = t.to_pylist()
        first = runs(key)
        out = []
        for a, b in zip(first, [*first[1:], len(rows)]):
            byid: dict[str, list[dict]] = {}
            for r in rows[a:b]:
                byid.setdefault(r["trace_id"], []).append(r)
            out += [_tree(k, v, root) for k, v in byid.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], ty) for i, ty in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["trace_id", "spans", "orphans", "depth", "tree"])


def _tree(trace: str, rows: list[dict], root: str | None = None) -> tuple[str, int, int, int, str]:
    """Children under parents by start time; spans whose parent is missing hang beside the root.
    With ``root`` the tree of that span alone."""
    nodes = {r["span_id"]: {"span_id": r["span_id"], "service_name": r["service"], "operation_name": r["name"], "status": r["status"], "start_time": r["start_time"], "end_time": r["end_time"], "duration": r["duration"], "children": []} for r in rows}
    zero = min((r["start_time"] for r in rows if r["start_time"] is not None), default=0)
    tops, orphans = [], 0
    for r in sorted(rows, key=lambda r: (r["start_time"] or 0, r["span_id"] or "")):
        n = nodes[r["span_id"]]
        n["actual_start_time"], n["start_time"] = n["start_time"], (n["start_time"] or zero) - zero
        n["end_time"] = (n["end_time"] or zero) - zero
        p = r["parent_span_id"] or ""
        if p and p in nodes and p != r["span_id"]:
            nodes[p]["children"].append(n)
        else:
            orphans += bool(p)
            tops.append(n)
    if root is not None:
        tops, orphans = [nodes[root]] if root in nodes else [], 0
    depth, level = 0, tops
    seen: set[str] = set()
    while level:
        depth += 1
        seen |= {n["span_id"] for n in level}
        level = [c for n in level for c in n["children"] if c["span_id"] not in seen]
    if root is not None:
        return trace, len(seen), 0, depth, json.dumps(tops[0] if tops else None)
    if len(seen) < len(nodes):  # a ring of parents hangs on nothing
        return trace, len(rows), orphans, depth, json.dumps(None)
    return trace, len(rows), orphans, depth, json.dumps(tops[0] if len(tops) == 1 else tops)


def span_trees(spans: DataFrame, root: str | None = None) -> DataFrame:
    """One nested JSON tree a trace, its times relative to the trace's start.

    A tree is one cell, so a task holds each trace whole; restrict ``spans`` to the traces wanted.
    With ``root`` (a span id) only that span and what hangs under it."""
    cols = ["trace_id", "span_id", "parent_span_id", "service", "name", "status", "start_time", "end_time", "duration"]
    s = spans.select(F.xxhash64("trace_id").alias("t"), *[F.col(c).cast("string") if c in cols[:6] else F.col(c).cast("bigint") for c in cols])
    return s.repartition(parallelism(spans.sparkSession, 1), "t").sortWithinPartitions("t").mapInArrow(_builder(root), _TREE)


def subtree(spans: DataFrame, trace_id: str, span_id: str) -> DataFrame:
    """The tree of one span of one trace."""
    return span_trees(spans.where(F.col("trace_id") == trace_id), span_id)


def trace_search(spans: DataFrame, service: str | None = None, start_ns: int | None = None, end_ns: int | None = None, limit: int = 50) -> DataFrame:
    """The newest traces with a span of the service in the range, one row each:
    ``traceID, spans[traceID, spanID, operationName, references, startTime, duration (us), processID], processes{p1: service}``."""
    hit = spans
    if service is not None:
        hit = hit.where(F.col("service") == service)
    if start_ns is not None:
        hit = hit.where(F.col("start_time") >= start_ns)
    if end_ns is not None:
        hit = hit.where(F.col("start_time") <= end_ns)
    page = hit.groupBy("trace_id").agg(F.max("start_time").alias("newest")).orderBy(F.desc("newest"), "trace_id").limit(limit)
    x = spans.join(F.broadcast(page), "trace_id")
    names = x.groupBy("trace_id").agg(F.array_sort(F.collect_set("service")).alias("names"))
    x = x.join(names, "trace_id")
    ref = F.when(_is_root(), F.array().cast("array<struct<refType:string,traceID:string,spanID:string>>")).otherwise(F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"), F.col("parent_span_id").alias("spanID"))))
    us = lambda c: F.call_function("div", F.col(c), F.lit(1000))
    process = F.concat(F.lit("p"), F.array_position("names", F.col("service")).cast("string"))
    one = F.struct(us("start_time").alias("startTime"), F.col("span_id").alias("spanID"), F.col("trace_id").alias("traceID"), F.col("name").alias("operationName"), ref.alias("references"), us("duration").alias("duration"), process.alias("processID"))
    g = x.groupBy("trace_id", "newest", "names").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    processes = F.map_from_arrays(F.transform("names", lambda n: F.concat(F.lit("p"), F.array_position("names", n).cast("string"))), F.col("names"))
    return g.orderBy(F.desc("newest"), "trace_id").select(F.col("trace_id").alias("traceID"), "spans", processes.alias("processes"))


def write_service_tables(spans: DataFrame, folder: str, start_ns: int, end_ns: int) -> None:
    """One run of the periodic jobs: service metrics and dependencies of the spans that began in [start, end),
    appended with their time to the tables ``red-traces`` and ``service-dependency`` of a folder."""
    s = spans.where((F.col("start_time") >= start_ns) & (F.col("start_time") < end_ns))
    at = F.lit(end_ns // 1_000_000).cast("bigint").alias("timestamp")
    red(s, max((end_ns - start_ns) // 1_000_000_000, 1)).select(at, "*").write.mode("append").parquet(f"{folder}/red-traces")
    dependencies(s).select(at, "*").write.mode("append").parquet(f"{folder}/service-dependency")


def services(spans: DataFrame) -> DataFrame:
    return spans.select("service").where("service is not null").distinct()


def operations(spans: DataFrame, service: str) -> DataFrame:
    return spans.where(F.col("service") == service).select("name").distinct()
