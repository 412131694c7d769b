"""Readers of the ingest formats, each to a flat or typed DataFrame."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.functions.typing import q
from tracelode.session import cut
from tracelode.sources import wire


def flatten(df: DataFrame, arrays: bool = True, most: int = 32) -> DataFrame:
    """Nested structs to dotted columns; arrays to one column an index up to the longest one.

    An array column with more than ``most`` elements in some row, and an array inside of an
    array's elements, stays whole as a multivalue column of its name."""
    cols: list[Column] = []

    def walk(c: Column, t: T.DataType, name: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(c[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)
        elif isinstance(t, T.ArrayType) and sizes.get(name, most + 1) <= most and isinstance(t.elementType, (T.StructType, T.StringType, T.LongType, T.DoubleType, T.BooleanType)):
            for i in range(sizes[name]):
                walk(F.get(c, F.lit(i)), t.elementType, f"{name}.{i}")
        else:
            cols.append(c.alias(name))

    found: list[tuple[str, Column]] = []

    def find(c: Column, t: T.DataType, name: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                find(c[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)
        elif isinstance(t, T.ArrayType):
            found.append((name, c))

    for f in df.schema.fields:
        find(q(f.name), f.dataType, f.name)
    sizes: dict[str, int] = {}
    if found and arrays:
        row = df.agg(*[F.max(F.size(c)).alias(str(i)) for i, (_, c) in enumerate(found)]).first()
        sizes = {n: max(row[str(i)] or 0, 0) for i, (n, _) in enumerate(found)}
    for f in df.schema.fields:
        walk(q(f.name), f.dataType, f.name)
    return df.select(*cols)


def consolidate(df: DataFrame) -> DataFrame:
    """Text columns whose values all read as numbers become numbers (one pass over the data)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    bad = df.agg(*[F.count(F.when(q(c).isNotNull() & F.trim(q(c)).try_cast("double").isNull(), 1)).alias(f"b{i}") for i, c in enumerate(texts)], *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(texts)]).first()
    nums = {c for i, c in enumerate(texts) if bad[f"b{i}"] == 0 and bad[f"n{i}"] > 0}
    return df.select(*[(F.trim(q(c)).try_cast("double").alias(c) if c in nums else q(c)) for c in df.columns])


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, flattened."""
    return flatten(spark.read.json(path))


_ACTION = re.compile(r'\s*\{\s*"(index|create|update|delete)"\s*:\s*(\{.*\}|null)\s*\}\s*$', re.S)
_PAIRED = "file string, block bigint, kind string, action string, doc string"


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of file splits, in order within each, to pairs.  What a split cannot pair by itself goes
    out as ``head`` (a document whose action ends the split before) or ``tail`` (an action at its end)."""
    at, held, fresh = None, None, True
    for b in batches:
        out: list[tuple] = []
        for file, block, line in zip(*(c.to_pylist() for c in b.columns)):
            if (file, block) != at:
                if held is not None:
                    out.append((*at, "tail", held, None))  # type: ignore[misc]
                at, held, fresh = (file, block), None, True
            if not line.strip():
                continue
            if held is not None:
                out.append((*at, "pair", held, line))
                held = None
            elif m := _ACTION.match(line):
                if m[1] != "delete":  # a deletion has no document
                    held = line
                if fresh:
                    out.append((*at, "head", None, None))
            elif fresh:
                out.append((*at, "head", None, line))
            fresh = False
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["file", "block", "kind", "action", "doc"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, "tail", held, None), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["file", "block", "kind", "action", "doc"])  # type: ignore[misc]


def bulk_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``action, doc`` of bulk NDJSON.  Files are read in splits and paired within each; only what
    stands at the edges of splits (two rows a split at most) is shuffled.

    Lines alternate, so a document may look like an action; only at the very start of a split of a
    file is a line taken for what it looks like.  Blank lines and deletions have no document."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    p = cut(lines.mapInArrow(_pair, _PAIRED), "bulk")
    edges = p.where("kind <> 'pair'").groupBy("file", "block").agg(F.max(F.when(F.col("kind") == "tail", F.col("action"))).alias("action"), F.max(F.when(F.col("kind") == "head", F.col("doc"))).alias("doc"))
    w = Window.partitionBy("file").orderBy("block")  # one row a split
    edges = edges.select("action", F.lead("doc").over(w).alias("doc")).where("action is not null and doc is not null")
    return p.where("kind = 'pair'").select("action", "doc").unionByName(edges)


def read_bulk(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Bulk NDJSON: an action line, then its document; gives ``_index, _id`` and the document's fields.

    Without a ``schema`` of the documents it is inferred in one pass, in the JVM, as for any JSON source."""
    p = bulk_pairs(spark, path)
    if schema is None:
        docs = cut(p, "bulkdocs") if not p.isEmpty() else p
        strings = getattr(docs.select("doc")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        schema = DataFrame(spark._jsparkSession.read().json(strings), spark).schema
        p = docs
    meta = [F.coalesce(*[F.get_json_object("action", f"$.{k}.{f}") for k in ("index", "create", "update")]).alias(f) for f in ("_index", "_id")]
    d = p.select(*meta, F.from_json("doc", schema).alias("d"))
    return flatten(d.select("_index", "_id", "d.*") if (schema.fields if isinstance(schema, T.StructType) else True) else d.select("_index", "_id"))


def read_hec(spark: SparkSession, path: str) -> DataFrame:
    """Event collector envelopes: fields of the event beside host, source, sourcetype, index, time."""
    df = spark.read.json(path)
    meta = [c for c in ("time", "host", "source", "sourcetype", "index") if c in df.columns]
    t = dict(df.dtypes).get("event", "string")
    body = ["event.*"] if t.startswith("struct") else [F.col("event")]
    return flatten(df.select(*meta, *body))


_LOKI = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"


def _requests(spark: SparkSession, path: str, schema: str, decode: Callable[[bytes], dict] | None = None) -> DataFrame:
    """Ingest requests: JSON, one a line; or with ``decode`` one protobuf message a file, which Python turns
    into the same JSON and the JVM then reads by the same schema."""
    if decode is None:
        return spark.read.schema(schema).json(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(decode(c)) for c in b.column(0).to_pylist()], pa.string())], names=["j"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def read_loki_push(spark: SparkSession, path: str, protobuf: bool = False) -> DataFrame:
    """Log push requests, JSON or snappy protobuf: labels with one row a (ts, line)."""
    df = _requests(spark, path, _LOKI, wire.loki_push if protobuf else None)
    s = df.select(F.explode("streams").alias("s")).select("s.stream", F.explode("s.values").alias("v"))
    return s.select("stream", F.get("v", F.lit(0)).try_cast("bigint").alias("ts_nano"), F.get("v", F.lit(1)).alias("line"))


def read_remote_write(spark: SparkSession, path: str) -> DataFrame:
    """Remote write requests (snappy protobuf, one a file): ``metric, tags, timestamp (s), value``."""
    df = _requests(spark, path, "series array<struct<labels:map<string,string>,samples:array<struct<t:bigint,v:string>>>>", wire.remote_write)
    s = df.select(F.explode("series").alias("s")).select("s.labels", F.explode("s.samples").alias("p"))
    tags = F.map_filter("labels", lambda k, v: k != "__name__")
    return s.select(F.col("labels")["__name__"].alias("metric"), tags.alias("tags"), F.call_function("div", F.col("p.t"), F.lit(1000)).alias("timestamp"), F.col("p.v").try_cast("double").alias("value"))


_ANY = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_KV = f"array<struct<key:string,value:{_ANY}>>"


def _attributes(c: Column) -> Column:
    one = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(_KV)), lambda e: F.struct(e["key"], one(e["value"]))))


def read_otlp_logs(spark: SparkSession, path: str, protobuf: bool = False) -> DataFrame:
    """One row a log record."""
    rec = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_ANY},attributes:{_KV},traceId:string,spanId:string,flags:int,droppedAttributesCount:bigint>"
    df = _requests(spark, path, f"resourceLogs array<struct<resource:struct<attributes:{_KV}>,scopeLogs:array<struct<scope:struct<name:string,version:string>,logRecords:array<{rec}>>>>>", wire.otlp_logs if protobuf else None)
    r = df.select(F.explode("resourceLogs").alias("r")).select(F.col("r.resource").alias("resource"), F.explode("r.scopeLogs").alias("s")).select("resource", F.col("s.scope").alias("scope"), F.explode("s.logRecords").alias("l"))
    b = F.col("l.body")
    return r.select(
        _attributes(F.col("resource.attributes")).alias("resource"), F.col("scope.name").alias("scope"), F.col("l.timeUnixNano").try_cast("bigint").alias("time_unix_nano"),
        F.col("l.observedTimeUnixNano").try_cast("bigint").alias("observed_time_unix_nano"), F.col("l.severityNumber").alias("severity_number"), F.col("l.severityText").alias("severity_text"),
        F.coalesce(b["stringValue"], b["intValue"], b["doubleValue"].cast("string"), b["boolValue"].cast("string")).alias("body"), _attributes(F.col("l.attributes")).alias("attributes"),
        F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), F.col("l.flags").alias("flags"), F.col("l.droppedAttributesCount").alias("dropped_attributes_count"),
    )


def read_otlp_metrics(spark: SparkSession, path: str, protobuf: bool = False) -> DataFrame:
    """``metric, tags, timestamp, value``: every kind of point collapses to one number."""
    num = f"struct<timeUnixNano:string,asInt:string,asDouble:double,attributes:{_KV}>"
    agg = f"struct<timeUnixNano:string,count:string,sum:double,attributes:{_KV}>"
    m = f"struct<name:string,gauge:struct<dataPoints:array<{num}>>,sum:struct<dataPoints:array<{num}>>,histogram:struct<dataPoints:array<{agg}>>,exponentialHistogram:struct<dataPoints:array<{agg}>>,summary:struct<dataPoints:array<{agg}>>>"
    df = _requests(spark, path, f"resourceMetrics array<struct<scopeMetrics:array<struct<metrics:array<{m}>>>>>", wire.otlp_metrics if protobuf else None)
    x = df.select(F.explode("resourceMetrics").alias("r")).select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m"))
    point = lambda p, v: F.struct(p["timeUnixNano"].alias("t"), v.alias("v"), p["attributes"].alias("a"))
    none = F.array().cast(f"array<struct<t:string,v:double,a:{_KV}>>")
    parts = [F.coalesce(F.transform(F.col(f"m.{k}.dataPoints"), lambda p: point(p, F.coalesce(p["asDouble"], p["asInt"].try_cast("double")))), none) for k in ("gauge", "sum")]
    parts += [F.coalesce(F.transform(F.col(f"m.{k}.dataPoints"), lambda p: point(p, p["sum"])), none) for k in ("histogram", "exponentialHistogram", "summary")]
    p = x.select(F.col("m.name").alias("metric"), F.explode(F.concat(*parts)).alias("p"))
    return p.select("metric", _attributes(F.col("p.a")).alias("tags"), F.call_function("div", F.col("p.t").try_cast("bigint"), F.lit(1_000_000_000)).alias("timestamp"), F.col("p.v").alias("value"))


def read_otlp_traces(spark: SparkSession, path: str, protobuf: bool = False) -> DataFrame:
    """One row a span."""
    span = f"struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},droppedAttributesCount:bigint,droppedEventsCount:bigint,droppedLinksCount:bigint,events:array<map<string,string>>,links:array<map<string,string>>,status:struct<code:string,message:string>>"
    df = _requests(spark, path, f"resourceSpans array<struct<resource:struct<attributes:{_KV}>,scopeSpans:array<struct<spans:array<{span}>>>>>", wire.otlp_traces if protobuf else None)
    x = df.select(F.explode("resourceSpans").alias("r")).select(_attributes(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeSpans").alias("s")).select("res", F.explode("s.spans").alias("p"))
    start, end = F.col("p.startTimeUnixNano").try_cast("bigint"), F.col("p.endTimeUnixNano").try_cast("bigint")
    return x.select(
        F.col("p.traceId").alias("trace_id"), F.col("p.spanId").alias("span_id"), F.coalesce("p.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("res")["service.name"].alias("service"), F.col("p.name").alias("name"),
        F.col("p.kind").alias("kind"), start.alias("start_time"), end.alias("end_time"), (end - start).alias("duration"), F.coalesce("p.status.code", F.lit("STATUS_CODE_UNSET")).alias("status"), F.col("p.traceState").alias("trace_state"),
        F.col("p.droppedAttributesCount").alias("dropped_attributes_count"), F.col("p.droppedEventsCount").alias("dropped_events_count"), F.col("p.droppedLinksCount").alias("dropped_links_count"),
        F.to_json("p.events").alias("events"), F.to_json("p.links").alias("links"), _attributes(F.col("p.attributes")).alias("attributes"),
    )


def read_opentsdb(spark: SparkSession, path: str) -> DataFrame:
    """Put requests: ``metric, tags, timestamp (s), value``; millisecond stamps are cut to seconds."""
    df = spark.read.schema("metric string, tags map<string,string>, timestamp bigint, value double").json(path)
    t = F.col("timestamp")
    return df.withColumn("timestamp", F.when(t > 99_999_999_999, F.call_function("div", t, F.lit(1000))).otherwise(t))


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A csv or csv.gz lookup file; columns that are numbers throughout are numbers."""
    return consolidate(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def write_events(df: DataFrame, path: str, time: str = "timestamp", bloom: tuple[str, ...] = ()) -> None:
    """Events as Parquet by day, sorted by time within files so that row group statistics prune."""
    t = dict(df.dtypes)[time]
    day = F.to_date(q(time)) if t.startswith("timestamp") else F.to_date(F.timestamp_millis(q(time)))
    w = df.withColumn("dt", day).repartition("dt").sortWithinPartitions("dt", time).write.partitionBy("dt").option("compression", "zstd")
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)
