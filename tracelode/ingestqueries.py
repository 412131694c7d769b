"""Round trips of the ingest formats: tables are written as requests into the shared folder and read back.

The SQL of a query states what must come back, over the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.corequeries import _sp, rounded, spans_of
from tracelode.session import shared_path, table
from tracelode.sources import readers

Query = Callable[[SparkSession, str], DataFrame]


def _written(spark: SparkSession, name: str, lines: DataFrame) -> str:
    """The one text column of ``lines`` as files in the shared folder."""
    path = shared_path(spark, name)
    lines.write.text(path)
    return path


def _json(**cols: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in cols.items()]))


def _document() -> Column:
    props = F.from_json("props", "k int")
    return _json(event_id=F.col("event_id"), kind=F.struct(F.col("event_type").alias("name"), F.col("user_id").alias("user")), value=F.col("value"), marks=F.array("event_type", F.col("user_id").cast("string")), k=props["k"])


def ingest_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk requests: every event as an action line and a document."""
    e = table(spark, sf_dir, "events")
    action = _json(index=F.struct(F.concat(F.lit("logs-"), "event_type").alias("_index"), F.col("event_id").cast("string").alias("_id")))
    path = _written(spark, "bulk", e.select(F.concat(action, F.lit("\n"), _document())))
    b = readers.read_bulk(spark, path)
    return rounded(b.groupBy("_index").agg(F.count("*").alias("n"), F.count_if(F.col("_id").cast("bigint") == F.col("event_id")).alias("paired"), F.sum("value").alias("total"), F.sum("`kind.user`").alias("users"), F.count_if(F.col("`marks.0`") == F.col("`kind.name`")).alias("marked")))


def ingest_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain JSON lines, flattened."""
    path = _written(spark, "events", table(spark, sf_dir, "events").select(_document()))
    d = readers.read_events_json(spark, path)
    return rounded(d.groupBy(F.col("`kind.name`").alias("event_type")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum("k").alias("k"), F.count("`marks.1`").alias("marks")))


def ingest_hec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event collector envelopes."""
    e = table(spark, sf_dir, "events")
    event = F.struct("event_type", "value", F.struct(F.col("user_id").alias("id")).alias("user"))
    path = _written(spark, "hec", e.select(_json(time=F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, host=F.concat(F.lit("h"), F.col("user_id") % 3), index=F.lit("main"), event=event)))
    h = readers.read_hec(spark, path)
    return rounded(h.groupBy("host", "index").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("`user.id`").alias("most"), F.count_distinct("event_type").alias("types")))


def ingest_loki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log pushes."""
    s = table(spark, sf_dir, "loki_streams")
    values = F.transform("values", lambda v: F.array(v["ts"], v["line"]))
    path = _written(spark, "loki", s.select(_json(streams=F.array(F.struct("stream", values.alias("values"))))))
    p = readers.read_loki_push(spark, path)
    return p.groupBy(F.col("stream")["job"].alias("job")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.min("ts_nano").alias("first"), F.max("ts_nano").alias("last"))


def _attributes(c: Column) -> Column:
    return F.transform(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


def ingest_otlp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric requests of integer points."""
    o = table(spark, sf_dir, "otlp_points").where("time_unix_nano is not null")
    point = F.struct(F.col("time_unix_nano").cast("string").alias("timeUnixNano"), F.col("value").cast("string").alias("asInt"), _attributes(F.col("attributes")).alias("attributes"))
    one = F.struct(F.col("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    path = _written(spark, "otlpm", o.select(_json(resourceMetrics=F.array(F.struct(F.array(F.struct(F.array(one).alias("metrics"))).alias("scopeMetrics"))))))
    m = readers.read_otlp_metrics(spark, path)
    return rounded(m.groupBy("metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.size("tags")).cast("bigint").alias("tags"), F.max("timestamp").alias("last")))


def ingest_otlp_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log requests made of posts."""
    d = table(spark, sf_dir, "documents")
    record = F.struct((F.col("doc_id") * 1_000_000_000).cast("string").alias("timeUnixNano"), F.lit(9).alias("severityNumber"), F.struct(F.col("text").alias("stringValue")).alias("body"), _attributes(F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), lambda k, v: v.isNotNull())).alias("attributes"))
    path = _written(spark, "otlpl", d.select(_json(resourceLogs=F.array(F.struct(F.struct(_attributes(F.create_map(F.lit("service.name"), F.lit("forum"))).alias("attributes")).alias("resource"), F.array(F.struct(F.struct(F.lit("posts").alias("name")).alias("scope"), F.array(record).alias("logRecords"))).alias("scopeLogs"))))))
    r = readers.read_otlp_logs(spark, path)
    return r.groupBy(F.col("resource")["service.name"].alias("service"), "scope", F.col("attributes")["lang"].alias("lang")).agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"), F.max("time_unix_nano").alias("last"))


def ingest_otlp_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace requests made of spans."""
    s = spans_of(spark, sf_dir)
    one = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.col("name"), F.col("start_time").cast("string").alias("startTimeUnixNano"), F.col("end_time").cast("string").alias("endTimeUnixNano"), F.struct(F.col("status").alias("code")).alias("status"))
    path = _written(spark, "otlpt", s.select(_json(resourceSpans=F.array(F.struct(F.struct(_attributes(F.create_map(F.lit("service.name"), F.col("service"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(one).alias("spans"))).alias("scopeSpans"))))))
    t = readers.read_otlp_traces(spark, path)
    return t.groupBy("service", "status").agg(F.count("*").alias("n"), F.sum("duration").alias("duration"), F.count_if(F.col("parent_span_id") == "").alias("roots"), F.count_distinct("trace_id").alias("traces"))


def ingest_opentsdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put requests, half of them with stamps in milliseconds."""
    m = table(spark, sf_dir, "metrics").where("value is not null and not isnan(value)")
    stamp = F.when(F.col("point_id") % 2 == 0, F.col("timestamp") * 1000 + 7).otherwise(F.col("timestamp"))
    path = _written(spark, "tsdb", m.select(_json(metric=F.col("metric"), tags=F.col("tags"), timestamp=stamp, value=F.col("value"))))
    o = readers.read_opentsdb(spark, path)
    return rounded(o.groupBy("metric").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("tags").alias("tagged"), F.min("value").alias("least")))


def ingest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed csv lookup: numbers come back as numbers."""
    path = shared_path(spark, "lookup")
    table(spark, sf_dir, "nation").write.option("header", True).option("compression", "gzip").csv(path)
    return readers.read_lookup(spark, path).select(F.col("n_nationkey").cast("double").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("double").alias("n_regionkey"))


def sink_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files by day, read back by their partition."""
    path = shared_path(spark, "sink")
    readers.write_events(table(spark, sf_dir, "events"), path, "ts", bloom=("event_type",))
    return rounded(spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"), F.sum("value").alias("total")))


_ALL = (ingest_bulk, ingest_events_json, ingest_hec, ingest_loki, ingest_otlp_metrics, ingest_otlp_logs, ingest_otlp_traces, ingest_opentsdb, ingest_lookup, sink_events)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "ingest_bulk": "SELECT 'logs-' || event_type AS _index, count(*) AS n, count(*) AS paired, round(sum(value), 4) AS total, CAST(sum(user_id) AS BIGINT) AS users, count(*) AS marked FROM events GROUP BY 1",
        "ingest_events_json": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(user_id) AS marks FROM events GROUP BY 1",
        "ingest_hec": "SELECT 'h' || (user_id % 3) AS host, 'main' AS index, count(*) AS n, round(sum(value), 4) AS total, max(user_id) AS most, count(DISTINCT event_type) AS types FROM events GROUP BY 1",
        "ingest_loki": "WITH v AS (SELECT stream['job'] AS job, unnest(\"values\") AS v FROM loki_streams) SELECT job, count(*) AS n, CAST(sum(length(v.line)) AS BIGINT) AS chars, min(TRY_CAST(v.ts AS BIGINT)) AS first, max(TRY_CAST(v.ts AS BIGINT)) AS last FROM v GROUP BY job",
        "ingest_otlp_metrics": "SELECT name AS metric, count(*) AS n, round(CAST(sum(value) AS DOUBLE), 4) AS total, CAST(sum(coalesce(cardinality(attributes), 0)) AS BIGINT) AS tags, CAST(max(trunc(time_unix_nano / 1000000000)) AS BIGINT) AS last FROM otlp_points WHERE time_unix_nano IS NOT NULL GROUP BY name",
        "ingest_otlp_logs": "SELECT 'forum' AS service, 'posts' AS scope, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(doc_id) * 1000000000 AS last FROM documents GROUP BY lang",
        "ingest_otlp_traces": _sp + "SELECT service, status, count(*) AS n, CAST(sum(duration) AS BIGINT) AS duration, count(*) FILTER (parent_span_id = '') AS roots, count(DISTINCT trace_id) AS traces FROM s GROUP BY 1, 2",
        "ingest_opentsdb": "SELECT metric, count(*) AS n, min(\"timestamp\") AS first, max(\"timestamp\") AS last, count(tags) AS tagged, round(min(value), 4) AS least FROM metrics WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY metric",
        "ingest_lookup": "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation",
        "sink_events": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    }
