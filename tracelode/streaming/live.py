"""Structured Streaming forms of the operators: live filters, windows, duplicates, sessions, alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelode.functions import aggs
from tracelode.lang import search
from tracelode.operators import rows
from tracelode.operators.groups import parse_aggs
from tracelode.plans import bind
from tracelode.plans.frame import Frame

_STATELESS = {"search": rows.search_cmd, "where": rows.where, "regex": rows.regex, "fields": rows.fields, "rename": rows.rename, "eval": rows.eval_cmd, "rex": rows.rex, "makemv": rows.makemv}


def tail(stream: DataFrame, text: str) -> DataFrame:
    """A live tail: search and row-wise commands over a stream."""
    from tracelode.lang.lex import QueryError, cut

    head, *cmds = cut(text, "|")
    fr = Frame(stream, None, dt.datetime.now(dt.timezone.utc))
    n = search.parse(head.removeprefix("search "))
    if n is not None:
        fr = fr.with_df(fr.df.where(bind.clause(fr, n)))
    for c in cmds:
        name, _, args = c.partition(" ")
        if name not in _STATELESS:
            raise QueryError(f"{name} is no live command")
        fr = _STATELESS[name](fr, args)
    return fr.df


def windowed_stats(stream: DataFrame, time: str, width: str, text: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """``stats`` text per event-time window; rows later than the watermark are left out."""
    measures, by = parse_aggs(text)
    s = stream.withWatermark(time, late)
    fr = Frame(s, None, dt.datetime.now(dt.timezone.utc), exact=False)
    w = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    cols: list[Column] = []
    for a in measures:
        v = None if a.arg is None else bind.expression(fr, a.arg) if a.is_eval else bind.field(fr, a.arg)
        cols.append(aggs.build(a, v, None, exact=False).alias(a.name))
    g = s.groupBy(w.alias("w"), *map(F.col, by)).agg(*cols)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[F.col(f"`{a.name}`") for a in measures])


def dedup(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per key that close after ``gap`` without a row."""
    s = stream.withWatermark(time, late)
    g = s.groupBy(F.session_window(F.col(time), gap).alias("w"), *map(F.col, keys)).agg(F.count("*").alias("eventcount"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "eventcount")


def red_windows(entry_spans: DataFrame, time: str, width: str = "5 minutes", late: str = "5 minutes") -> DataFrame:
    """Service rate and errors per window over a stream of entry spans."""
    s = entry_spans.withWatermark(time, late)
    g = s.groupBy(F.window(F.col(time), width).alias("w"), "service").agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "STATUS_CODE_ERROR").alias("errors"), F.percentile_approx(F.col("duration") / 1_000_000, [0.5, 0.9, 0.95, 0.99]).alias("latency_ms"))
    return g.select(F.col("w.start").alias("window_start"), "service", "requests", "errors", "latency_ms")


def with_fresh(stored: DataFrame, sink: str) -> DataFrame:
    """Stored rows together with what a running stream has written to its Parquet sink so far."""
    spark = stored.sparkSession
    fresh = spark.read.schema(stored.schema).parquet(sink)
    return stored.unionByName(fresh)


_STATE = "n bigint, total double, low double, high double"


def running(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running ``count, sum, avg, min, max`` of a value per key, in order of arrival: the columns of the stream
    with these five added.  NULL values change nothing; state is four numbers a key."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = stream.schema
    names = ["running_count", "running_sum", "running_avg", "running_min", "running_max"]
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields], f"{names[0]} bigint", *[f"{n} double" for n in names[1:]]])

    def work(_key, parts, state):
        n, total, low, high = state.get if state.exists else (0, 0.0, float("inf"), float("-inf"))
        for x in parts:
            v = pd.to_numeric(x[value]).astype("float64")
            x[names[0]] = n + v.notna().cumsum()
            x[names[1]] = total + v.fillna(0).cumsum()
            x[names[3]] = v.fillna(float("inf")).cummin().clip(upper=low)
            x[names[4]] = v.fillna(float("-inf")).cummax().clip(lower=high)
            if len(x):
                n, total, low, high = int(x[names[0]].iloc[-1]), float(x[names[1]].iloc[-1]), float(x[names[3]].iloc[-1]), float(x[names[4]].iloc[-1])
            some = x[names[0]] > 0
            x[names[2]] = (x[names[1]] / x[names[0]]).where(some)
            for c in names[1:]:
                x[c] = x[c].where(some)
            yield x[[*[f.name for f in schema.fields], *names]]
        state.update((n, total, low, high))

    return stream.groupBy(key).applyInPandasWithState(work, out, _STATE, "append", GroupStateTimeout.NoTimeout)


def alert_states(evaluations: DataFrame, op: str, threshold: float, consecutive: int, keys: list[str], time: str, value: str) -> DataFrame:
    """``Normal``, ``Pending`` or ``Firing`` of each evaluation: it fires after ``consecutive`` hits in a row."""
    from pyspark.sql import Window

    v = F.col(value)
    hit = {">": v > threshold, "<": v < threshold, "=": v == threshold, "!=": v != threshold, "novalue": v.isNull()}[op.lower()]
    hit = F.coalesce(hit, F.lit(False)).cast("int")
    w = Window.partitionBy(*keys).orderBy(time)
    n = F.sum("__hit").over(w.rowsBetween(-(consecutive - 1), 0))
    x = evaluations.withColumn("__hit", hit)
    state = F.when(F.col("__hit") == 0, "Normal").when(n == consecutive, "Firing").otherwise("Pending")
    return x.withColumn("state", state).drop("__hit")


def to_memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """A running query into a table in memory, for live views and tests."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def drain(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet and reads the result: the batch form of a live query."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")
