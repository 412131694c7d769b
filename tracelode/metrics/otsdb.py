"""OpenTSDB-style queries: ``agg:downsample:metric{tag=a|b}``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.series import metric_name
from tracelode.lang.lex import QueryError
from tracelode.lang.timespec import span_ms


def _agg(name: str, c: Column, exact: bool = False) -> Column:
    m = re.fullmatch(r"p(\d+)|quantile(0?\.\d+)?", name)
    if m:
        p = float(m[1]) / 100 if m[1] else float(m[2] or 0.5)
        return F.percentile(c, p) if exact else F.percentile_approx(c, p, 10_000)
    f = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": lambda x: F.count(x).cast("double"), "cardinality": lambda x: (F.count_distinct(x) if exact else F.approx_count_distinct(x, 0.01)).cast("double"), "mean": F.avg}.get(name)
    if f is None:
        raise QueryError(f"unknown aggregator {name}")
    return f(c)


def expressions(metrics: DataFrame, body: dict, now: int, exact: bool = False) -> dict[str, DataFrame]:
    """The outputs of an expression request by alias: named metrics with named filters, one aggregator and downsampler.

    Outputs that name no metric, and metrics that name no filter of the request, are left out; times are epoch
    seconds (or milliseconds), the end is ``now`` by default."""
    time = body.get("time") or {}
    if time.get("start") in (None, ""):
        raise QueryError("an expression request needs a start")
    seconds = lambda v: int(float(v)) // (1000 if float(v) > 99_999_999_999 else 1)
    start, end = seconds(time["start"]), seconds(time["end"]) if time.get("end") not in (None, "") else now
    agg, down = time.get("aggregator"), time.get("downsampler") or {}
    if agg not in ("count", "avg", "min", "max", "sum", "cardinality"):
        raise QueryError(f"unknown aggregator {agg}")
    if bool(down.get("interval")) != bool(down.get("aggregator")):
        raise QueryError("a downsampler needs interval and aggregator")
    width, fn = (down["interval"], down["aggregator"]) if down else ("1m", "avg")
    tags = {f["id"]: ",".join(f"{t['tagk']}={t['filter']}" for t in f.get("tags", [])) for f in body.get("filters", [])}
    named = {m["id"]: m for m in body.get("metrics", [])}
    out = {}
    for o in body.get("outputs", []):
        m = named.get(o["id"])
        if m is None or m.get("filter") not in tags:
            continue
        t = tags[m["filter"]]
        out[o.get("alias", o["id"])] = query(metrics, f"{agg}:{width}-{fn}:{m['metric']}" + (f"{{{t}}}" if t else ""), start, end, exact)
    return out


def query(metrics: DataFrame, text: str, start: int, end: int, exact: bool = False) -> DataFrame:
    """``tags, ts, value``.  A tag with one value, alternatives or a pattern with ``*`` filters; all named
    tags group.  There is no ``rate``: a query that names it is refused."""
    m = re.fullmatch(r"\s*([\w.]+):(?:(\d+\w+?)-([\w.]+?)(c)?:)?([\w./-]+)(?:\{([^}]*)\})?\s*", text)
    if not m:
        raise QueryError(f"no query: {text!r}")
    agg, width, down, _, name, tags = m.groups()
    x = metrics.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("timestamp") >= start) & (F.col("timestamp") <= end))
    x = x.where(metric_name(F.col("metric")) == re.sub(r"[^A-Za-z0-9_]", "_", name))
    group: list[str] = []
    for part in filter(None, (tags or "").split(",")):
        k, _, v = (p.strip() for p in part.partition("="))
        opts, tag = v.strip('"').split("|"), F.col("tags")[k]
        if any("*" in o for o in opts):
            x = x.where(tag.rlike("^(?:" + "|".join(".*".join(re.escape(p) for p in o.split("*")) for o in opts) + ")$"))
        else:
            x = x.where(tag.isin(opts))
        group.append(k)
    step = max(span_ms(width) // 1000, 1) if width else 1
    ts = (F.floor(F.col("timestamp") / step) * step).cast("bigint")
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.col("tags")[k].alias("value")) for k in sorted(group)]) if group else F.array().cast("array<struct<key:string,value:string>>")
    per_series = x.select(keys.alias("tags"), F.xxhash64(F.sort_array(F.map_entries("tags"))).alias("s"), ts.alias("ts"), "value")
    if width:
        per_series = per_series.groupBy("tags", "s", "ts").agg(_agg(down, F.col("value"), exact).alias("value"))
    return per_series.groupBy("tags", "ts").agg(_agg(agg, F.col("value"), exact).alias("value"))
