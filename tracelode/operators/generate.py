"""Commands that bring rows in: gentimes, inputlookup, lookup, append, and format, eventcount."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.typing import as_str, column, q
from tracelode.lang import timespec
from tracelode.lang.lex import QueryError, bare, flag, options, words
from tracelode.plans import bind
from tracelode.plans.frame import Frame
from tracelode.sources.readers import read_lookup


FORMAT_MOST = 10_000


def gentimes(fr: Frame, s: str) -> Frame:
    """One row an interval from start to end: start and end in seconds, and both readable."""
    opts, _ = options(words(s), {"start": 0, "end": 0, "increment": 0})
    if "start" not in opts:
        raise QueryError("gentimes needs start")

    def at(v: str) -> int:
        if re.fullmatch(r"-?\d{1,8}", v):
            return timespec.resolve(f"{'' if v.startswith('-') else '+'}{v}d@d", fr.now) // 1000
        m = re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", v)
        return timespec.resolve(v + ":00:00:00" if m else v, fr.now) // 1000

    lo, hi = at(opts["start"]), at(opts["end"]) if "end" in opts else int(fr.now.timestamp())
    step = timespec.span_ms(opts.get("increment", "1d")) // 1000
    spark = fr.df.sparkSession
    n = max(0, -(-(hi - lo) // step))
    t = spark.range(n).select((F.col("id") * step + lo).alias("starttime"))
    human = lambda c: F.date_format(F.timestamp_micros(c * 1_000_000), "EEE MMM d HH:mm:ss yyyy")
    end = F.col("starttime") + step - 1
    df = t.select("starttime", end.alias("endtime"), human(F.col("starttime")).alias("starthuman"), human(end).alias("endhuman"), F.col("starttime").alias("__o_g"))
    return fr.with_df(df, order=(("__o_g", False),))


def _lookup(fr: Frame, name: str) -> DataFrame:
    return fr.engine.lookup(name) if fr.engine is not None else read_lookup(fr.df.sparkSession, name)  # type: ignore[attr-defined]


def inputlookup(fr: Frame, s: str, first: bool) -> Frame:
    m = re.search(r"\bwhere\b(.*)$", s, re.I | re.S)
    cond = m[1] if m else None
    opts, rest = options(words(s[: m.start()] if m else s), {"append": 0, "strict": 0, "start": 0, "max": 0})
    if len(rest) != 1:
        raise QueryError("inputlookup takes one file")
    name = bare(rest[0])
    df = _lookup(fr, name)
    base = Frame(df, None, fr.now, fr.start_ms, fr.end_ms, engine=fr.engine)
    if cond:
        from tracelode.lang import search

        n = search.parse(cond)
        base = base if n is None else base.with_df(base.df.where(bind.clause(base, n)))
    start, most = int(opts.get("start", 0)), int(opts.get("max", 1_000_000_000))
    df = base.df
    if start:
        df = df.offset(start)
    if "max" in opts:
        df = df.limit(most)
    if first or not flag(opts.get("append"), False):
        return fr.with_df(df, order=None)
    return append_rows(fr, df)


def append_rows(fr: Frame, df: DataFrame) -> Frame:
    """Rows of another frame after those of this one; columns that differ in type meet as texts."""
    left = fr.df
    for f in df.schema.fields:
        v = column(left, f.name)
        if v is not None and v.t != f.dataType:
            left = left.withColumn(f.name, as_str(v))
            df = df.withColumn(f.name, as_str(column(df, f.name)))  # type: ignore[arg-type]
    left = left.withColumn("__o_part", F.lit(0))
    df = df.withColumn("__o_part", F.lit(1))
    order = (("__o_part", False), *[o for o in fr.order or () if o[0] != "__o_part"])
    return fr.with_df(left.unionByName(df, allowMissingColumns=True), order=order)


def lookup(fr: Frame, s: str) -> Frame:
    """``lookup file key [AS field] OUTPUT a [AS b], ...``: fields of the matching row."""
    m = re.fullmatch(r"\s*(\S+)\s+(.*?)\s+OUTPUT(?:NEW)?\s+(.*)", s, re.S | re.I)
    if not m:
        raise QueryError("lookup takes file key OUTPUT fields")
    pair = lambda t: [(bare(a), bare(b or a)) for a, b in re.findall(r'("[^"]*"|[^\s,]+)(?:\s+AS\s+("[^"]*"|[^\s,]+))?', t, re.I)]
    keys, outs = pair(m[2]), pair(m[3])
    t = _lookup(fr, m[1])
    t = t.dropDuplicates([a for a, _ in keys])
    right = t.select(*[as_str(column(t, a)).alias(f"__l{i}") for i, (a, _) in enumerate(keys)], *[q(a).alias(f"__v{i}") for i, (a, _) in enumerate(outs)])  # type: ignore[arg-type]
    on = None
    for i, (_, b) in enumerate(keys):
        e = as_str(bind.field(fr, b)) == F.col(f"__l{i}")
        on = e if on is None else on & e
    j = fr.df.join(right, on, "left").drop(*[f"__l{i}" for i in range(len(keys))])
    out = fr.with_df(j)
    vis = [c for c in fr.columns if c not in [b for _, b in outs]]
    return out.select(*map(q, vis), *[F.col(f"__v{i}").alias(b) for i, (_, b) in enumerate(outs)])


def format_cmd(fr: Frame, s: str) -> Frame:
    """All rows as one boolean search text, as in ``((a="1" AND b="2") OR (...))``.

    The text is one cell, so ``maxresults`` (10,000) bounds the rows; more raise an error when the plan runs."""
    m = re.fullmatch(r"\s*(?:maxresults\s*=\s*(\d+))?\s*", s, re.I)
    if not m:
        raise QueryError(f"format takes maxresults only: {s!r}")
    most = int(m[1] or FORMAT_MOST)
    cols = [F.when(q(c).isNotNull(), F.concat(F.lit(f'{c}="'), as_str(column(fr.df, c)), F.lit('"'))) for c in fr.columns]  # type: ignore[arg-type]
    row = F.concat(F.lit("( "), F.concat_ws(" AND ", *cols), F.lit(" )"))
    key = F.struct(*map(F.col, [c for c, _ in fr.order])) if fr.order else F.lit(0)
    g = fr.df.select(F.struct(key.alias("k"), row.alias("r")).alias("x")).limit(most + 1).agg(F.array_sort(F.collect_list("x")).alias("x"))
    g = g.withColumn("x", F.when(F.size("x") > most, F.raise_error(F.lit(f"format has more than {most} rows")).cast(g.schema["x"].dataType)).otherwise(F.col("x")))
    return fr.with_df(g.select(F.when(F.size("x") > 0, F.concat(F.lit("( "), F.array_join(F.col("x.r"), " OR "), F.lit(" )"))).otherwise("NOT( )").alias("search")), order=None)


def eventcount(fr: Frame, s: str) -> Frame:
    """Number of events of each index of the engine."""
    if fr.engine is None:
        raise QueryError("eventcount needs an engine")
    parts = [df.agg(F.count("*").alias("count")).select(F.lit(n).alias("index"), "count") for n, df in fr.engine.catalog.indices()]  # type: ignore[attr-defined]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return fr.with_df(out, order=None)


def filldown(fr: Frame, s: str) -> Frame:
    """NULLs take the last value before them in row order."""
    from tracelode.operators.rows import expand
    from tracelode.plans import ordered

    names = expand(fr, [bare(w) for w in words(s)]) if s.strip() else fr.columns
    fr = ordered.numbered(fr)
    x = fr.df.withColumn("__b", F.floor(F.col(ordered.IDX) / ordered.BLOCK))
    last = x.groupBy("__b").agg(*[F.max_by(q(c), F.when(q(c).isNotNull(), F.col(ordered.IDX))).alias(f"__l{i}") for i, c in enumerate(names)])
    w = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("__b", *[F.last(f"__l{i}", ignorenulls=True).over(w).alias(f"__c{i}") for i in range(len(names))])
    x = x.join(carry, "__b")
    here = Window.partitionBy("__b").orderBy(ordered.IDX).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({c: F.coalesce(F.last(q(c), ignorenulls=True).over(here), F.col(f"__c{i}")) for i, c in enumerate(names)})
    return fr.with_df(x.drop("__b", *[f"__c{i}" for i in range(len(names))]))
