"""Commands that aggregate: stats, timechart, top, rare, eventstats."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import aggs
from tracelode.functions.aggs import Agg
from tracelode.functions.typing import as_num, as_str, column, q
from tracelode.lang import lex, timespec
from tracelode.lang.lex import QueryError, bare, flag, options, words
from tracelode.plans import bind
from tracelode.plans.frame import TS, Frame
from tracelode.session import cut

_AGG = re.compile(r"""\s*,?\s*([A-Za-z_]\w*(?:\.\d+)?)(\s*\()?""")


def parse_aggs(s: str) -> tuple[list[Agg], list[str]]:
    """Aggregates with aliases, and the fields after BY."""
    by: list[str] = []
    m = re.search(r"(?:^|\s)by\s+((?:(?!\bby\s).)*)$", s, re.I | re.S)
    if m and _outside(s, m.start()):
        by = [bare(w) for w in words(m[1])]
        s = s[: m.start()]
    out, i = [], 0
    while i < len(s) and s[i:].strip(" ,\n\t"):
        m = _AGG.match(s, i)
        if not m:
            raise QueryError(f"no aggregate: {s[i:]!r}")
        start, arg, j = m.start(1), None, m.end()
        if m[2]:
            depth, j0, quote = 1, m.end(), False
            while depth:
                if j >= len(s):
                    raise QueryError(f"missing ) in {s!r}")
                ch = s[j]
                if ch == '"':
                    quote = not quote
                elif not quote:
                    depth += (ch == "(") - (ch == ")")
                j += 1
            arg = s[j0 : j - 1]
        text = s[start:j]
        a = re.match(r'\s+as\s+("(?:[^"\\]|\\.)*"|[^\s,]+)', s[j:], re.I)
        alias = bare(a[1]) if a else None
        out.append(aggs.parse_agg(m[1], arg, alias, text))
        i = j + (a.end() if a else 0)
    return out, by


def _outside(s: str, at: int) -> bool:
    return s[:at].count('"') % 2 == 0 and s[:at].count("(") == s[:at].count(")")


def built(fr: Frame, a: Agg) -> Column:
    v = None
    if a.arg is not None:
        v = bind.expression(fr, a.arg) if a.is_eval else bind.field(fr, a.arg)
        if v.is_null and a.fn != "count":
            return F.max(F.lit(None).cast("double")).alias(a.name)
    return aggs.build(a, v, fr.time, fr.exact).alias(a.name)


def free(name: str, taken: list[str]) -> str:
    """``name``, or the next of ``name_2``, ``name_3``, ... that is not taken."""
    n, k = name, 1
    while n in taken:
        k += 1
        n = f"{name}_{k}"
    return n


def _distinct_names(measures: list[Agg], taken: list[str]) -> list[Agg]:
    """Measures whose names clash with a key or with each other get a number."""
    out: list[Agg] = []
    for a in measures:
        n = free(a.name, [*taken, *[m.name for m in out]])
        out.append(a if n == a.name else replace(a, alias=n))
    return out


_STATS_OPTIONS = {"allnum": "false", "delim": " ", "partitions": "1", "dedup_splitvals": "false"}


def stats(fr: Frame, s: str) -> Frame:
    head = re.match(r"(?:\s*(?:allnum|delim|partitions|dedup_splitvals)\s*=\s*(?:\"[^\"]*\"|\S+))*", s, re.I)
    assert head
    opts, _ = options(words(head[0]), _STATS_OPTIONS)
    for k, v in opts.items():
        if v.lower() not in (_STATS_OPTIONS[k], {"false": "f"}.get(_STATS_OPTIONS[k])):
            raise QueryError(f"stats option {k} only has its default")
    measures, by = parse_aggs(s[head.end() :])
    if not measures:
        raise QueryError("stats needs an aggregate")
    if any(c not in fr.columns for c in by):
        fr = fr.put({c: F.lit(None).cast("string") for c in by if c not in fr.columns})
    by = list(dict.fromkeys(by))
    measures = _distinct_names(measures, by)
    plain = [a for a in measures if a.fn != "list" or fr.time is None]
    df = fr.df.groupBy(*map(q, by)).agg(*([built(fr, a) for a in plain] or [F.count(F.lit(1)).alias("__rows")]))
    for a in measures:
        if a not in plain:
            df = _with_list(fr, df, a, by)
    return fr.with_df(df.select(*map(q, by), *[q(a.name) for a in measures]), order=None)


def _with_list(fr: Frame, df: DataFrame, a: Agg, by: list[str]) -> DataFrame:
    """A column with the first values by time.  Rows beyond the list's length are
    cut in each task before the shuffle, so a hot group is never collected."""
    v = bind.expression(fr, a.arg) if a.is_eval else bind.field(fr, a.arg)  # type: ignore[arg-type]
    names = [f"__l{i}" for i in range(len(by))]
    x = fr.df.select(*[q(c).alias(n) for c, n in zip(by, names)], fr.time.alias("__t"), as_str(v).alias("__v")).where("__v is not null")  # type: ignore[union-attr]
    w = (Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))).orderBy("__t", "__v")
    x = x.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= aggs.LIST_MOST)
    one = F.transform(F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda e: e["__v"])
    y = x.groupBy(*names).agg(one.alias(a.name))
    on = F.lit(True)
    for c, n in zip(by, names):
        on = on & q(c).eqNullSafe(F.col(n))
    j = df.join(y, on, "left").drop(*names)
    return j.withColumn(a.name, F.coalesce(q(a.name), F.array().cast("array<string>")))


def eventstats(fr: Frame, s: str) -> Frame:
    """Aggregates added to each row: one aggregate joined back, not a window, so that hot groups stay split."""
    measures, by = parse_aggs(s)
    a = fr.df.groupBy(*[q(c).alias(f"__k{i}") for i, c in enumerate(by)]).agg(*[built(fr, m) for m in measures])
    if not by:
        df = fr.df.join(F.broadcast(a.limit(1)), F.lit(True), "left")
    else:
        on = None
        for i, c in enumerate(by):
            e = q(c).eqNullSafe(F.col(f"__k{i}"))
            on = e if on is None else on & e
        df = fr.df.join(a, on, "left").drop(*[f"__k{i}" for i in range(len(by))])
    vis = [c for c in fr.columns if c not in [m.name for m in measures]] + [m.name for m in measures]
    return fr.with_df(df.select(*map(q, vis), *map(F.col, fr.hidden)))


def _frequency(fr: Frame, s: str, rare: bool, by_frequency: bool = False) -> Frame:
    """Counts of field combinations.  Without a number all combinations by count;
    with one the N first by key text (the documented order of this dialect)."""
    opts, rest = options(words(s), {k: 0 for k in ("limit", "showcount", "countfield", "showperc", "percentfield", "useother", "otherstr")})
    at = next((i for i, w in enumerate(rest) if w.lower() == "by"), len(rest))
    by, rest = [bare(w) for w in rest[at + 1 :]], rest[:at]
    n = int(opts["limit"]) if "limit" in opts else None
    if rest and re.fullmatch(r"\d+", rest[0]):
        n = int(rest.pop(0))
    keys = [bare(w) for w in rest]
    if not keys:
        raise QueryError("top and rare need a field")
    count = free(opts.get("countfield", "count"), [*by, *keys])
    perc = free(opts.get("percentfield", "percent"), [*by, *keys, count])
    g = fr.df.groupBy(*[q(c) for c in [*by, *keys]]).agg(F.count(F.lit(1)).alias("__n"))
    # totals by an aggregate of the counts: one row a ``by`` group, joined back
    names = [f"__b{i}" for i in range(len(by))]
    totals = g.groupBy(*[q(c).alias(b) for c, b in zip(by, names)]).agg(F.sum("__n").alias("__all"))
    match = F.lit(True)
    for c, b in zip(by, names):
        match = match & q(c).eqNullSafe(F.col(b))
    texts = {f"__o_k{i}": as_str(column(g, c)) for i, c in enumerate(keys)}  # type: ignore[arg-type]
    g = g.withColumns(texts | {"__o_n": F.col("__n")})
    by_key = n is not None and not by_frequency
    order = ([] if by_key else [("__o_n", not rare)]) + [(k, by_key and not rare) for k in texts]
    ranked = [F.col(c).desc_nulls_last() if falls else F.col(c).asc_nulls_last() for c, falls in order]
    kept = g
    if n and by:  # Spark cuts each group before the shuffle
        kept = g.withColumn("__rank", F.row_number().over(Window.partitionBy(*map(q, by)).orderBy(*ranked))).where(F.col("__rank") <= n).drop("__rank")
    elif n:
        kept = g.orderBy(*ranked).limit(n)
    kept = kept.withColumn("__o_other", F.lit(0))
    if n and flag(opts.get("useother"), False):
        mine = kept.groupBy(*[q(c).alias(b) for c, b in zip(by, names)]).agg(F.sum("__n").alias("__mine"))
        left, right = totals.alias("l"), mine.alias("r")
        on = F.lit(True)
        for b in names:
            on = on & F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}"))
        rest = left.join(right, on).where(F.col("__all") > F.col("__mine"))
        other = rest.select(*[F.col(f"l.{b}").alias(c) for c, b in zip(by, names)], *[F.lit(opts.get("otherstr", "other")).alias(c) for c in keys], (F.col("__all") - F.col("__mine")).alias("__n"), *[F.lit(None).cast("string").alias(k) for k in texts], F.lit(0).cast("bigint").alias("__o_n"), F.lit(1).alias("__o_other"))
        kept = kept.select(*map(q, by), *[as_str(column(kept, c)).alias(c) for c in keys], "__n", *texts, "__o_n", "__o_other").unionByName(other)  # type: ignore[arg-type]
    out = kept.join(totals if by else F.broadcast(totals.limit(1)), match)
    cols = [q(c) for c in [*by, *keys]]
    if flag(opts.get("showcount"), True):
        cols.append(F.col("__n").alias(count))
    if flag(opts.get("showperc"), True):
        cols.append(F.round(F.col("__n") * 100.0 / F.col("__all"), 6).alias(perc))
    return fr.with_df(out.select(*cols, "__o_other", "__o_n", *texts), order=(("__o_other", False), *order))


def top(fr: Frame, s: str) -> Frame:
    return _frequency(fr, s, False)


def rare(fr: Frame, s: str) -> Frame:
    return _frequency(fr, s, True)


_CHART = {k: 0 for k in ("span", "bins", "limit", "useother", "otherstr", "usenull", "nullstr")}


SPLIT_MOST = 10_000  # columns of a timechart with limit=0; further values go to the other column


def timechart(fr: Frame, s: str) -> Frame:
    """Buckets anchored at the query's start; a split field becomes columns.

    The values that become columns are found by one small aggregate (top
    ``limit`` by the sum of the measure, or by rows if there are several)."""
    if fr.time is None:
        raise QueryError("timechart needs event times")
    limit_m = re.search(r"limit\s*=\s*(top|bottom)?\s*(\d+)", s, re.I)
    best, n = (limit_m[1] or "top").lower() if limit_m else "top", int(limit_m[2]) if limit_m else 10
    s = re.sub(r"limit\s*=\s*(top|bottom)?\s*\d+", " ", s, flags=re.I)
    opts = {m[1].lower(): bare(m[2]) for m in re.finditer(r'\b(span|bins|useother|otherstr|usenull|nullstr)\s*=\s*("[^"]*"|\S+)', s, re.I)}
    s = re.sub(r'\b(span|bins|useother|otherstr|usenull|nullstr)\s*=\s*("[^"]*"|\S+)', " ", s, flags=re.I)
    measures, by = parse_aggs(s)
    if not measures or len(by) > 1:
        raise QueryError("timechart takes aggregates and at most one split field")
    if fr.start_ms is None or fr.end_ms is None:
        r = fr.df.agg(F.min(TS).alias("lo"), F.max(TS).alias("hi")).first()
        lo, hi = (fr.start_ms if fr.start_ms is not None else r["lo"] or 0), (fr.end_ms if fr.end_ms is not None else (r["hi"] or 0) + 1)
    else:
        lo, hi = fr.start_ms, fr.end_ms
    width = timespec.span_ms(opts["span"]) if "span" in opts else timespec.default_chart_span(hi - lo)
    ts = F.least(F.greatest(fr.time, F.lit(lo)), F.lit(max(hi - 1, lo)))
    bucket = (F.floor((ts - lo) / width) * width + lo).cast("bigint").alias("timestamp")
    if not by:
        df = fr.df.groupBy(bucket).agg(*[built(fr, a) for a in _distinct_names(measures, ["timestamp"])])
        return fr.with_df(df.withColumn("__o_t", F.col("timestamp")), order=(("__o_t", False),))
    v = bind.field(fr, by[0])
    nullstr, otherstr = opts.get("nullstr", "NULL"), opts.get("otherstr", "other")
    key = F.lit(nullstr) if v.is_null else F.coalesce(as_str(v), F.lit(nullstr))
    df0 = fr.df if flag(opts.get("usenull"), True) or v.is_null else fr.df.where(v.c.isNotNull())
    score = F.count(F.lit(1))
    x = df0.withColumn("__k", key)
    fx = fr.with_df(x)
    # one pass over the events gives the chart's cells, their scores, and, where all values fit, the chart
    cells = cut(x.groupBy("__k", bucket).agg(score.alias("__n"), *[built(fx, a).alias(f"m{i}") for i, a in enumerate(measures)]), "chart")
    worth = F.col("m0").try_cast("double") if len(measures) == 1 else F.col("__n")
    scores = cells.groupBy("__k").agg(F.sum(worth).alias("__s"))
    order = [F.col("__s").desc_nulls_last() if best == "top" else F.col("__s").asc_nulls_last(), F.col("__k")]
    most = n or SPLIT_MOST
    keep = [r["__k"] for r in scores.orderBy(*order).limit(most + 1).collect()]
    more = len(keep) > most
    keep = keep[:most]
    use_other = flag(opts.get("useother"), True) and more
    if more and not n and not use_other:
        raise QueryError(f"timechart with limit=0 and without other column has more than {SPLIT_MOST} split values")
    if more and use_other:
        x = x.withColumn("__k", F.when(F.col("__k").isin(keep), F.col("__k")).otherwise(otherstr))
        keep = [*keep, *([otherstr] if otherstr not in keep else [])]
    if keep and not (more and use_other):
        g = cells.groupBy("timestamp").pivot("__k", keep).agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(len(measures))])
    else:
        fx = fr.with_df(x)
        named = [built(fx, a).alias(f"m{i}") for i, a in enumerate(measures)]
        g = x.groupBy(bucket).pivot("__k", keep).agg(*named) if keep else x.groupBy(bucket).agg(*named)
    cols = [q("timestamp")]
    for k in keep:
        for i, a in enumerate(measures):
            src = f"{k}_m{i}" if len(measures) > 1 else k
            cols.append(q(src).alias(k if len(measures) == 1 else f"{a.name}: {k}"))
    df = g.select(*cols)
    return fr.with_df(df.withColumn("__o_t", F.col("timestamp")), order=(("__o_t", False),))


def fill_buckets(fr: Frame, width_ms: int, value: float = 0.0) -> DataFrame:
    """A timechart with its missing buckets between start and end filled."""
    if fr.start_ms is None or fr.end_ms is None:
        raise QueryError("filling needs a time range")
    spark = fr.df.sparkSession
    n = -(-(fr.end_ms - fr.start_ms) // width_ms)
    grid = spark.range(n).select((F.col("id") * width_ms + fr.start_ms).alias("timestamp"))
    rest = [c for c in fr.columns if c != "timestamp"]
    j = grid.join(fr.df.select("timestamp", *map(q, rest)), "timestamp", "left")
    return j.select("timestamp", *[F.coalesce(q(c), F.lit(value).cast(dict(fr.df.dtypes)[c])).alias(c) for c in rest])
