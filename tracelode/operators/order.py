"""Commands that make or use the order of rows: sort, head, tail, dedup, streamstats, transaction."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import aggs
from tracelode.functions.typing import as_bool, as_num, as_str, column, number_text, q
from tracelode.lang import lex, search, timespec
from tracelode.lang.lex import QueryError, bare, flag, options, words
from tracelode.operators.groups import parse_aggs
from tracelode.plans import bind, ordered
from tracelode.plans.frame import TS, Frame

SORT_LIMIT = 10_000


def _sort_columns(fr: Frame, specs: list[str], tag: str) -> tuple[dict[str, Column], list[tuple[str, bool]]]:
    """Hidden key columns: numbers before texts before the rest, NULL last in both directions."""
    cols: dict[str, Column] = {}
    order: list[tuple[str, bool]] = []
    for i, w in enumerate(specs):
        falls = w.startswith("-")
        w = w.lstrip("+-").strip()
        m = re.fullmatch(r"(auto|str|num|ip)\((.*)\)", w)
        kind, name = (m[1], bare(m[2])) if m else ("auto", bare(w))
        if kind == "ip":
            raise QueryError("sort has no ip()")
        v = bind.field(fr, name)
        k = f"__o_{tag}{i}"
        if v.is_null:
            continue
        if kind == "num" or (kind == "auto" and v.is_num):
            cols[k] = as_num(v)
            order.append((k, falls))
        elif kind == "str" or v.is_bool:
            cols[k] = as_str(v)
            order.append((k, falls))
        elif not v.is_str:
            cols[k] = as_str(v) if v.is_mv else as_num(v)
            order.append((k, falls))
        else:
            n = as_num(v)
            cols[k + "r"] = F.when(n.isNotNull(), 0).when(v.c.isNotNull(), 1)
            cols[k + "n"], cols[k + "s"] = n, F.when(n.isNull(), as_str(v))
            order += [(k + "r", falls), (k + "n", falls), (k + "s", falls)]
    return cols, order


def sort(fr: Frame, s: str, limited: bool = True) -> Frame:
    ws = words(re.sub(r"([+-])\s+", r"\1", s.strip()))
    limit = SORT_LIMIT
    if ws and re.fullmatch(r"\d+", ws[0]):
        limit = int(ws.pop(0))
    elif ws and (m := re.fullmatch(r"limit=(\d+)", ws[0])):
        limit, ws = int(m[1]), ws[1:]
    if ws and ws[-1].lower() in ("d", "desc"):
        ws = [("-" if not w.startswith("-") else "+") + w.lstrip("+-") for w in ws[:-1]]
    if not ws:
        raise QueryError("sort needs a field")
    tag = f"s{len(fr.hidden)}_"
    cols, order = _sort_columns(fr, ws, tag)
    out = fr.with_df(fr.df.withColumns(cols) if cols else fr.df, order=(*order, *(fr.order or ())))
    return out.with_df(out.df.orderBy(*out.sort_keys()).limit(limit)) if limit and limited and out.order else out


def head(fr: Frame, s: str) -> Frame:
    s = s.strip()
    m = re.fullmatch(r"(?:limit\s*=\s*)?(\d+)?", s)
    if m:
        n = int(m[1] or 10)
        df = fr.df.orderBy(*fr.sort_keys()).limit(n) if fr.order else fr.df.limit(n)
        return fr.with_df(df)
    opts = {k.lower(): v for k, v in re.findall(r"\b(null|keeplast|limit)\s*=\s*(\S+)", s, re.I)}
    cond = re.sub(r"\b(null|keeplast|limit)\s*=\s*\S+", " ", s, flags=re.I).strip()
    v = bind.expression(fr, cond)
    go_on = v.c.cast("boolean") if v.is_bool else bind.as_bool(v)
    stop = ~F.coalesce(go_on, F.lit(flag(opts.get("null"), False)))
    x = ordered.numbered(fr.with_df(fr.df.withColumn("__o_stop", stop)))
    first = x.df.where("__o_stop").agg(F.min(ordered.IDX).alias("__first"))
    df = x.df.join(F.broadcast(first), F.lit(True), "left")
    last = F.col("__first") + (1 if flag(opts.get("keeplast"), False) else 0)
    df = df.where(F.col("__first").isNull() | (F.col(ordered.IDX) < last)).drop("__first", "__o_stop")
    out = x.with_df(df)
    return head(out, opts["limit"]) if "limit" in opts else out


def tail(fr: Frame, s: str) -> Frame:
    """The last N rows, in reverse order."""
    n = int(re.sub(r"limit\s*=", "", s).strip() or 10)
    df = fr.df.orderBy(*fr.sort_keys(backwards=True)).limit(n)
    return fr.with_df(df, order=tuple((c, not falls) for c, falls in fr.order or ()))


def dedup(fr: Frame, s: str) -> Frame:
    m = re.search(r"\bsortby\b(.*)$", s, re.I | re.S)
    sortby = m[1] if m else None
    s = s[: m.start()] if m else s
    opts, rest = options(words(s), {"keepevents": 0, "keepempty": 0, "consecutive": 0, "limit": 0})
    n = int(opts.get("limit", 1))
    if rest and re.fullmatch(r"\d+", rest[0]):
        n = int(rest.pop(0))
    keys = [bare(w) for w in rest]
    if not keys or n < 1:
        raise QueryError("dedup needs fields and a positive number")
    if sortby:
        fr = sort(fr, sortby, limited=False)
    keepevents, keepempty = flag(opts.get("keepevents"), False), flag(opts.get("keepempty"), False)
    vals = [bind.field(fr, k) for k in keys]
    empty = F.lit(False)
    for v in vals:
        empty = empty | v.c.isNull()
    names = [f"__d{i}" for i in range(len(keys))]
    df = fr.df.withColumns({k: v.c for k, v in zip(names, vals)} | {"__empty": empty})
    if not keepempty:
        df = df.where("not __empty") if not keepevents else df
    if flag(opts.get("consecutive"), False):
        x = ordered.numbered(fr.with_df(df))
        y, _ = ordered.with_halo(x.df, n)
        same = F.lit(True)
        w = Window.partitionBy("__b").orderBy(ordered.IDX)
        for k in names:  # a row goes if the n rows before it have its values
            for back in range(1, n + 1):
                same = same & F.lag(k, back).over(w).eqNullSafe(F.col(k)) & F.lag(F.lit(1), back).over(w).isNotNull()
        y = y.withColumn("__drop", same & ~F.col("__empty")).where("__own").drop("__b", "__own")
        fr = x.with_df(y)
    else:
        w = Window.partitionBy(*names).orderBy(*fr.sort_keys())
        df = df.withColumn("__rn", F.row_number().over(w))
        if not keepevents and not keepempty:  # the plain form lets Spark cut each group before the shuffle
            return fr.with_df(df.where(F.col("__rn") <= n).drop("__rn", "__empty", *names))
        fr = fr.with_df(df.withColumn("__drop", (F.col("__rn") > n) & ~F.col("__empty")).drop("__rn"))
    if not keepevents:
        return fr.with_df(fr.df.where("not __drop").drop("__drop", "__empty", *names))
    blank = {k: F.when(~F.col("__drop"), q(k)) for k in keys if k in fr.columns}
    return fr.with_df(fr.df.withColumns(blank).drop("__drop", "__empty", *names))


# ---- streamstats -------------------------------------------------------------------------------------
_MERGEABLE = {"count", "sum", "avg", "min", "max", "range", "first", "last", "stdev", "var", "dc", "estdc_error"}
_ALLOWED = _MERGEABLE | {"perc", "median", "values"}
_OPTS = r"\b(current|window|global|allnum|time_window|reset_on_change)\s*=\s*(\S+)"


def _take_condition(s: str, key: str) -> tuple[str, str | None]:
    m = re.search(rf"\b{key}\s*=\s*\(", s, re.I)
    if not m:
        return s, None
    depth, j = 1, m.end()
    while depth:
        if j >= len(s):
            raise QueryError(f"missing ) after {key}")
        depth += (s[j] == "(") - (s[j] == ")")
        j += 1
    return s[: m.start()] + s[j:], s[m.end() : j - 1]


def _windowed(fr: Frame, a: aggs.Agg, w) -> Column:
    v = None
    if a.arg is not None:
        v = bind.expression(fr, a.arg) if a.is_eval else bind.field(fr, a.arg)
        if v.is_null and a.fn != "count":
            return F.lit(None).cast("double")
    if a.fn == "dc":
        return F.size(F.collect_set(as_str(v)).over(w)).cast("double")  # type: ignore[arg-type]
    if a.fn == "estdc_error":
        return F.lit(0.0)
    if a.fn == "values":
        return F.array_sort(F.collect_set(as_str(v)).over(w))  # type: ignore[arg-type]
    if a.fn == "range":
        n = as_num(v)  # type: ignore[arg-type]
        return F.max(n).over(w) - F.min(n).over(w)
    if a.fn in ("first", "last"):
        return getattr(F, a.fn)(v.c, ignorenulls=True).over(w)  # type: ignore[union-attr]
    if a.fn in ("stdev", "var"):
        n = as_num(v)  # type: ignore[arg-type]
        return F.when(F.count(n).over(w) < 2, 0.0).otherwise((F.stddev_samp if a.fn == "stdev" else F.var_samp)(n).over(w))
    return aggs.build(a, v, None).over(w)


def streamstats(fr: Frame, s: str) -> Frame:
    s, before = _take_condition(s, "reset_before")
    s, after = _take_condition(s, "reset_after")
    opts = {k.lower(): v.strip('"') for k, v in re.findall(_OPTS, s, re.I)}
    measures, by = parse_aggs(re.sub(_OPTS, " ", s, flags=re.I))
    for a in measures:
        if a.fn not in _ALLOWED:
            raise QueryError(f"streamstats has no {a.fn}")
    current, window = flag(opts.get("current"), True), int(opts.get("window", 0))
    global_ = flag(opts.get("global"), True)
    if not 0 <= window <= 10_000:
        raise QueryError("window must be at most 10000")
    by_vals = [bind.field(fr, k) for k in by]
    group = {f"__g{i}": v.c for i, v in enumerate(by_vals)}
    keys = list(group)
    fr = fr.with_df(fr.df.withColumns(group)) if group else fr
    if "time_window" in opts:
        if not current or not global_:
            raise QueryError("time_window needs current=true and global=true")
        out = _by_time(fr, measures, keys, timespec.span_ms(opts["time_window"]))
        return out.with_df(out.df.drop(*keys))
    on_change = flag(opts.get("reset_on_change"), False) and bool(by)
    names = {f"__a{i}": a for i, a in enumerate(measures)}
    if window and keys and not global_ and not (before or after or on_change):
        end, first = (0, 1 - window) if current else (-1, -window)
        if not ordered.hot(fr.df, keys):
            w = Window.partitionBy(*keys).orderBy(*fr.sort_keys()).rowsBetween(first, end)
            return _finish(fr, fr.df.withColumns({n: _windowed(fr, a, w) for n, a in names.items()}), names, keys)
        return _by_rank(ordered.numbered(fr), names, keys, window, first, end)
    fr = ordered.numbered(fr)
    if before or after or on_change:
        fr = _epochs(fr, before, after, keys if on_change else [])
        keys = [*keys, "__epoch"] if not on_change else ["__epoch", *keys]
    if window:
        end = 0 if current else -1
        first = -(window - 1) if current else -window
        if not keys or global_:
            x, _ = ordered.with_halo(fr.df, window)
            w = Window.partitionBy("__b", *keys).orderBy(ordered.IDX).rangeBetween(first, end)
            x = x.withColumns({n: _windowed(fr, a, w) for n, a in names.items()}).where("__own").drop("__b", "__own")
        elif ordered.hot(fr.df, keys):
            return _by_rank(fr, names, keys, window, first, end)
        else:
            w = Window.partitionBy(*keys).orderBy(ordered.IDX).rowsBetween(first, end)
            x = fr.df.withColumns({n: _windowed(fr, a, w) for n, a in names.items()})
    elif all(a.fn in _MERGEABLE for a in measures):
        x = _running(fr, names, keys, current)
    else:
        # running percentiles and sets of values have no small mergeable state: a window over each group (all rows if there is none)
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(ordered.IDX).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
        x = fr.df.withColumns({n: _windowed(fr, a, w) for n, a in names.items()})
    return _finish(fr, x, names, keys)


def _by_rank(fr: Frame, names: dict[str, aggs.Agg], keys: list[str], window: int, first: int, end: int) -> Frame:
    """Windows of the last rows of each group when a group is hot: rows get their
    rank in the group, and the group is cut by rank with a copied halo."""
    x = ordered.running(fr.df, [F.col(k) for k in keys], {"__rank": ("count", F.lit(1))}, True)
    size = max(ordered.BLOCK, 8 * window)
    b = F.floor((F.col("__rank") - 1) / size)
    near = (F.col("__rank") - 1) % size >= size - window
    x = x.withColumn("__home", b).withColumn("__b", F.explode(F.when(near, F.array(b, b + 1)).otherwise(F.array(b))))
    w = Window.partitionBy("__b", *keys).orderBy("__rank").rowsBetween(first, end)
    x = x.withColumns({n: _windowed(fr, a, w) for n, a in names.items()}).where("__b = __home").drop("__b", "__home", "__rank")
    return _finish(fr, x, names, keys)


def _finish(fr: Frame, x, names: dict[str, aggs.Agg], keys: list[str]) -> Frame:
    new = {a.name: F.coalesce(F.col(n), F.lit(0)) if a.fn in ("count", "dc", "estdc_error") else F.col(n) for n, a in names.items()}
    y = fr.with_df(x)
    vis = [c for c in y.columns if not re.fullmatch(r"__(a\d+|g\d+|epoch)", c) and c not in new]
    out = y.select(*map(q, vis), *[c.alias(n) for n, c in new.items()])
    return out


def _running(fr: Frame, names: dict[str, aggs.Agg], keys: list[str], current: bool):
    parts: dict[str, tuple[str, Column]] = {}
    final: dict[str, Column] = {}
    df = fr.df
    for n, a in names.items():
        v = None
        if a.arg is not None:
            v = bind.expression(fr, a.arg) if a.is_eval else bind.field(fr, a.arg)
        if a.fn == "count":
            parts[n] = ("count", F.lit(1) if v is None else F.when(bind.as_bool(v), 1) if a.is_eval and v.is_bool else v.c)
            continue
        if v.is_null:  # type: ignore[union-attr]
            parts[n] = ("sum", F.lit(None).cast("double"))
            continue
        if a.fn == "estdc_error":
            parts |= {n + "e": ("count", F.lit(1))}
            final[n] = F.lit(0.0)
            continue
        if a.fn in ("first", "last"):
            parts[n + "o"] = ("min" if a.fn == "first" else "max", F.when(v.c.isNotNull(), F.struct(F.col(ordered.IDX).alias("i"), v.c.alias("v"))))  # type: ignore[union-attr]
            final[n] = F.col(n + "o")["v"]
            continue
        if a.fn == "dc":  # running count of first occurrences, which an aggregate finds and a join by row number marks
            f = df.select(*[F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)], as_str(v).alias("__q"), F.col(ordered.IDX).alias("__qi")).where("__q is not null")  # type: ignore[arg-type]
            f = f.groupBy("__q", *[f"__q{i}" for i in range(len(keys))]).agg(F.min("__qi").alias(ordered.IDX)).select(ordered.IDX, F.lit(1).alias(n + "f"))
            df = df.join(f, ordered.IDX, "left")
            parts[n + "d"] = ("count", F.col(n + "f"))
            final[n] = F.col(n + "d").cast("double")
            continue
        c = as_num(v)  # type: ignore[arg-type]
        if a.fn in ("sum", "min", "max"):
            parts[n] = (a.fn, c)
        elif a.fn in ("stdev", "var"):  # sums of distances from the mean of all rows, which keeps their digits
            df = df.join(F.broadcast(df.agg(F.avg(c).alias(n + "a")).limit(1)), F.lit(True), "left")
            d = c - F.col(n + "a")
            parts |= {n + "s": ("sum", d), n + "q": ("sum", d * d), n + "c": ("count", c)}
            k = F.col(n + "c")
            var = F.greatest(F.col(n + "q") - F.col(n + "s") * F.col(n + "s") / k, F.lit(0.0)) / (k - 1)
            final[n] = F.when(k < 2, 0.0).otherwise(var if a.fn == "var" else F.sqrt(var))
        elif a.fn == "avg":
            parts |= {n + "s": ("sum", c), n + "c": ("count", c)}
            final[n] = F.when(F.col(n + "c") > 0, F.col(n + "s") / F.col(n + "c"))
        else:
            parts |= {n + "x": ("max", c), n + "m": ("min", c)}
            final[n] = F.col(n + "x") - F.col(n + "m")
    x = ordered.running(df, [F.col(k) for k in keys], parts, current)
    return x.withColumns(final).drop(*[p for p in parts if p not in names], *[n + s for n in names for s in "fa"]) if final else x


def _epochs(fr: Frame, before: str | None, after: str | None, change: list[str]) -> Frame:
    """Adds ``__epoch``: how often the accumulators were reset up to each row."""
    flags: dict[str, Column] = {"__rb": bind.condition(fr, before).cast("int") if before else F.lit(0), "__ra": bind.condition(fr, after).cast("int") if after else F.lit(0)}
    x, _ = ordered.with_halo(fr.df.withColumns(flags), 1)
    w = Window.partitionBy("__b").orderBy(ordered.IDX)
    moved = F.lit(False)
    for k in change:
        moved = moved | ~F.lag(k).over(w).eqNullSafe(F.col(k))
    moved = F.when(F.lag(F.lit(1)).over(w).isNull(), 0).otherwise(moved.cast("int"))
    hit = F.greatest(F.col("__rb"), moved, F.coalesce(F.lag("__ra").over(w), F.lit(0)))
    x = x.withColumn("__hit", hit).where("__own").drop("__b", "__own", "__rb", "__ra")
    return fr.with_df(ordered.running(x, [], {"__epoch": ("sum", F.col("__hit"))}, True).drop("__hit"))


def _squares(a: Column, b: Column) -> Column:
    """Count and sum of squared distances from the mean, of two sets of values with ``n``, mean ``m`` and ``q`` each."""
    d = b["m"] - a["m"]
    apart = F.when((a["n"] > 0) & (b["n"] > 0), d * d * a["n"] * b["n"] / (a["n"] + b["n"])).otherwise(0.0)
    return F.struct((a["n"] + b["n"]).alias("n"), (F.coalesce(a["q"], F.lit(0.0)) + F.coalesce(b["q"], F.lit(0.0)) + apart).alias("q"))


def _state(kind: str, c: Column, w) -> Column:
    if kind != "squares":
        return getattr(F, kind)(c).over(w)
    n = F.count(c).over(w)
    return F.struct(n.alias("n"), F.avg(c).over(w).alias("m"), (F.var_pop(c).over(w) * n).alias("q"))


def _halves(fr: Frame, n: str, a: aggs.Agg) -> tuple[dict[str, tuple[str, Column]], Column]:
    """Small states of an aggregate that follow from those of two sets of rows (name -> kind, column), and its value from them."""
    v = None
    if a.arg is not None:
        v = bind.expression(fr, a.arg) if a.is_eval else bind.field(fr, a.arg)
    if v is not None and v.is_null and a.fn != "count":
        return {}, F.lit(None).cast("double")
    if a.fn == "estdc_error":
        return {}, F.lit(0.0)
    if a.fn == "count":
        return {n: ("count", F.lit(1) if v is None else F.when(as_bool(v), 1) if a.is_eval and v.is_bool else v.c)}, F.col(n)
    if a.fn in ("first", "last"):
        at = F.when(v.c.isNotNull(), F.struct(F.col(ordered.IDX).alias("i"), v.c.alias("v")))  # type: ignore[union-attr]
        return {n: ("min" if a.fn == "first" else "max", at)}, F.col(n)["v"]
    c = as_num(v)  # type: ignore[arg-type]
    if a.fn in ("min", "max"):
        if v.is_num:  # type: ignore[union-attr]
            return {n: (a.fn, c)}, F.col(n)
        if not v.is_str:  # type: ignore[union-attr]
            return {n: (a.fn, v.c)}, F.col(n)  # type: ignore[union-attr]
        return {n + "n": (a.fn, c), n + "t": (a.fn, as_str(v))}, F.coalesce(number_text(F.col(n + "n")), F.col(n + "t"))  # type: ignore[arg-type]
    if a.fn == "sum":
        return {n: ("sum", c)}, F.col(n)
    if a.fn == "avg":
        return {n + "s": ("sum", c), n + "c": ("count", c)}, F.when(F.col(n + "c") > 0, F.col(n + "s") / F.col(n + "c"))
    if a.fn == "range":
        return {n + "x": ("max", c), n + "m": ("min", c)}, F.col(n + "x") - F.col(n + "m")
    k = F.col(n)["n"]
    var = F.col(n)["q"] / (k - 1)
    return {n: ("squares", c)}, F.when(k < 2, 0.0).otherwise(var if a.fn == "var" else F.sqrt(var))


def _split(x: DataFrame, parts: dict[str, tuple[str, Column]], w) -> tuple[DataFrame, dict[str, tuple[str, Column]]]:
    """Summands become two each, a multiple of a unit and the rest: multiples sum up without error, rests are so small
    that theirs does not count.  The unit is as fine as the largest value and the number of rows of a piece allow;
    under a value that is larger by far, rests are the values themselves, and their sum is as good as any."""
    more, put, most = dict(parts), {}, {}
    for p, (kind, c) in parts.items():
        if kind != "sum":
            continue
        more[f"{p}_"] = ("sum", c)
        v = F.coalesce(F.col(f"__f{p}"), F.col(f"__b{p}"))
        size = F.abs(v)
        most[f"__m{p}"] = F.max(F.when(size < float("inf"), size)).over(w)
        bits = F.ceil(F.log2(F.nullif(F.col(f"__m{p}"), F.lit(0.0)))) + F.ceil(F.log2(F.col("__rows")))
        unit = F.pow(F.lit(2.0), F.greatest(bits - 50, F.lit(-1000)).cast("double"))
        for half in "fb":
            v = F.col(f"__{half}{p}")
            whole = F.rint(v / unit) * unit
            whole = F.when(F.abs(whole) < float("inf"), whole).otherwise(v)
            put |= {f"__{half}{p}": whole, f"__{half}{p}_": F.when(F.abs(v) < float("inf"), v - whole)}
    return (x.withColumns(most | {"__rows": F.count(F.lit(1)).over(w)}).withColumns(put) if put else x), more


def _by_time(fr: Frame, measures: list[aggs.Agg], keys: list[str], width: int) -> Frame:
    """Windows over event time: rows are cut by time into pieces of the width.

    A window is then the end of one piece and the beginning of the next: a running
    state from the back over the former and one from the front over the latter,
    so that each row is passed a fixed number of times however many a window holds.
    For that, rows also go to the next piece, moved on by the width."""
    if fr.time is None or not fr.order or fr.order[0][0] != TS:
        raise QueryError("time_window needs rows sorted by time")
    names = {f"__a{i}": a for i, a in enumerate(measures)}
    by_halves = {n: a for n, a in names.items() if a.fn in _MERGEABLE and a.fn != "dc"}
    t = -F.col(TS) if fr.order[0][1] else F.col(TS)
    df = fr.df
    if any(a.fn in ("first", "last") for a in by_halves.values()):
        df = ordered.numbered(fr).df
    if by_halves:
        halves = [_halves(fr, n, a) for n, a in by_halves.items()]
        parts = {p: kc for ps, _ in halves for p, kc in ps.items()}
        df = df.withColumns({f"__v{p}": c for p, (_, c) in parts.items()} | {"__t": t})
        known = F.when(F.col("__t").isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
        x = df.withColumn("__own", F.explode(known))
        own = F.col("__own")
        put = {c: F.when(own, q(c)) for c in fr.df.columns if c not in keys}
        put |= {f"__f{p}": F.when(own, F.col(f"__v{p}")) for p in parts} | {f"__b{p}": F.when(~own, F.col(f"__v{p}")) for p in parts}
        x = x.withColumns(put | {"__t": F.when(own, F.col("__t")).otherwise(F.col("__t") + width)})
        x = x.withColumn("__piece", F.floor(F.col("__t") / width)).repartition("__piece", *keys).sortWithinPartitions("__piece", *keys, "__t")
        w = Window.partitionBy("__piece", *keys)
        x, parts = _split(x, parts, w)
        front, back = (w.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("__t"), F.desc("__t")))
        x = x.withColumns({f"__f{p}": _state(k, F.col(f"__f{p}"), front) for p, (k, _) in parts.items()})
        x = x.withColumns({f"__b{p}": _state(k, F.col(f"__b{p}"), back) for p, (k, _) in parts.items()})
        both = ordered.BOTH | {"squares": _squares}
        x = x.where("__own").withColumns({p: both[k](F.col(f"__b{p}"), F.col(f"__f{p}")) for p, (k, _) in parts.items()})
        x = x.withColumns({p: F.col(p) + F.coalesce(F.col(f"{p}_"), F.lit(0.0)) for p in parts if f"{p}_" in parts})
        x = x.withColumns({n: c for n, (_, c) in zip(by_halves, halves)})
        df = x.select(*map(q, fr.df.columns), *by_halves)
    if len(by_halves) < len(names):  # sets of values and percentiles have no small state: each block with the width before it
        size = 8 * width
        b = F.floor(t / size)
        near = t - b * size >= size - width
        x = df.withColumn("__t", t).withColumn("__home", b).withColumn("__b", F.explode(F.when(near, F.array(b, b + 1)).otherwise(F.array(b))))
        w = Window.partitionBy("__b", *keys).orderBy("__t").rangeBetween(-width, 0)
        df = x.withColumns({n: _windowed(fr, a, w) for n, a in names.items() if n not in by_halves}).where("__b <=> __home").drop("__b", "__home", "__t")
    return _finish(fr, df, names, keys)


# ---- transaction ---------------------------------------------------------------------------------------
def _transaction_filter(fr: Frame, s: str) -> Column:
    s = s.strip()
    m = re.fullmatch(r"eval\s*\((.*)\)", s, re.S | re.I)
    if m:
        return bind.condition(fr, m[1])
    if s.startswith("(") and s.endswith(")"):
        s = s[1:-1]
    n = search.parse(s if not (s.startswith('"') and s.endswith('"') and "=" in s) else s[1:-1])
    return F.lit(True) if n is None else bind.clause(fr, n)


EVENTS_MOST = 2_000_000


def transaction(fr: Frame, s: str) -> Frame:
    """Groups of events per key that open at ``startswith`` and close at ``endswith``.

    Without ``endswith`` a transaction closes before the next ``startswith`` or
    with the last event; with it, transactions that never close are left out, before
    anything is gathered.  Expressed by running counts per key, so no Python state is kept.
    A transaction is one row with all its events: more than ``EVENTS_MOST`` raise an error."""
    conds: dict[str, Column] = {}
    for key in ("startswith", "endswith"):
        m = re.search(rf'\b{key}\s*=\s*(eval\s*\(|\(|"(?:[^"\\]|\\.)*"|[^\s(]+)', s, re.I)
        if not m:
            continue
        end = m.end()
        if m[1].endswith("("):
            depth = 1
            while depth:
                if end >= len(s):
                    raise QueryError(f"missing ) after {key}")
                depth += (s[end] == "(") - (s[end] == ")")
                end += 1
        conds[key] = _transaction_filter(fr, s[m.start(1) : end])
        s = s[: m.start()] + s[end:]
    keys = [bare(w) for w in words(s)] or ["timestamp"]
    if fr.time is None:
        raise QueryError("transaction needs event times")
    vals = [bind.field(fr, k) for k in keys]
    present = F.lit(False)
    for v in vals:
        present = present | v.c.isNotNull()
    names = [f"__k{i}" for i in range(len(keys))]
    df = fr.df.withColumns({n: v.c for n, v in zip(names, vals)}).where(present)
    start, end_ = conds.get("startswith", F.lit(True)), conds.get("endswith", F.lit(False))
    df = df.withColumns({"__st": F.coalesce(start, F.lit(False)), "__en": F.coalesce(end_, F.lit(False))})
    w = Window.partitionBy(*names).orderBy(*fr.sort_keys())
    part = ("__en", False) if "endswith" in conds else ("__st", True) if "startswith" in conds else None
    wide = ordered.hot(df, names)
    if part is not None and wide:  # running counts by blocks instead of one window a key
        fr = ordered.numbered(fr.with_df(df))
        df = ordered.running(fr.df, [F.col(n) for n in names], {"__seg": ("sum", F.col(part[0]).cast("int"))}, part[1]).withColumn("__seg", F.coalesce("__seg", F.lit(0)))
    elif part is not None:
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if part[1] else -1)
        df = df.withColumn("__seg", F.coalesce(F.sum(F.col(part[0]).cast("int")).over(frame), F.lit(0)))
    if "endswith" in conds:
        ends = df.groupBy(*names).agg(F.sum(F.col("__en").cast("int")).alias("__ends"))
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"{n}e"))
        df = df.join(ends.select(*[F.col(n).alias(f"{n}e") for n in names], "__ends"), same).where("__seg < __ends").drop("__ends", *[f"{n}e" for n in names])
        opened = F.max(F.col("__st").cast("int")).over(Window.partitionBy(*names, "__seg").orderBy(*fr.sort_keys()).rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("__open", opened).where("__open = 1")
    elif "startswith" in conds:
        df = df.where("__seg > 0")
    else:
        df = df.withColumn("__seg", F.lit(0))
    if wide and ordered.widest(df, [*names, "__seg"]) > EVENTS_MOST:
        raise QueryError(f"a transaction has more than {EVENTS_MOST} events")
    order = [(-F.col(c) if falls else F.col(c)) if dict(df.dtypes)[c] in ("bigint", "double", "int") else F.col(c) for c, falls in fr.order or ()]
    event = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(TS).alias("t"), F.to_json(F.struct(*map(q, fr.columns))).alias("e"))
    g = df.groupBy(*names, "__seg").agg(F.array_sort(F.collect_list(event)).alias("__e"), F.max(F.col("__en").cast("int")).alias("__closed"))
    if "endswith" in conds:
        g = g.where("__closed = 1")
    first, last = F.get(F.col("__e.t"), F.lit(0)), F.element_at("__e.t", -1)
    out = g.select(first.alias("timestamp"), F.abs(last - first).alias("duration"), F.size("__e").cast("bigint").alias("eventcount"), F.col("__e.e").alias("event"), *[F.col(n).alias(k) for n, k in zip(names, keys) if k != "timestamp"])
    out = out.withColumn(TS, F.col("timestamp"))
    return replace(fr, df=out, order=((TS, True),))
