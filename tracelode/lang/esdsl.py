"""JSON search DSL: query clauses to predicates, aggs to groupings."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.functions.typing import Val, as_num, as_str, compare, lit, q
from tracelode.lang import search, timespec
from tracelode.lang.lex import QueryError
from tracelode.plans import bind
from tracelode.plans.frame import TS, Frame
from tracelode.session import cut

if TYPE_CHECKING:
    from tracelode.plans.engine import Engine

# Calendar units of this dialect in days (a month is 4 weeks here).
INTERVAL_DAYS = {"w": 7, "M": 28, "q": 84, "y": 336}
TERMS_SIZE = 10_000


def _one(d: dict) -> tuple[str, object]:
    if len(d) != 1:
        raise QueryError(f"exactly one key expected in {sorted(d)}")
    return next(iter(d.items()))


def _same(fr: Frame, field: str, v: object, op: str = "=") -> Column:
    x = bind.field(fr, field)
    return F.lit(False) if x.is_null else compare(x, op, lit(v))


def _text(fr: Frame, field: str) -> Column:
    return as_str(bind.field(fr, field)) if field not in ("*", "_all") else F.concat_ws(" ", *[as_str(Val(q(f.name), f.dataType)) for f in fr.df.schema.fields if not f.name.startswith("__o") and isinstance(f.dataType, T.StringType)])


def _words(c: Column, text: str, every: bool, phrase: bool = False) -> Column:
    parts = [text] if phrase else text.split()
    out: Column | None = None
    for w in parts:
        pat = r"(?i)(?<![A-Za-z0-9_])" + r"\s+".join(map(re.escape, w.split())) + r"(?![A-Za-z0-9_])"
        one = F.coalesce(c.rlike(pat), F.lit(False))
        out = one if out is None else (out & one if every else out | one)
    return F.lit(True) if out is None else out


def _all(cs: list[Column], any_: bool = False) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c if any_ else out & c
    return out


def predicate(fr: Frame, body: dict) -> Column:
    kind, spec = _one(body)
    many = lambda v: v if isinstance(v, list) else [v]
    if kind == "match_all":
        return F.lit(True)
    if kind == "match_none":
        return F.lit(False)
    if kind == "bool":
        parts: list[Column] = []
        for k in ("must", "filter"):
            parts += [predicate(fr, b) for b in many(spec.get(k, []))]
        parts += [~F.coalesce(predicate(fr, b), F.lit(False)) for b in many(spec.get("must_not", []))]
        should = [predicate(fr, b) for b in many(spec.get("should", []))]
        least = int(spec.get("minimum_should_match", 0 if parts else 1)) if should else 0
        if should and least == 1:
            parts.append(_all(should, True))
        elif should and least > 1:
            total = F.lit(0)
            for s in should:
                total = total + F.coalesce(s, F.lit(False)).cast("int")
            parts.append(total >= least)
        return _all(parts) if parts else F.lit(True)
    if kind == "constant_score":
        return predicate(fr, spec["filter"])
    if kind == "exists":
        x = bind.field(fr, spec["field"])
        return F.lit(False) if x.is_null else x.c.isNotNull()
    if kind in ("query_string", "simple_query_string"):
        text = spec["query"]
        fields = spec.get("fields") or ([spec["default_field"]] if "default_field" in spec else [])
        return _query_string(fr, text, fields, spec.get("default_operator", "OR").upper())
    if kind == "multi_match":
        every = spec.get("operator", "or").lower() == "and"
        return _all([_words(_text(fr, f), str(spec["query"]), every, spec.get("type") == "phrase") for f in spec.get("fields", ["*"])], True)
    if kind == "nested":
        return _nested(fr, spec["path"], spec["query"])
    field, arg = _one({k: v for k, v in spec.items() if k != "boost"})
    if kind == "term":
        return _same(fr, field, arg["value"] if isinstance(arg, dict) else arg)
    if kind == "terms":
        return _all([_same(fr, field, v) for v in arg], True) if arg else F.lit(False)
    if kind == "range":
        return _range(fr, field, arg)
    if kind in ("match", "match_phrase"):
        d = arg if isinstance(arg, dict) else {"query": arg}
        v = bind.field(fr, field)
        if v.is_num and isinstance(d["query"], (int, float)):
            return _same(fr, field, d["query"])
        return _words(_text(fr, field), str(d["query"]), d.get("operator", "or").lower() == "and", kind == "match_phrase")
    value = arg["value"] if isinstance(arg, dict) else arg
    t = _text(fr, field)
    if kind == "prefix":
        return F.coalesce(F.startswith(t, F.lit(str(value))), F.lit(False))
    if kind == "regexp":
        return F.coalesce(t.rlike("^(?:" + value + ")$"), F.lit(False))
    if kind == "wildcard":
        pat = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in str(value))
        return F.coalesce(t.rlike("(?s)^" + pat + "$"), F.lit(False))
    raise QueryError(f"unknown clause {kind}")


def _range(fr: Frame, field: str, arg: dict) -> Column:
    names = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "from": ">=" if arg.get("include_lower", True) else ">", "to": "<=" if arg.get("include_upper", True) else "<"}
    out: list[Column] = []
    v = bind.field(fr, field)
    timed = isinstance(v.t, (T.TimestampType, T.TimestampNTZType)) or field in ("timestamp", "_time")
    for k, op in names.items():
        if arg.get(k) is None:
            continue
        b = arg[k]
        if timed and isinstance(b, str):
            b = timespec.resolve(re.sub(r"\|\|?/?|/(\w)$", r"@\1", b) if "/" in b and b.startswith("now") else b, fr.now) if not re.match(r"\d{4}-", b) else _iso_ms(b)
        x = Val(F.col(TS), T.LongType()) if timed and TS in fr.df.columns else v
        out.append(compare(x, op, lit(b)))
    return _all(out) if out else F.lit(True)


def _iso_ms(s: str) -> int:
    import datetime as dt

    d = dt.datetime.fromisoformat(s.replace("Z", "+00:00"))
    return int((d if d.tzinfo else d.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000)


def _query_string(fr: Frame, text: str, fields: list[str], default: str) -> Column:
    """``a:b AND (c OR "d e") NOT f*``: rewritten to the search clause, fields for bare words."""
    s = re.sub(r'([\w.@-]+):\s*(>=|<=|>|<)?', lambda m: m[1] + (m[2] or "="), text)
    s = re.sub(r"(?<=[\w\")])\s+(?=[\w\"(*])(?!AND\b|OR\b|NOT\b)(?<!AND )(?<!OR )(?<!NOT )", f" {default} ", s) if default == "OR" else s
    n = search.parse(s)
    if n is None:
        return F.lit(True)
    return _bound(fr, n, fields)


def _bound(fr: Frame, n: object, fields: list[str]) -> Column:
    if isinstance(n, search.And):
        return _all([_bound(fr, p, fields) for p in n.parts])
    if isinstance(n, search.Or):
        return _all([_bound(fr, p, fields) for p in n.parts], True)
    if isinstance(n, search.Not):
        return ~_bound(fr, n.part, fields)
    if isinstance(n, search.Term) and fields and fields != ["*"]:
        if "*" in n.text:
            return _all([F.coalesce(_text(fr, f).rlike(r"(?i)(?<![A-Za-z0-9_])" + bind.glob(n.text).replace(".*", r"\S*")), F.lit(False)) for f in fields], True)
        return _all([_words(_text(fr, f), n.text, True, n.phrase) for f in fields], True)
    return bind.clause(fr, n)


def _nested(fr: Frame, path: str, query: dict) -> Column:
    """True if one element of an array of structs meets the query by itself."""
    v = bind.field(fr, path)
    if not v.is_mv or not isinstance(v.t.elementType, T.StructType):  # type: ignore[attr-defined]
        return F.lit(False)
    el = v.t.elementType  # type: ignore[attr-defined]

    def test(x: Column, b: dict) -> Column:
        kind, spec = _one(b)
        many = lambda y: y if isinstance(y, list) else [y]
        if kind == "bool":
            ps = [test(x, c) for k in ("must", "filter") for c in many(spec.get(k, []))] + [~test(x, c) for c in many(spec.get("must_not", []))]
            sh = [test(x, c) for c in many(spec.get("should", []))]
            ps += [_all(sh, True)] if sh else []
            return _all(ps) if ps else F.lit(True)
        if kind == "match_all":
            return F.lit(True)
        field, arg = (spec["field"], None) if kind == "exists" else _one(spec)
        name = field.removeprefix(path + ".")
        if name not in el.fieldNames():
            return F.lit(False)
        f = Val(x[name], el[name].dataType)
        if kind == "exists":
            return f.c.isNotNull()
        if kind == "terms":
            return _all([F.coalesce(compare(f, "=", lit(v)), F.lit(False)) for v in arg], True) if arg else F.lit(False)
        if kind in ("prefix", "wildcard"):
            text = str(arg["value"] if isinstance(arg, dict) else arg)
            hit = as_str(f).startswith(text) if kind == "prefix" else as_str(f).rlike("^" + "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in text) + "$")
            return F.coalesce(hit, F.lit(False))
        if kind == "range":
            return _all([F.coalesce(compare(f, {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[k], lit(b2)), F.lit(False)) for k, b2 in arg.items()])
        if kind in ("match", "match_phrase"):
            return _words(as_str(f), str(arg["query"] if isinstance(arg, dict) else arg), False, kind == "match_phrase")
        if kind == "term":
            return F.coalesce(compare(f, "=", lit(arg["value"] if isinstance(arg, dict) else arg)), F.lit(False))
        raise QueryError(f"nested has no {kind}")

    return F.coalesce(F.exists(v.c, lambda x: test(x, query)), F.lit(False))


_METRICS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def _interval(spec: dict) -> int:
    s = str(spec.get("fixed_interval") or spec.get("calendar_interval") or spec.get("interval"))
    m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", s)
    if not m:
        raise QueryError(f"no interval {s!r}")
    names = {"minute": "m", "hour": "h", "day": "d", "week": "w", "month": "M", "quarter": "q", "year": "y", "second": "s"}
    u = names.get(m[2], m[2])
    n = int(m[1] or 1)
    return n * INTERVAL_DAYS[u] * 86_400_000 if u in INTERVAL_DAYS else timespec.span_ms(f"{n}{u}")


def aggregate(fr: Frame, aggs: dict) -> Frame:
    """Nested bucket aggregations as one grouping by all their keys; metrics at the innermost level."""
    keys: list[tuple[str, Column]] = []
    metrics: list[Column] = []
    size: int | None = None

    def walk(level: dict) -> None:
        nonlocal size
        for name, body in level.items():
            kinds = {k: v for k, v in body.items() if k not in ("aggs", "aggregations")}
            kind, spec = _one(kinds)
            if kind == "terms":
                v = bind.field(fr, spec["field"])
                keys.append((name, v.c))
                size = int(spec.get("size", TERMS_SIZE)) if size is None else size
            elif kind == "date_histogram":
                w = _interval(spec)
                t = F.col(TS) if TS in fr.df.columns else as_num(bind.field(fr, spec["field"]))
                keys.append((name, (F.floor(t / w) * w).cast("bigint")))
            elif kind in _METRICS:
                metrics.append(_METRICS[kind](as_num(bind.field(fr, spec["field"]))).alias(name))
            elif kind == "cardinality":
                c = bind.field(fr, spec["field"]).c
                metrics.append((F.count_distinct(c) if fr.exact else F.approx_count_distinct(c, 0.01)).alias(name))
            elif kind in ("value_count", "count"):
                metrics.append(F.count(bind.field(fr, spec["field"]).c).alias(name))
            else:
                raise QueryError(f"unknown aggregation {kind}")
            walk(body.get("aggs") or body.get("aggregations") or {})

    walk(aggs)
    df = fr.df.groupBy(*[c.alias(n) for n, c in keys]).agg(F.count(F.lit(1)).alias("doc_count"), *metrics)
    if size is not None:
        df = df.orderBy(F.desc("doc_count"), *[q(n) for n, _ in keys]).limit(size)
    return fr.with_df(df, order=None)


def run(engine: "Engine", body: dict, index: str) -> DataFrame:
    fr = engine.frame(index)
    if body.get("query"):
        fr = fr.with_df(fr.df.where(predicate(fr, body["query"])))
    aggs = body.get("aggs") or body.get("aggregations")
    if aggs:
        return aggregate(fr, aggs).result()
    df = fr.df
    sort = body.get("sort")
    if sort:
        if isinstance(sort, list) and len(sort) > 1:
            raise QueryError("exactly one sort key")
        s = sort[0] if isinstance(sort, list) else sort
        field, how = _one(s) if isinstance(s, dict) else (s, "asc")
        falls = (how.get("order") if isinstance(how, dict) else how) == "desc"
        c = bind.field(fr, field).c
        df = df.orderBy(c.desc_nulls_last() if falls else c.asc_nulls_last(), *fr.sort_keys() if fr.order else [])
    elif fr.order:
        df = df.orderBy(*fr.sort_keys())
    if body.get("from"):
        df = df.offset(int(body["from"]))
    if "size" in body:
        df = df.limit(int(body["size"]))
    return df.select(*map(q, fr.columns))


def open_scroll(engine: "Engine", body: dict, index: str) -> DataFrame:
    """A cursor over the whole ordered result: it is computed once, and rows get numbers that rise in its order."""
    df = run(engine, {k: v for k, v in body.items() if k not in ("from", "size")}, index)
    return cut(df.withColumn("_scroll", F.monotonically_increasing_id()), "scroll")


def scroll_page(cursor: DataFrame, after: int = -1, size: int = 10) -> DataFrame:
    """The next rows behind the number of the last row seen."""
    return cursor.where(F.col("_scroll") > after).orderBy("_scroll").limit(size)


def by_id(engine: "Engine", index: str, ids: list[str], id_column: str = "_id") -> DataFrame:
    df, _, _ = engine.catalog.resolve(index)
    return df.where(q(id_column).cast("string").isin(ids))
