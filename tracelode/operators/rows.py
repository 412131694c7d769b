"""Commands that work row by row: projections, filters, field makers."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.functions import scalar
from tracelode.functions import typing as ty
from tracelode.functions.typing import as_mv, as_num, as_str, column, q
from tracelode.lang import expr, lex, search, timespec
from tracelode.lang.lex import QueryError, bare, flag, options, words
from tracelode.plans import bind
from tracelode.plans.frame import TS, Frame


def expand(fr: Frame, pats: list[str]) -> list[str]:
    """Field names that match; a name without wildcard stands for itself if it exists."""
    out: list[str] = []
    for p in pats:
        hits = [c for c in fr.columns if fnmatch.fnmatchcase(c, p)] if "*" in p else [p] if p in fr.columns else []
        out += [c for c in hits if c not in out]
    return out


def search_cmd(fr: Frame, s: str, case: bool = False) -> Frame:
    n = search.parse(s)
    return fr if n is None else fr.with_df(fr.df.where(bind.clause(fr, n, case)))


def where(fr: Frame, s: str) -> Frame:
    return fr.with_df(fr.df.where(bind.filter_condition(fr, expr.parse(s))))


def regex(fr: Frame, s: str) -> Frame:
    m = re.fullmatch(r'(?:([^\s=!"]+)\s*(!?=)\s*)?"((?:[^"\\]|\\.)*)"', s.strip(), re.S)
    if not m:
        raise QueryError(f'regex takes [field=]"pattern": {s!r}')
    pat = scalar.java_regex(lex.unescape(m[3]))
    if m[1]:
        v = column(fr.df, m[1])
        hit = F.coalesce(as_str(v).rlike(pat), F.lit(False)) if v is not None else F.lit(False)
        present = v.c.isNotNull() if v is not None else F.lit(False)
        return fr.with_df(fr.df.where(hit if m[2] == "=" else ~hit & present))
    out: Column | None = None
    for c in fr.columns:
        one = F.coalesce(as_str(column(fr.df, c)).rlike(pat), F.lit(False))  # type: ignore[arg-type]
        out = one if out is None else out | one
    return fr.with_df(fr.df.where(F.lit(False) if out is None else out))


def fields(fr: Frame, s: str) -> Frame:
    m = re.match(r"\s*([+-])?\s*(.*)", s, re.S)
    names = [bare(w) for w in words(m[2])]  # type: ignore[index]
    hit = expand(fr, names)
    if m[1] == "-":  # type: ignore[index]
        return fr.select(*[q(c) for c in fr.columns if c not in hit])
    keep = (["timestamp"] if "timestamp" in fr.columns and "timestamp" not in hit else []) + hit
    return fr.select(*map(q, keep))


def table(fr: Frame, s: str) -> Frame:
    return fr.select(*map(q, expand(fr, [bare(w) for w in words(s)])))


def rename(fr: Frame, s: str) -> Frame:
    pairs = re.findall(r'("(?:[^"\\]|\\.)*"|[^\s,]+)\s+[aA][sS]\s+("(?:[^"\\]|\\.)*"|[^\s,]+)', s)
    if not pairs:
        raise QueryError(f"rename takes a AS b: {s!r}")
    for a, b in pairs:
        a, b = bare(a), bare(b)
        new: dict[str, str] = {}
        if "*" in a:
            if a.count("*") != b.count("*"):
                raise QueryError(f"wildcards differ: {a} AS {b}")
            pat = re.compile("".join("(.*)" if ch == "*" else re.escape(ch) for ch in a))
            for c in fr.columns:
                if m := pat.fullmatch(c):
                    parts = iter(m.groups())
                    new[c] = "".join(next(parts) if ch == "*" else ch for ch in b)
        elif a in fr.columns:
            new[a] = b
        taken = set(new.values())
        fr = fr.select(*[q(c).alias(new.get(c, c)) for c in fr.columns if c in new or c not in taken])
    return fr


def eval_cmd(fr: Frame, s: str) -> Frame:
    for part in lex.cut(s, ","):
        m = re.match(r"""\s*("(?:[^"\\]|\\.)*"|'[^']*'|[^\s=]+)\s*=(?!=)\s*(.*)""", part, re.S)
        if not m or not m[2].strip():
            raise QueryError(f"eval takes name=expression: {part!r}")
        v = bind.expression(fr, m[2])
        c = v.c.cast("string") if v.is_null else v.c
        fr = fr.put({m[1].strip("\"'"): c})
    return fr


def group_names(pat: str) -> list[tuple[str, int]]:
    """Named groups and their numbers."""
    out, n, i = [], 0, 0
    in_class = False
    while i < len(pat):
        ch = pat[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pat[i:])
            if m or pat[i + 1 : i + 2] != "?":
                n += 1
                if m:
                    out.append((m[1], n))
        i += 1
    return out


def rex(fr: Frame, s: str) -> Frame:
    m = re.fullmatch(r'\s*(?:field\s*=\s*("[^"]*"|\S+)\s+)?"((?:[^"\\]|\\.)*)"\s*', s, re.S)
    if not m:
        raise QueryError(f'rex takes field=name "pattern": {s!r}')
    name = bare(m[1]) if m[1] else "_raw"
    v = column(fr.df, name)
    pat = lex.unescape(m[2])
    named = group_names(pat)
    if not named:
        raise QueryError("rex needs a named group")
    if v is None:
        return fr.put({g: F.lit(None).cast("string") for g, _ in named})
    java = scalar.java_regex(pat)
    hit = as_str(v).rlike(java)
    return fr.put({g: F.when(hit, F.regexp_extract(as_str(v), java, i)) for g, i in named})


def fillnull(fr: Frame, s: str) -> Frame:
    opts, rest = options(words(s), {"value": None})
    val = opts.get("value", "0")
    names = [bare(w) for w in rest] or fr.columns
    new: dict[str, Column] = {}
    for c in names:
        v = column(fr.df, c)
        if v is None:
            new[c] = F.lit(val)
        elif v.is_num and ty.is_numeric_text(val):
            new[c] = F.coalesce(v.c, F.lit(float(val)).cast(v.t))
        elif v.is_mv:
            new[c] = F.coalesce(as_mv(v), F.array(F.lit(val)))
        else:
            new[c] = F.coalesce(as_str(v), F.lit(val))
    return fr.put(new)


def makemv(fr: Frame, s: str) -> Frame:
    opts, rest = options(words(s), {"delim": None, "tokenizer": None, "allowempty": None, "setsv": None})
    if len(rest) != 1:
        raise QueryError("makemv takes one field")
    name = bare(rest[0])
    v = column(fr.df, name)
    if v is None:
        return fr
    empty = flag(opts.get("allowempty"), False)
    if "tokenizer" in opts:
        arr = F.regexp_extract_all(as_str(v), F.lit(scalar.java_regex(opts["tokenizer"])), F.lit(1))
    else:
        arr = F.split(as_str(v), re.escape(opts.get("delim", " ")), -1)
    if not empty:
        arr = F.filter(arr, lambda x: x != "")
    return fr.put({name: F.array_join(arr, " ") if flag(opts.get("setsv"), False) else arr})


def mvexpand(fr: Frame, s: str) -> Frame:
    opts, rest = options(words(s), {"limit": None})
    if len(rest) != 1:
        raise QueryError("mvexpand takes one field")
    name = bare(rest[0])
    v = column(fr.df, name)
    if v is None or not v.is_mv:
        raise QueryError(f"{name} is no multivalue field")
    n = int(opts.get("limit", 0))
    arr = F.slice(v.c, 1, n) if n > 0 else v.c
    cols = [F.col("__x_v").alias(name) if c == name else q(c) for c in fr.columns]
    df = fr.df.select("*", F.posexplode_outer(arr).alias("__o_mv", "__x_v"))
    out = df.select(*cols, *map(F.col, fr.hidden), "__o_mv")
    if fr.order is None:
        return fr.with_df(out.drop("__o_mv"))
    tag = f"__o_mv{len(fr.order)}"
    return fr.with_df(out.withColumnRenamed("__o_mv", tag), order=(*fr.order, (tag, False)))


def spath(fr: Frame, s: str) -> Frame:
    opts, rest = options(words(s), {"input": None, "output": None, "path": None})
    path = opts.get("path") or (bare(rest[0]) if rest else None)
    v = column(fr.df, opts.get("input", "_raw"))
    if path is None:
        return _spath_all(fr, v)
    out = opts.get("output", path)
    if v is None:
        return fr.put({out: F.lit(None).cast("string")})
    return fr.put({out: scalar.call(scalar.Ctx(fr.df, fr.now), "spath", [v, ty.lit(path)]).c})


def _spath_all(fr: Frame, v: ty.Val | None) -> Frame:
    """All fields of a JSON document as columns with dotted names.  Which there are is found in one pass over
    the documents, in the JVM, as for any JSON source; columns of equal names are replaced."""
    if v is None:
        return fr
    spark = fr.df.sparkSession
    texts = getattr(fr.df.select(as_str(v))._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    schema = DataFrame(spark._jsparkSession.read().json(texts), spark).schema
    schema = T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])
    cols: dict[str, Column] = {}

    def walk(c: Column, t: T.DataType, name: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(c[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)
        elif isinstance(t, T.ArrayType):
            one = (lambda x: F.to_json(x)) if isinstance(t.elementType, (T.StructType, T.ArrayType)) else (lambda x: x.cast("string"))
            cols[name + "{}"] = F.transform(c, one)
        else:
            cols[name] = c

    walk(F.from_json(as_str(v), schema), schema, "")
    return fr.put(cols) if cols else fr


def _quoted(t: Column) -> Column:
    """A text as JSON string: the one element of a JSON array, without its brackets."""
    a = F.to_json(F.array(t))
    return F.try_parse_json(F.substr(a, F.lit(2), F.length(a) - 2))


def tojson(fr: Frame, s: str) -> Frame:
    opts, rest = options(words(s), {"default_type": None, "fill_null": None, "include_internal": None, "output_field": None})
    default = opts.get("default_type", "auto")
    chosen: dict[str, str] = {}
    for w in rest:
        m = re.fullmatch(r"(auto|bool|json|num|str|none)\((.*)\)", w)
        for c in expand(fr, [bare(m[2]) if m else bare(w)]):
            chosen[c] = m[1] if m else default
    if not rest:
        chosen = {c: default for c in fr.columns if flag(opts.get("include_internal"), False) or not c.startswith("_")}
    parts = []
    for c, kind in chosen.items():
        v = column(fr.df, c)
        assert v is not None
        t = as_str(v)
        if kind == "num":
            col = v.c if v.is_num else as_num(v)
        elif kind == "bool":
            col = F.when(F.lower(t).isin("true", "t", "yes", "1"), True).when(F.lower(t).isin("false", "f", "no", "0"), False)
        elif kind == "str":
            col = t
        elif kind == "json":
            col = F.try_parse_json(t)
        elif kind == "auto" and v.is_str:
            col = F.coalesce(F.try_parse_json(t), _quoted(t))
        else:
            col = v.c
        parts.append(col.alias(c))
    keep = {"ignoreNullFields": str(not flag(opts.get("fill_null"), False)).lower()}
    return fr.put({opts.get("output_field", "_raw"): F.to_json(F.struct(*parts), keep) if parts else F.lit("{}")})


# ---- bin ---------------------------------------------------------------------------------------
def _edge(c: Column) -> Column:
    return ty.number_text(c)


def _time_floor(ms: Column, n: float, unit: str, align: int | None) -> Column:
    """Bucket start in ms: sub-day spans from the epoch (or ``align``), weeks of days, calendar months."""
    if unit in ("mon", "q", "y"):
        step = int(n * {"mon": 1, "q": 3, "y": 12}[unit])
        t = F.timestamp_micros(ms * 1000)
        k = (F.year(t) - 1970) * 12 + F.month(t) - 1
        k = F.floor(k / step) * step
        return F.unix_date(F.make_date((1970 + F.floor(k / 12)).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int"), F.lit(1))).cast("bigint") * 86_400_000
    w = int(n * timespec.MS[unit])
    a = align or 0
    return (F.floor((ms - a) / w) * w + a).cast("bigint")


def bin_cmd(fr: Frame, s: str) -> Frame:
    m = re.match(r'(.*?)(?:\s+[aA][sS]\s+("[^"]*"|\S+))?\s*$', s, re.S)
    opts, rest = options(words(m[1]), {"span": None, "minspan": None, "bins": None, "start": None, "end": None, "aligntime": None})  # type: ignore[index]
    if len(rest) != 1:
        raise QueryError("bin takes one field")
    name = bare(rest[0])
    out = bare(m[2]) if m[2] else name  # type: ignore[index]
    v = bind.field(fr, name)
    if v.is_null:
        return fr.put({out: F.lit(None).cast("string")})
    is_time = name in ("timestamp", "_time") or isinstance(v.t, (T.TimestampType, T.TimestampNTZType))
    c = as_num(v) if not (is_time and fr.time is not None and isinstance(v.t, (T.TimestampType, T.TimestampNTZType))) else _event_ms(fr, v)
    span = opts.get("span")
    if is_time:
        c = c.cast("bigint")
        if span is None:
            lo, hi = _bounds(fr, c)
            span = _time_span(lo, hi, int(opts.get("bins", 100)))
        n, unit = timespec.span(span)
        align = None
        if "aligntime" in opts:
            align = fr.start_ms if opts["aligntime"] == "earliest" else fr.end_ms if opts["aligntime"] == "latest" else timespec.resolve(opts["aligntime"], fr.now)
        return fr.put({out: _time_floor(c, n, unit or "s", align)})
    if span is None:
        lo, hi = _bounds(fr, c, opts)
        width = _number_span(lo, hi, int(opts.get("bins", 100)), opts)
        return fr.put({out: _number_bin(c, width)})
    lm = re.fullmatch(r"(\d+(?:\.\d+)?)?log(\d+(?:\.\d+)?)?", span)
    if lm:
        coef, base = float(lm[1] or 1), float(lm[2] or 10)
        k = F.ln(c / coef) / F.ln(F.lit(base))
        lo_k = F.floor(k + 1e-12)
        hi_k = F.when(F.ceil(k - 1e-12) == lo_k, lo_k + 1).otherwise(F.ceil(k - 1e-12))
        label = F.concat(_edge(coef * F.pow(F.lit(base), lo_k)), F.lit("-"), _edge(coef * F.pow(F.lit(base), hi_k)))
        return fr.put({out: F.when(c <= 0, as_str(v)).otherwise(label)})
    n, unit = timespec.span(span)
    if unit is not None:
        return fr.put({out: F.floor(c / n) * n})
    return fr.put({out: _number_bin(c, n)})


def _event_ms(fr: Frame, v: ty.Val) -> Column:
    return F.col(TS)


def _number_bin(c: Column, width: float) -> Column:
    lo = F.floor(c / width) * width
    hi = F.ceil(c / width) * width
    hi = F.when(hi == lo, hi + width).otherwise(hi)
    return F.when(c.isNotNull(), F.concat(_edge(lo.cast("double")), F.lit("-"), _edge(hi.cast("double"))))


def _bounds(fr: Frame, c: Column, opts: dict[str, str] | None = None) -> tuple[float | None, float | None]:
    """The one pass over the data that a width of the engine's choice needs: a two-number aggregate."""
    r = fr.df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if opts and "start" in opts and lo is not None:
        lo = min(lo, float(opts["start"]))
    if opts and "end" in opts and hi is not None:
        hi = max(hi, float(opts["end"]))
    return lo, hi


def _number_span(lo: float | None, hi: float | None, bins: int, opts: dict[str, str]) -> float:
    if lo is None or hi is None or hi <= lo:
        return max(1.0, float(opts.get("minspan", 1)))
    width = 1e-10
    while (hi - lo) / width > bins or width < float(opts.get("minspan", 0)):
        width *= 10
    return round(width, 10) if width < 1 else float(round(width))


def _time_span(lo: float | None, hi: float | None, bins: int) -> str:
    ladder = ["1s", "10s", "30s", "1m", "5m", "10m", "30m", "1h", "1d"]
    for s in ladder:
        if lo is None or hi is None or (hi - lo) / timespec.span_ms(s) <= bins:
            return s
    return "1mon"
