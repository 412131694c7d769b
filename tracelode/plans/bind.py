"""Parsed clauses to columns of a frame."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode.functions import scalar
from tracelode.functions import typing as ty
from tracelode.functions.typing import Val, as_bool, as_num, as_str, boolean, column, compare, is_numeric_text, mv, num, text
from tracelode.lang import expr as E
from tracelode.lang import search as S
from tracelode.lang import timespec
from tracelode.lang.lex import QueryError
from tracelode.plans.frame import Frame


# ---- eval expressions ----------------------------------------------------------------------------
def value(fr: Frame, n: E.Node, local: dict[str, Val] | None = None) -> Val:
    if isinstance(n, E.Lit):
        return ty.lit(n.value)
    if isinstance(n, E.Field):
        return field(fr, n.name, local)
    if isinstance(n, E.Call):
        return _call(fr, n, local)
    args = n.args
    if n.op == "and":
        return boolean(as_bool(value(fr, args[0], local)) & as_bool(value(fr, args[1], local)))
    if n.op == "or":
        return boolean(as_bool(value(fr, args[0], local)) | as_bool(value(fr, args[1], local)))
    if n.op == "not":
        return boolean(~as_bool(value(fr, args[0], local)))
    if n.op == "neg":
        v = value(fr, args[0], local)
        return ty.lit(-v.lit) if isinstance(v.lit, (int, float)) else num(-as_num(v))
    a, b = value(fr, args[0], local), value(fr, args[1], local)
    if n.op in ("=", "!=", "<", "<=", ">", ">="):
        return boolean(compare(a, n.op, b))
    if n.op == "." or (n.op == "+" and _textual(a, b)):
        return text(F.concat(as_str(a), as_str(b)))
    x, y = as_num(a), as_num(b)
    if n.op in ("/", "%"):
        return num(F.when(y != 0, x / y if n.op == "/" else x % y))
    return num({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[n.op]())


def _textual(a: Val, b: Val) -> bool:
    """``+`` joins texts: both sides are texts and a literal among them is no number."""
    if not (a.is_str and b.is_str):
        return False
    return all(v.lit is None or not is_numeric_text(str(v.lit)) for v in (a, b))


def field(fr: Frame, name: str, local: dict[str, Val] | None = None) -> Val:
    if local and name in local:
        return local[name]
    v = column(fr.df, name)
    if v is not None:
        return v
    if name == "_time" and fr.time is not None:
        return num(fr.time.cast("double"))
    if name in ("timestamp", "_timestamp") and fr.time is not None:
        return num(fr.time.cast("double"))
    parts = name.split(".")
    if len(parts) > 1:  # a.b: a nested field, else the texts of a and b joined
        head = column(fr.df, parts[0])
        if head is not None and isinstance(head.t, ty.T.StructType):
            c, t = head.c, head.t
            for p in parts[1:]:
                if not isinstance(t, ty.T.StructType) or p not in t.fieldNames():
                    return ty.lit(None)
                c, t = c[p], t[p].dataType
            return Val(c, t)
        vals = [column(fr.df, p) for p in parts]
        if all(v is not None for v in vals):
            return text(F.concat(*[as_str(v) for v in vals]))  # type: ignore[arg-type]
    return ty.lit(None)


def _call(fr: Frame, n: E.Call, local: dict[str, Val] | None) -> Val:
    ctx = scalar.Ctx(fr.df, fr.now)
    if n.name == "searchmatch":
        s = n.args[0]
        if not isinstance(s, E.Lit):
            raise QueryError("searchmatch takes a literal")
        node = S.parse(str(s.value))
        return boolean(F.lit(True) if node is None else clause(fr, node))
    if n.name == "sigfig":
        if len(n.args) != 1:
            raise QueryError("sigfig takes one expression")
        leaves: list[Column] = []
        return num(scalar.sigfig(_arithmetic(fr, n.args[0], local, leaves), leaves))
    if n.name in ("mvfilter", "mvmap"):
        names = _fields(n.args[0] if n.name == "mvfilter" else n.args[1])
        if n.name == "mvfilter" and len(names) != 1:
            raise QueryError("mvfilter takes a condition on one field")
        name = n.args[0].name if n.name == "mvmap" and isinstance(n.args[0], E.Field) else next(iter(names))
        arr = ty.as_mv(field(fr, name, local))
        if n.name == "mvfilter":
            return mv(F.filter(arr, lambda x: as_bool(value(fr, n.args[0], {**(local or {}), name: text(x)}))))
        return mv(F.transform(arr, lambda x: as_str(value(fr, n.args[1], {**(local or {}), name: text(x)}))))
    return scalar.call(ctx, n.name, [value(fr, a, local) for a in n.args])


def _arithmetic(fr: Frame, n: E.Node, local: dict[str, Val] | None, leaves: list[Column]) -> object:
    """``(op, left, right)`` trees over numbers of leaves; literals keep their spelling."""
    if isinstance(n, E.Op) and n.op in ("+", "-", "*", "/"):
        return (n.op, *[_arithmetic(fr, a, local, leaves) for a in n.args])
    leaves.append(F.lit(n.raw) if isinstance(n, E.Lit) and n.raw is not None else as_str(value(fr, n, local)))
    return len(leaves) - 1


def _fields(n: E.Node) -> set[str]:
    if isinstance(n, E.Field):
        return {n.name}
    return set().union(*map(_fields, n.args)) if isinstance(n, (E.Call, E.Op)) and n.args else set()


def expression(fr: Frame, s: str) -> Val:
    return value(fr, E.parse(s))


def condition(fr: Frame, s: str) -> Column:
    return as_bool(expression(fr, s))


def filter_condition(fr: Frame, n: E.Node) -> Column:
    """Like :func:`condition` for a filter: where no NOT is above, NULL is as good as
    false, and bare comparisons can be pushed to the reader."""
    if isinstance(n, E.Op) and n.op in ("and", "or"):
        a, b = filter_condition(fr, n.args[0]), filter_condition(fr, n.args[1])
        return a & b if n.op == "and" else a | b
    v = value(fr, n)
    return v.c if v.is_bool else as_bool(v)


# ---- search clause ------------------------------------------------------------------------------
def glob(v: str) -> str:
    return "".join(".*" if ch == "*" else re.escape(ch) for ch in v)


def clause(fr: Frame, n: object, case_sensitive: bool = False) -> Column:
    """Filter predicate of a parsed search clause (times excepted); NULL means false."""
    if isinstance(n, S.And):
        out = clause(fr, n.parts[0], case_sensitive)
        for p in n.parts[1:]:
            out = out & clause(fr, p, case_sensitive)
        return out
    if isinstance(n, S.Or):
        out = clause(fr, n.parts[0], case_sensitive)
        for p in n.parts[1:]:
            out = out | clause(fr, p, case_sensitive)
        return out
    if isinstance(n, S.Not):
        return ~clause(fr, n.part, case_sensitive)
    if isinstance(n, S.Time):
        return F.lit(True)
    if isinstance(n, S.Term):
        return _anywhere(fr, n, case_sensitive)
    assert isinstance(n, S.Cmp)
    # NOT is at the leaves already, so NULL may stand for false here, and the bare
    # comparison can reach the reader as a pushed filter
    return _field_cmp(fr, n, case_sensitive or n.case)


def _anywhere(fr: Frame, n: S.Term, case_sensitive: bool) -> Column:
    flags = "" if case_sensitive or n.case else "(?i)"
    if n.whole:
        pat = flags + r"(?<![^\s,;\[\](){}\"'])" + re.escape(n.text) + r"(?![^\s,;\[\](){}\"'])"
    else:
        body = glob(n.text).replace(".*", r"\S*") if "*" in n.text else re.escape(n.text)
        lead = "" if n.text.startswith("*") else r"(?<![A-Za-z0-9_])"
        tail = "" if n.text.endswith("*") else r"(?![A-Za-z0-9_])"
        pat = flags + lead + body + tail
    out: Column | None = None
    for f in fr.df.schema.fields:
        if f.name.startswith("__o"):
            continue
        v = Val(ty.q(f.name), f.dataType)
        if v.is_str or v.is_mv or isinstance(f.dataType, (ty.T.StructType, ty.T.MapType)):
            c = as_str(v).rlike(pat)
        elif v.is_num or v.is_bool:
            if not re.fullmatch(r"[\d.+*eE-]+|(?i:true|false)", n.text):
                continue  # a word is in no number: do not read the column
            c = as_str(v).rlike(pat)
        else:
            continue
        c = F.coalesce(c, F.lit(False))
        out = c if out is None else out | c
    return F.lit(False) if out is None else out


def _field_cmp(fr: Frame, n: S.Cmp, case: bool) -> Column:
    v = field(fr, n.field)
    if v.is_null:
        return F.lit(False)
    low = (lambda c: c) if case else F.lower
    value_ = n.value if case else n.value.lower()
    if v.is_mv:
        one = lambda x: F.coalesce(_match_text(x, n, low, value_, case), F.lit(False))
        return F.exists(ty.as_mv(v), one) if n.op != "!=" else ~F.exists(ty.as_mv(v), lambda x: ~one(x))
    if n.value == "*" and not n.quoted and n.op in ("=", "!="):
        return v.c.isNotNull() if n.op == "=" else v.c.isNull()
    if n.whole:
        hit = as_str(v).rlike(r"(?i)(?<![^\s,;\[\](){}\"'])" + re.escape(n.value) + r"(?![^\s,;\[\](){}\"'])")
        return hit if n.op == "=" else ~hit
    if v.is_bool and n.value.lower() in ("true", "false"):
        return compare(v, n.op, ty.lit(n.value.lower() == "true"))
    if is_numeric_text(n.value) and (v.is_num or n.op not in ("=", "!=")):
        return compare(v if v.is_num else num(as_num(v)), n.op, ty.lit(float(n.value)))
    if is_numeric_text(n.value):
        same = F.coalesce(as_num(v) == float(n.value), F.lit(False)) | (low(as_str(v)) == value_)
        return same if n.op == "=" else ~same
    return _match_text(as_str(v), n, low, value_, case)


def _match_text(c: Column, n: S.Cmp, low, value_: str, case: bool) -> Column:
    if "*" in n.value and n.op in ("=", "!="):
        hit = c.rlike(("" if case else "(?i)") + r"(?s)^" + glob(n.value) + r"\z")
        return hit if n.op == "=" else ~hit
    return {"=": low(c) == value_, "!=": low(c) != value_, "<": low(c) < value_, "<=": low(c) <= value_, ">": low(c) > value_, ">=": low(c) >= value_}[n.op]


def times(n: object, fr_now) -> dict[str, int]:
    """earliest= and latest= anywhere in the clause, as epoch ms."""
    if isinstance(n, S.Time):
        return {n.key: timespec.resolve(n.value, fr_now)}
    out: dict[str, int] = {}
    for p in getattr(n, "parts", ()):
        out |= times(p, fr_now)
    return out
