"""Eval functions: name -> builder of a column from typed arguments.

Each builder takes a :class:`Ctx` and values and returns a value.  Everything
is built-in columns except ``sigfig`` and the thousands flag of ``printf``,
which have small Arrow functions."""

from __future__ import annotations

import datetime as dt
import ipaddress
import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.functions import typing as ty
from tracelode.functions.typing import Val, as_bool, as_mv, as_num, as_str, boolean, mv, num, text
from tracelode.lang import timespec
from tracelode.lang.lex import QueryError


@dataclass
class Ctx:
    df: DataFrame
    now: dt.datetime


REGISTRY: dict[str, tuple[Callable[..., Val], int, int]] = {}
MANY = 10_000


def fn(name: str, least: int, most: int | None = None) -> Callable:
    def put(f: Callable[..., Val]) -> Callable[..., Val]:
        for n in name.split():
            REGISTRY[n] = (f, least, least if most is None else most)
        return f

    return put


def call(ctx: Ctx, name: str, args: list[Val]) -> Val:
    if name not in REGISTRY:
        raise QueryError(f"unknown function {name}")
    f, least, most = REGISTRY[name]
    if not least <= len(args) <= most:
        raise QueryError(f"{name} takes {least} to {most} arguments, not {len(args)}")
    return f(ctx, *args)


def const(v: Val, what: str) -> str:
    if v.lit is None:
        raise QueryError(f"{what} must be a literal")
    return str(int(v.lit)) if isinstance(v.lit, float) and v.lit.is_integer() else str(v.lit)


# ---- numbers ----------------------------------------------------------------------------------
def _simple(name: str, f: Callable[[Column], Column]) -> None:
    REGISTRY[name] = (lambda ctx, x: num(f(as_num(x)).cast("double")), 1, 1)


for _n in "abs ceil floor exp sin cos tan atan sinh cosh tanh asinh".split():
    _simple(_n, getattr(F, _n))
_simple("ceiling", F.ceil)
_simple("exact", lambda c: c)
_simple("sqrt", lambda c: F.when(c >= 0, F.sqrt(c)))
_simple("ln", lambda c: F.when(c > 0, F.ln(c)))
_simple("asin", lambda c: F.when(c.between(-1, 1), F.asin(c)))
_simple("acos", lambda c: F.when(c.between(-1, 1), F.acos(c)))
_simple("acosh", lambda c: F.when(c >= 1, F.acosh(c)))
_simple("atanh", lambda c: F.when((c > -1) & (c < 1), F.atanh(c)))


@fn("log", 1, 2)
def _log(ctx: Ctx, x: Val, base: Val | None = None) -> Val:
    b = F.lit(10.0) if base is None else F.when(as_num(base) == 0, 10.0).otherwise(as_num(base))
    c = as_num(x)
    return num(F.when((c > 0) & (b > 0) & (b != 1), F.try_divide(F.ln(c), F.ln(b))))


@fn("pow", 2)
def _pow(ctx: Ctx, x: Val, y: Val) -> Val:
    return num(F.pow(as_num(x), as_num(y)))


@fn("hypot", 2)
def _hypot(ctx: Ctx, x: Val, y: Val) -> Val:
    return num(F.hypot(as_num(x), as_num(y)))


@fn("atan2", 2)
def _atan2(ctx: Ctx, x: Val, y: Val) -> Val:
    return num(F.atan2(as_num(x), as_num(y)))


@fn("round", 1, 2)
def _round(ctx: Ctx, x: Val, n: Val | None = None) -> Val:
    places = int(float(const(n, "precision"))) if n else 0
    scale = F.lit(10.0**places)
    c = as_num(x) * scale
    return num(F.signum(c) * F.floor(F.abs(c) + 0.5) / scale)


def _figures(t: str) -> tuple[int, int]:
    """Significant figures and decimal places of a written number.  Zeros at the end of an
    integer say nothing of its precision, nor do those in front of a fraction."""
    whole, dot, part = t.lower().partition("e")[0].lstrip("+-").partition(".")
    if not dot:
        return len(whole.strip("0") and whole.rstrip("0")), 0
    return (len(whole) + len(part) if whole.strip("0") else len(part.lstrip("0"))), len(part)


def _written(x: float) -> str:
    t = format(Decimal(repr(x)), "f")
    return t[:-2] if t.endswith(".0") else t


def _nearest(x: float, places: int) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def _to_figures(x: float, figures: int) -> float:
    whole, _, part = _written(abs(x)).partition(".")
    if len(whole) + len(part) < figures:
        return x
    return _nearest(x, figures + len(part) - len(part.lstrip("0")) if whole == "0" else figures - len(whole))


def _significant(tree: object, leaf: list[str], steps: list[tuple[int, int]]) -> tuple[float, int, int, str]:
    """Value, figures, places and operator of a tree of + - * /; ``steps`` gets what each operation leaves."""
    if isinstance(tree, int):
        return float(leaf[tree]), *_figures(leaf[tree]), ""
    op, *sides = tree  # type: ignore[misc]
    (x, fx, px, _), (y, fy, py, _) = (_significant(s, leaf, steps) for s in sides)
    figures, places = min(fx, fy), min(px, py)
    v = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x / y
    if op in "+-":
        whole, _, part = _written(v).partition(".")
        figures = _figures(f"{whole}.{part[:places]}" if part else whole)[0]
    else:
        places = _figures(_written(_to_figures(v, figures)))[1]
    steps.append((figures, places))
    return v, *_figures(_written(v)), op


def sigfig(tree: object, leaves: list[Column]) -> Column:
    """The value of a tree of operators over ``leaves`` (texts), rounded as the precision of its numbers
    allows: sums to the fewest decimal places, products to the fewest significant figures of any step."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.DataFrame) -> pd.Series:
        out = []
        for row in texts.itertuples(index=False):
            try:
                steps: list[tuple[int, int]] = []
                v, *_, op = _significant(tree, list(row), steps)
                out.append(v if not op else _nearest(v, min(p for _, p in steps)) if op in "+-" else _to_figures(v, min(f for f, _ in steps)))
            except (TypeError, ValueError, ArithmeticError):
                out.append(None)
        return pd.Series(out, dtype="float64")

    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(leaves)]))


@fn("pi", 0)
def _pi(ctx: Ctx) -> Val:
    return num(F.lit(3.141592653589793))


@fn("now", 0)
def _now(ctx: Ctx) -> Val:
    return num(F.lit(float(int(ctx.now.timestamp()))))


@fn("time", 0)
def _time(ctx: Ctx) -> Val:
    return num(F.lit(float(int(ctx.now.timestamp() * 1000))))


@fn("random", 0)
def _random(ctx: Ctx) -> Val:
    return num(F.floor(F.rand() * 2147483648.0).cast("double"))


@fn("tonumber", 1, 2)
def _tonumber(ctx: Ctx, s: Val, base: Val | None = None) -> Val:
    """Whole numbers only; whatever does not parse is 0."""
    b = int(float(const(base, "base"))) if base else 10
    if not 2 <= b <= 36:
        raise QueryError("base must be 2 to 36")
    digits = "0-9" if b > 10 else f"0-{b - 1}"
    letters = f"a-{chr(ord('a') + b - 11)}" if b > 10 else ""
    c = F.trim(as_str(s))
    ok = c.rlike(f"(?i)^[+-]?[{digits}{letters}]+$")
    v = F.conv(F.regexp_replace(c, r"^[+-]", ""), b, 10).try_cast("double")
    return num(F.when(c.isNull(), None).when(ok, F.when(F.startswith(c, F.lit("-")), -v).otherwise(v)).otherwise(0.0))


@fn("len", 1)
def _len(ctx: Ctx, s: Val) -> Val:
    return num(F.octet_length(as_str(s)).cast("double"))


_MASK53 = (1 << 53) - 1


def _bits(v: Val) -> Column:
    c = as_num(v)
    return F.when((c >= 0) & (c == F.floor(c)) & (c <= _MASK53), c.try_cast("bigint"))


for _n, _m in (("bit_and", "bitwiseAND"), ("bit_or", "bitwiseOR"), ("bit_xor", "bitwiseXOR")):

    def _bit(ctx: Ctx, *args: Val, _m: str = _m) -> Val:
        c = _bits(args[0])
        for a in args[1:]:
            c = getattr(c, _m)(_bits(a))
        return num(c.cast("double"))

    REGISTRY[_n] = (_bit, 2, MANY)


@fn("bit_not", 1, 2)
def _bit_not(ctx: Ctx, x: Val, mask: Val | None = None) -> Val:
    m = _bits(mask) if mask else F.lit(_MASK53)
    return num(F.bitwise_not(_bits(x)).bitwiseAND(m).cast("double"))


@fn("bit_shift_left", 2, 3)
def _bit_left(ctx: Ctx, x: Val, n: Val, mask: Val | None = None) -> Val:
    m = _bits(mask) if mask else F.lit(_MASK53)
    return num(F.call_function("shiftleft", _bits(x), _bits(n).cast("int")).bitwiseAND(m).cast("double"))


@fn("bit_shift_right", 2, 3)
def _bit_right(ctx: Ctx, x: Val, n: Val, mask: Val | None = None) -> Val:
    m = _bits(mask) if mask else F.lit(_MASK53)
    return num(F.call_function("shiftright", _bits(x), _bits(n).cast("int")).bitwiseAND(m).cast("double"))


def _ts(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).try_cast("bigint"))


@fn("relative_time", 2)
def _relative_time(ctx: Ctx, t: Val, spec: Val) -> Val:
    """Epoch seconds moved by offsets and snapped to units, UTC."""
    s = const(spec, "time specifier").strip()
    s = s[3:] if s.startswith("now") else s
    c, i = _ts(as_num(t)), 0
    trunc = {"s": "second", "m": "minute", "h": "hour", "d": "day", "mon": "month", "q": "quarter", "y": "year"}
    for m in re.finditer(r"([+-])(\d*)([A-Za-z]+)|@([A-Za-z]+?)([0-7]?)(?=$|[+@-])", s):
        if m.start() != i:
            break
        i = m.end()
        u = timespec.UNITS.get((m[3] or m[4]).lower())
        if u is None:
            raise QueryError(f"unknown unit in {s!r}")
        if m[4]:
            if u == "w":
                back = F.pmod(F.dayofweek(c) - 1 - int(m[5] or 0) % 7, F.lit(7))
                c = F.date_trunc("day", c) - F.make_interval(days=back)
            elif u in trunc:
                c = F.date_trunc(trunc[u], c)
        else:
            n = int(m[2] or 1) * (1 if m[1] == "+" else -1)
            if u in ("mon", "q", "y"):
                c = c + F.make_interval(months=F.lit(n * {"mon": 1, "q": 3, "y": 12}[u]))
            else:
                c = F.timestamp_micros(F.unix_micros(c) + int(n * timespec.MS[u] * 1000))
    if i != len(s):
        raise QueryError(f"no time specifier: {s!r}")
    return num((F.unix_micros(c) / 1_000_000).cast("double"))


# ---- texts ------------------------------------------------------------------------------------
REGISTRY["lower"] = (lambda ctx, s: text(F.lower(as_str(s))), 1, 1)
REGISTRY["upper"] = (lambda ctx, s: text(F.upper(as_str(s))), 1, 1)
REGISTRY["urldecode"] = (lambda ctx, s: text(F.try_url_decode(as_str(s))), 1, 1)


def _trimmer(left: bool, right: bool) -> Callable[..., Val]:
    def f(ctx: Ctx, s: Val, chars: Val | None = None) -> Val:
        cls = "[" + re.sub(r"([\\\[\]^&-])", r"\\\1", const(chars, "characters") if chars else " \t") + "]+"
        c = as_str(s)
        c = F.regexp_replace(c, "^" + cls, "") if left else c
        return text(F.regexp_replace(c, cls + "$", "") if right else c)

    return f


REGISTRY["trim"], REGISTRY["ltrim"], REGISTRY["rtrim"] = (_trimmer(True, True), 1, 2), (_trimmer(True, False), 1, 2), (_trimmer(False, True), 1, 2)


@fn("substr", 2, 3)
def _substr(ctx: Ctx, s: Val, start: Val, length: Val | None = None) -> Val:
    a = as_num(start).cast("int")
    a = F.when(a == 0, 1).otherwise(a)
    c = as_str(s)
    return text(F.substr(c, a, as_num(length).cast("int")) if length else F.substr(c, a))


def java_regex(p: str) -> str:
    """``(?P<n>`` as Java spells it; names lose what Java forbids in them."""
    return re.sub(r"\(\?P?<([A-Za-z]\w*)>", lambda m: "(?<" + m[1].replace("_", "") + ">", p)


@fn("replace", 3)
def _replace(ctx: Ctx, s: Val, pattern: Val, by: Val) -> Val:
    repl = re.sub(r"\\(\d)", r"$\1", const(by, "replacement"))
    return text(F.regexp_replace(as_str(s), java_regex(const(pattern, "pattern")), repl))


REGISTRY["max"] = (lambda ctx, *a: text(F.greatest(*map(as_str, a)) if len(a) > 1 else as_str(a[0])), 1, MANY)
REGISTRY["min"] = (lambda ctx, *a: text(F.least(*map(as_str, a)) if len(a) > 1 else as_str(a[0])), 1, MANY)


@fn("tostring", 1, 2)
def _tostring(ctx: Ctx, v: Val, form: Val | None = None) -> Val:
    if form is None:
        return text(as_str(v))
    f, c = const(form, "format"), as_num(v)
    if f == "hex":
        return text(F.concat(F.lit("0x"), F.lower(F.hex(c.try_cast("bigint")))))
    if f == "commas":
        return text(F.call_function("format_number", c, F.lit("#,##0.##")))
    if f == "duration":
        n = c.try_cast("bigint")
        return text(F.format_string("%02d:%02d:%02d", F.call_function("div", n, F.lit(3_600)), F.call_function("div", n % 3_600, F.lit(60)), n % 60))
    raise QueryError(f"unknown format {f!r}")


@F.pandas_udf(T.StringType())
def _grouped_udf(v: pd.Series, spec: pd.Series) -> pd.Series:
    out = []
    for x, s in zip(v, spec):
        m = re.fullmatch(r"([-+ 0#]*)(\d*)(?:\.(\d+))?([a-zA-Z])", s)
        if pd.isna(x) or not m:
            out.append(None)
            continue
        body = f"{int(x):,d}" if m[4] in "di" else f"{float(x):,.{int(m[3] or 6)}f}"
        body = ("+" if "+" in m[1] and x >= 0 else "") + body
        width = int(m[2] or 0)
        out.append(body.ljust(width) if "-" in m[1] else body.rjust(width, "0" if "0" in m[1] else " "))
    return pd.Series(out, dtype="object")


@fn("printf", 1, MANY)
def _printf(ctx: Ctx, fmt: Val, *args: Val) -> Val:
    f, parts, i = const(fmt, "format"), [], 0
    at = 0
    for m in re.finditer(r"%(?:(%)|([-+ 0#']*)(\*|\d*)(?:\.(\*|\d+))?([a-zA-Z]))", f):
        parts.append(F.lit(f[at : m.start()]))
        at = m.end()
        if m[1]:
            parts.append(F.lit("%"))
            continue
        flags, width, prec, kind = m[2], m[3], m[4], m[5]
        if width == "*":
            width, i = const(args[i], "width"), i + 1
        if prec == "*":
            prec, i = const(args[i], "precision"), i + 1
        if i >= len(args):
            raise QueryError("printf has too few arguments")
        a, i = args[i], i + 1
        if "'" in flags and kind in "dif":
            parts.append(_grouped_udf(as_num(a), F.lit(f"{flags.replace(chr(39), '')}{width}{'.' + prec if prec else ''}{kind}")))
        elif kind in "diu":
            parts.append(F.format_string(f"%{flags}{width}d", as_num(a).try_cast("bigint")))
        elif kind in "xXo":
            parts.append(F.format_string(f"%{flags}{width}{kind}", as_num(a).try_cast("bigint")))
        elif kind in "fFeEgGaA":
            parts.append(F.format_string(f"%{flags}{width}{'.' + prec if prec else ''}{kind.lower() if kind == 'F' else kind}", as_num(a)))
        elif kind == "c":
            parts.append(F.substring(as_str(a), 1, 1))
        elif kind in "sz":
            parts.append(F.format_string(f"%{flags.replace('0', '').replace('+', '')}{width}{'.' + prec if prec else ''}s", as_str(a)))
        else:
            raise QueryError(f"printf has no %{kind}")
    parts.append(F.lit(f[at:]))
    return text(F.concat(*parts))


def _octets(c: Column) -> Column:
    p = F.split(c, r"\.")
    n = [F.get(p, F.lit(i)).try_cast("bigint") for i in range(4)]
    ok = c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*n) <= 255)
    return F.when(ok, ((n[0] * 256 + n[1]) * 256 + n[2]) * 256 + n[3])


def _dotted(n: Column) -> Column:
    return F.concat_ws(".", *[F.call_function("shiftright", n, F.lit(s)).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


@fn("ipmask", 2)
def _ipmask(ctx: Ctx, mask: Val, ip: Val) -> Val:
    n = _octets(as_str(ip)).bitwiseAND(_octets(as_str(mask)))
    return text(F.when(n.isNotNull(), _dotted(n)))


@fn("cidrmatch", 2)
def _cidrmatch(ctx: Ctx, cidr: Val, ip: Val) -> Val:
    try:
        net = ipaddress.ip_network(const(cidr, "network"), strict=False)
    except ValueError as e:
        raise QueryError(str(e)) from e
    if net.version == 4:
        return boolean(F.coalesce(_octets(as_str(ip)).bitwiseAND(F.lit(int(net.netmask))) == int(net.network_address), F.lit(False)))
    return boolean(_in_v6(as_str(ip), F.lit(str(net))))


@F.pandas_udf(T.BooleanType())
def _in_v6(v: pd.Series, net: pd.Series) -> pd.Series:
    n = ipaddress.ip_network(net.iloc[0]) if len(net) else None

    def inside(x: object) -> bool:
        try:
            return ipaddress.ip_address(x) in n
        except ValueError:
            return False

    return v.map(inside).astype(bool)


@fn("typeof", 1)
def _typeof(ctx: Ctx, v: Val) -> Val:
    name = "Number" if v.is_num else "Boolean" if v.is_bool else "Null" if v.is_null else "String"
    return text(F.when(v.c.isNull(), "Null").otherwise(name))


# Fixed values: % letters of time formats as date patterns.
_STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE",
    "j": "DDD", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "z": "xx", "Z": "zzz", "k": "H", "l": "h", "c": "EEE MMM d HH:mm:ss yyyy", "x": "MM/dd/yy", "X": "HH:mm:ss",
}


def _format_parts(f: str, ts: Column) -> list[Column]:
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"%(Ez|\d?N|\d?Q|[A-Za-z%+])", f):
        if f[at : m.start()]:
            parts.append(F.lit(f[at : m.start()]))
        at, k = m.end(), m[1]
        us = F.unix_micros(ts)
        if k == "%":
            parts.append(F.lit("%"))
        elif k == "s":
            parts.append(F.call_function("div", us, F.lit(1_000_000)).cast("string"))
        elif k[-1] in "NQ":
            n = int(k[0]) if k[0].isdigit() else (9 if k == "N" else 3)
            parts.append(F.substring(F.lpad((F.pmod(us, F.lit(1_000_000)) * 1000).cast("string"), 9, "0"), 1, n))
        elif k == "w":
            parts.append((F.dayofweek(ts) - 1).cast("string"))
        elif k in "jUWV":  # fixed rules: numbers of day and week without leading zeros
            day, weekday = F.dayofyear(ts), F.dayofweek(ts) - 1
            n = {"j": day, "U": F.floor(day / 7), "W": F.floor((weekday - 1 + day) / 7), "V": F.weekofyear(ts)}[k]
            parts.append(n.cast("string"))
        elif k == "e":
            parts.append(F.lpad(F.dayofmonth(ts).cast("string"), 2, " "))
        elif k == "Ez":
            parts.append(F.lit("+00:00"))
        elif k in "zZ":
            parts.append(F.lit("+0000" if k == "z" else "UTC"))
        elif k in _STRFTIME:
            parts.append(F.date_format(ts, _STRFTIME[k]))
        else:
            raise QueryError(f"unknown time format %{k}")
    if f[at:]:
        parts.append(F.lit(f[at:]))
    return parts or [F.lit("")]


@fn("strftime", 2)
def _strftime(ctx: Ctx, t: Val, fmt: Val) -> Val:
    """``t`` is epoch milliseconds; UTC."""
    ts = F.timestamp_micros((as_num(t) * 1000).try_cast("bigint"))
    return text(F.concat(*_format_parts(const(fmt, "format"), ts)))


@fn("strptime", 2)
def _strptime(ctx: Ctx, s: Val, fmt: Val) -> Val:
    """Epoch seconds as text; a time without date is of 1970-01-01."""
    f = const(fmt, "format")
    pattern, at, dated = "", 0, False
    for m in re.finditer(r"%([A-Za-z%])", f):
        pattern += "".join(f"'{c}'" if c.isalpha() else "''" if c == "'" else c for c in f[at : m.start()])
        at = m.end()
        if m[1] != "%" and m[1] not in _STRFTIME:
            raise QueryError(f"unknown time format %{m[1]}")
        dated |= m[1] in "YymdFDejBbhcx"
        pattern += "%" if m[1] == "%" else _STRFTIME[m[1]]
    pattern += "".join(f"'{c}'" if c.isalpha() else c for c in f[at:])
    c = as_str(s)
    if not dated:
        c, pattern = F.concat(F.lit("1970-01-01 "), c), "yyyy-MM-dd " + pattern
    ts = F.try_to_timestamp(c, F.lit(pattern))
    return text(F.call_function("div", F.unix_micros(ts), F.lit(1_000_000)).cast("string"))


# ---- multivalues --------------------------------------------------------------------------------
@fn("split", 2)
def _split(ctx: Ctx, s: Val, d: Val) -> Val:
    delim = const(d, "delimiter")
    c = as_str(s)
    return mv(F.split(c, re.escape(delim) if delim else "", -1))


@fn("mvindex", 2, 3)
def _mvindex(ctx: Ctx, a: Val, i: Val, j: Val | None = None) -> Val:
    c, n = as_mv(a), F.size(as_mv(a))
    x = as_num(i).cast("int")
    x = F.when(x < 0, x + n).otherwise(x)
    if j is None:
        return text(F.coalesce(F.get(c, F.when((x >= 0) & (x < n), x)), F.when(c.isNotNull(), "")))
    y = as_num(j).cast("int")
    y = F.when(y < 0, y + n).otherwise(y)
    ok = (x >= 0) & (x <= y) & (y < n)
    return mv(F.when(c.isNull(), None).when(ok, F.slice(c, F.greatest(x, F.lit(0)) + 1, F.greatest(y - x + 1, F.lit(0)))).otherwise(F.array().cast("array<string>")))


REGISTRY["mvcount"] = (lambda ctx, a: num(F.when(a.c.isNotNull(), F.size(as_mv(a))).cast("double")), 1, 1)
REGISTRY["mvsort"] = (lambda ctx, a: mv(F.array_sort(as_mv(a))), 1, 1)
REGISTRY["mvdedup"] = (lambda ctx, a: mv(F.array_distinct(as_mv(a))), 1, 1)
REGISTRY["mvappend"] = (lambda ctx, *a: mv(F.concat(*map(as_mv, a))), 1, MANY)
REGISTRY["mvjoin"] = (lambda ctx, a, d: text(F.array_join(as_mv(a), const(d, "delimiter"))), 2, 2)


@fn("mvzip", 2, 3)
def _mvzip(ctx: Ctx, a: Val, b: Val, d: Val | None = None) -> Val:
    x, y = as_mv(a), as_mv(b)
    n = F.least(F.size(x), F.size(y))
    return mv(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, r: F.concat_ws(const(d, "delimiter") if d else ",", p, r)))


@fn("mvfind", 2)
def _mvfind(ctx: Ctx, a: Val, pattern: Val) -> Val:
    p = F.array_position(F.transform(as_mv(a), lambda x: x.rlike(java_regex(const(pattern, "pattern")))), True)
    return text(F.when(p > 0, (p - 1).cast("string")).when(a.c.isNotNull(), ""))


@fn("mvrange", 2, 3)
def _mvrange(ctx: Ctx, a: Val, b: Val, step: Val | None = None) -> Val:
    x, y = as_num(a).cast("bigint"), as_num(b).cast("bigint")
    k = as_num(step).cast("bigint") if step else F.lit(1).cast("bigint")
    seq = F.when((y > x) & (k > 0), F.sequence(x, y - 1, k)).otherwise(F.array().cast("array<bigint>"))
    return mv(seq.cast("array<string>"))


@fn("mv_to_json_array", 1, 2)
def _mv_to_json(ctx: Ctx, a: Val, infer: Val | None = None) -> Val:
    if infer is not None and infer.lit is True:
        plain = r"^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null)$"
        one = lambda x: F.when(x.rlike(plain), x).otherwise(F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'^\{"v":(.*)\}$', 1))
        return text(F.concat(F.lit("["), F.array_join(F.transform(as_mv(a), one), ","), F.lit("]")))
    return text(F.to_json(as_mv(a)))


def json_path(p: str) -> str:
    return "$" + "".join(f"[{x[1:-1]}]" if re.fullmatch(r"\{\d+\}", x) else "[*]" if x == "{}" else f"['{x}']" for x in re.findall(r"\{\d*\}|[^.{}]+", p))


@fn("spath", 2)
def _spath(ctx: Ctx, doc: Val, path: Val) -> Val:
    """JSON by dotted path with ``{}`` and ``{n}``, XML by the same path as elements."""
    c, p = as_str(doc), const(path, "path")
    js = F.get_json_object(c, json_path(p))
    steps = "/" + "/".join(re.sub(r"\{@(\w+)\}", r"/@\1", re.sub(r"\{(\d+)\}", r"[\1]", x)) for x in p.split("."))
    xml = F.when(c.rlike(r"^\s*<"), F.array_join(F.xpath(c, F.lit(steps if "@" in steps else steps + "/text()")), " "))
    return text(F.when(c.rlike(r"^\s*<"), F.nullif(xml, F.lit(""))).otherwise(js))


# ---- conditions ---------------------------------------------------------------------------------
def common(vals: list[Val]) -> tuple[list[Column], T.DataType]:
    """Columns of one type: numbers if all are, booleans if all are, else texts."""
    real = [v for v in vals if not v.is_null and v.lit != ""] or [v for v in vals if not v.is_null]
    if real and all(v.is_num for v in real):
        return [as_num(v) if not v.is_null else F.lit(None).cast("double") for v in vals], T.DoubleType()
    if real and all(v.is_bool for v in real):
        return [v.c.cast("boolean") for v in vals], T.BooleanType()
    if real and all(v.is_mv for v in real):
        return [as_mv(v) if not v.is_null else F.lit(None).cast("array<string>") for v in vals], T.ArrayType(T.StringType())
    return [as_str(v) if not v.is_null else F.lit(None).cast("string") for v in vals], T.StringType()


@fn("if", 3)
def _if(ctx: Ctx, c: Val, a: Val, b: Val) -> Val:
    (x, y), t = common([a, b])
    return Val(F.when(as_bool(c), x).otherwise(y), t)


def _chain(ctx: Ctx, args: tuple[Val, ...], negate: bool) -> Val:
    if len(args) % 2:
        raise QueryError("conditions and values must come in pairs")
    vals, t = common(list(args[1::2]))
    out = None
    for c, v in zip(args[::2], vals):
        b = ~as_bool(c) if negate else as_bool(c)
        out = F.when(b, v) if out is None else out.when(b, v)
    empty = F.lit("") if isinstance(t, T.StringType) and not negate else F.lit(None)
    return Val(out.otherwise(empty), t)  # type: ignore[union-attr]


REGISTRY["case"] = (lambda ctx, *a: _chain(ctx, a, False), 2, MANY)
REGISTRY["validate"] = (lambda ctx, *a: _chain(ctx, a, True), 2, MANY)


@fn("coalesce", 1, MANY)
def _coalesce(ctx: Ctx, *a: Val) -> Val:
    cols, t = common(list(a))
    return Val(F.coalesce(*cols, *([F.lit("")] if isinstance(t, T.StringType) else [])), t)


@fn("nullif", 2)
def _nullif(ctx: Ctx, a: Val, b: Val) -> Val:
    return Val(F.when(F.coalesce(ty.compare(a, "=", b), F.lit(False)), None).otherwise(a.c), a.t)


REGISTRY["null"] = (lambda ctx: ty.lit(None), 0, 0)


@fn("in", 2, MANY)
def _in(ctx: Ctx, x: Val, *options: Val) -> Val:
    out = ty.compare(x, "=", options[0])
    for o in options[1:]:
        out = out | ty.compare(x, "=", o)
    return boolean(out)


@fn("like", 2)
def _like(ctx: Ctx, s: Val, pattern: Val) -> Val:
    return boolean(as_str(s).like(const(pattern, "pattern")))


@fn("match", 2)
def _match(ctx: Ctx, s: Val, pattern: Val) -> Val:
    return boolean(as_str(s).rlike(java_regex(const(pattern, "pattern"))))


REGISTRY["isnull"] = (lambda ctx, v: boolean(v.c.isNull()), 1, 1)
REGISTRY["isnotnull"] = (lambda ctx, v: boolean(v.c.isNotNull()), 1, 1)
REGISTRY["isnum"] = (lambda ctx, v: boolean(as_num(v).isNotNull()), 1, 1)
REGISTRY["isint"] = (lambda ctx, v: boolean(F.coalesce(as_num(v) == F.floor(as_num(v)), F.lit(False)) & (F.lit(True) if v.is_num else ~F.coalesce(as_str(v).contains("."), F.lit(False)))), 1, 1)
REGISTRY["isstr"] = (lambda ctx, v: boolean(v.c.isNotNull() & (F.lit(v.is_str) & as_num(v).isNull())), 1, 1)
REGISTRY["isbool"] = (lambda ctx, v: boolean(v.c.isNotNull() if v.is_bool else F.coalesce(F.lower(as_str(v)).isin("true", "false", "0", "1"), F.lit(False))), 1, 1)
REGISTRY["ismv"] = (lambda ctx, v: boolean(F.lit(v.is_mv) & v.c.isNotNull()), 1, 1)
REGISTRY["isobject"] = (lambda ctx, v: boolean(F.coalesce(as_str(v).rlike(r"^\s*\{") & F.try_parse_json(as_str(v)).isNotNull(), F.lit(False))), 1, 1)
