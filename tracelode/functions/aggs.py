"""Aggregates of stats-like commands: how they are spelt, named and built."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelode.functions.typing import Val, as_bool, as_num, as_str
from tracelode.lang.lex import QueryError

# Other spellings of aggregates.
ALIASES = {"c": "count", "mean": "avg", "distinct_count": "dc", "estdc": "dc", "sumq": "sumsq", "stddev": "stdev"}
NAMES = "count sum avg min max range dc estdc_error values list perc exactperc upperperc median sumsq var varp stdev stdevp mode first last earliest latest earliest_time latest_time rate".split()
LIST_MOST = 100


@dataclass(frozen=True)
class Agg:
    fn: str
    arg: str | None  # a field, or the text of an eval expression
    is_eval: bool
    param: float | None
    alias: str | None
    text: str

    @property
    def name(self) -> str:
        """The output column: ``func(field)``, a bare count is ``count(*)``."""
        if self.alias:
            return self.alias
        if self.is_eval:
            return self.text
        if self.fn == "count" and self.arg is None:
            return "count(*)"
        head = {"dc": "cardinality"}.get(self.fn, self.fn)
        if self.fn.endswith("perc"):
            head += f"{self.param:g}"
        return f"{head}({self.arg})"


def parse_agg(fn: str, arg: str | None, alias: str | None, whole: str) -> Agg:
    f, param = fn.lower(), None
    m = re.fullmatch(r"(exactperc|upperperc|perc|p)(\d+(?:\.\d+)?)", f)
    if m:
        f, param = {"p": "perc"}.get(m[1], m[1]), float(m[2])
        if not 0 <= param <= 100:
            raise QueryError(f"percentile out of range: {fn}")
    f = ALIASES.get(f, f)
    if f not in NAMES:
        raise QueryError(f"unknown aggregate {fn}")
    if f in ("perc", "exactperc", "upperperc") and param is None:
        raise QueryError(f"{fn} needs a number")
    a = arg.strip() if arg is not None else None
    if a in ("", "*"):
        a = None
    is_eval = bool(a and re.match(r"eval\s*\(", a, re.I))
    if is_eval:
        a = a[a.index("(") + 1 : a.rindex(")")]  # type: ignore[union-attr,index]
    if a is None and f not in ("count",):
        raise QueryError(f"{fn} needs a field")
    return Agg(f, a.strip('"') if a and not is_eval else a, is_eval, param, alias, whole.strip())


def build(a: Agg, v: Val | None, ts: Column | None, exact: bool = True) -> Column:
    """``v`` is the argument's value, None for a bare count; ``ts`` the event time for the time-ordered ones."""
    if v is None:
        return F.count(F.lit(1))
    n = as_num(v)
    if a.fn == "count":
        return F.count(F.when(as_bool(v), 1)) if a.is_eval and v.is_bool else F.count(v.c)
    if a.fn == "sum":
        return F.sum(n)
    if a.fn == "avg":
        return F.avg(n)
    if a.fn in ("min", "max"):
        f = getattr(F, a.fn)
        return f(n) if v.is_num else F.coalesce(_plain(f(n)), f(as_str(v))) if v.is_str else f(v.c)
    if a.fn == "range":
        return F.max(n) - F.min(n)
    if a.fn == "dc":
        c = v.c if not v.is_mv else F.to_json(v.c)
        return F.count_distinct(c) if exact else F.approx_count_distinct(c, 0.01)
    if a.fn == "estdc_error":
        return F.lit(0.0) if exact else F.max(F.lit(0.01))
    if a.fn == "values":
        return F.array_sort(F.collect_set(as_str(v)))
    if a.fn == "list":
        if ts is None:
            return F.slice(F.collect_list(as_str(v)), 1, LIST_MOST)
        s = as_str(v)
        return F.slice(F.transform(F.array_sort(F.collect_list(F.when(s.isNotNull(), F.struct(ts.alias("o"), s.alias("v"))))), lambda x: x["v"]), 1, LIST_MOST)
    if a.fn in ("perc", "exactperc", "median"):
        p = 0.5 if a.fn == "median" else a.param / 100  # type: ignore[operator]
        return F.percentile(n, p) if exact or a.fn == "exactperc" else F.percentile_approx(n, p, 10_000)
    if a.fn == "upperperc":
        p = a.param / 100  # type: ignore[operator]
        return F.percentile(n, p) if exact else F.percentile_approx(n, p, 10_000)
    if a.fn == "sumsq":
        return F.sum(n * n)
    if a.fn == "var":
        return F.when(F.count(n) < 2, 0.0).otherwise(F.var_samp(n))
    if a.fn == "varp":
        return F.coalesce(F.var_pop(n), F.lit(0.0))
    if a.fn == "stdev":
        return F.when(F.count(n) < 2, 0.0).otherwise(F.stddev_samp(n))
    if a.fn == "stdevp":
        return F.coalesce(F.stddev_pop(n), F.lit(0.0))
    if a.fn == "mode":
        return F.mode(as_str(v), deterministic=True)
    if ts is None:
        raise QueryError(f"{a.fn} needs event times, which an earlier command removed")
    known = F.when(v.c.isNotNull(), ts)
    # events come newest first: the last one is the earliest; of several at one time the least (latest: greatest) value
    at = F.when(v.c.isNotNull(), F.struct(ts.alias("t"), v.c.alias("v")))
    if a.fn in ("earliest", "last"):
        return F.min(at)["v"]
    if a.fn in ("latest", "first"):
        return F.max(at)["v"]
    if a.fn == "earliest_time":
        return F.min(known)
    if a.fn == "latest_time":
        return F.max(known)
    if a.fn == "rate":  # change per second between the earliest and the latest value
        x = F.when(v.c.isNotNull(), F.struct(ts.alias("t"), n.alias("v")))
        return F.try_divide(F.max(x)["v"] - F.min(x)["v"], (F.max(known) - F.min(known)) / 1000)
    raise QueryError(f"unknown aggregate {a.fn}")


def _plain(c: Column) -> Column:
    from tracelode.functions.typing import number_text

    return number_text(c)
