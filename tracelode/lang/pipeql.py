"""The small native pipe dialect: filter | columns | let | aggregates groupby | limit."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from tracelode.functions.typing import as_num, as_str, compare, lit, q
from tracelode.lang import lex
from tracelode.lang.lex import QueryError, bare
from tracelode.operators import groups, rows
from tracelode.plans import bind
from tracelode.plans.frame import Frame

if TYPE_CHECKING:
    from tracelode.plans.engine import Engine

BUCKET_LIMIT = 3_000


def run(engine: "Engine", text: str, index: str, start_ms: int | None = None, end_ms: int | None = None) -> Frame:
    """Like the large dialect, but searches are case-sensitive."""
    head, *parts = lex.cut(text, "|")
    fr = engine.scan(re.sub(r"^search\b", "", head, flags=re.I), index, start_ms, end_ms, case=True)
    for p in parts:
        fr = _stage(fr, p)
    return fr


def _stage(fr: Frame, p: str) -> Frame:
    if m := re.fullmatch(r"columns\s+(-?)\s*(.*)", p, re.S | re.I):
        items = [i.strip() for i in m[2].split(",") if i.strip()]
        renames = dict(reversed(i.split("=", 1)) for i in items if "=" in i)
        if renames:
            return fr.select(*[q(c).alias(bare(renames[c].strip())) if c in renames else q(c) for c in fr.columns])
        names = rows.expand(fr, [bare(i) for i in items])
        return fr.select(*[q(c) for c in (fr.columns if m[1] else names) if not m[1] or c not in names])
    if m := re.fullmatch(r"let\s+(\S+?)\s*=\s*(\S+)\s*(==|!=|<=|>=|[-+*/%<>])\s*(\S+)", p, re.S | re.I):
        a = bind.field(fr, bare(m[2]))
        b = bind.field(fr, bare(m[4])) if bare(m[4]) in fr.columns else lit(float(m[4]) if re.fullmatch(r"-?[\d.]+", m[4]) else bare(m[4]))
        if m[3] in ("==", "!=", "<", ">", "<=", ">="):
            c = compare(a, {"==": "="}.get(m[3], m[3]), b)
        elif m[3] == "+" and (a.is_str and not b.is_num):
            c = F.concat(as_str(a), as_str(b))
        else:
            x, y = as_num(a), as_num(b)
            c = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.when(y != 0, x / y), "%": lambda: F.when(y != 0, x % y)}[m[3]]()
        return fr.put({m[1]: c})
    if m := re.fullmatch(r"(.*?\))\s*(?:groupby\s+(.*?))?\s*(?:limit\s+(\d+))?", p, re.S | re.I):
        out = groups.stats(fr, m[1] + (f" by {m[2]}" if m[2] else ""))
        keys = [bare(k.strip()) for k in (m[2] or "").split(",") if k.strip()]
        if not keys:
            return out
        return out.with_df(out.df.orderBy(*map(q, keys)).limit(int(m[3] or BUCKET_LIMIT)))
    if m := re.fullmatch(r"limit\s+(\d+)", p, re.I):
        return fr.with_df(fr.df.orderBy(*fr.sort_keys()).limit(int(m[1])) if fr.order else fr.df.limit(int(m[1])))
    raise QueryError(f"no stage: {p!r}")
