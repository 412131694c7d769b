"""The single-table SQL subset, checked here and then run by Spark SQL."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from tracelode.lang.lex import QueryError

if TYPE_CHECKING:
    from tracelode.plans.engine import Engine

# Functions of the subset.
FUNCTIONS = {"count", "avg", "min", "max", "sum", "cardinality", "round", "ceil", "abs", "sqrt", "exp"}
_REFUSED = re.compile(r"\b(join|union|intersect|except|having|distinct|with|over|case|exists)\b|\(\s*select\b", re.I)


def run(engine: "Engine", text: str, extended: bool) -> DataFrame:
    """``SHOW TABLES``, ``SHOW COLUMNS IN t``, ``DESCRIBE t`` and the subset's SELECT.

    ``extended=True`` lifts the subset: any query Spark accepts over the indices."""
    t = text.strip().rstrip(";")
    if re.fullmatch(r"show\s+tables", t, re.I):
        return engine.catalog.show_tables()
    m = re.fullmatch(r"(?:show\s+columns\s+(?:in|from)|describe)\s+[`\"]?([\w.-]+)[`\"]?", t, re.I)
    if m:
        return engine.catalog.show_columns(m[1])
    for name in engine.catalog.names():
        if re.fullmatch(r"\w+", name) and re.search(rf"\b{name}\b", t, re.I):
            engine.catalog.table(name).createOrReplaceTempView(name)
    if extended:
        return engine.spark.sql(t)
    bare = re.sub(r"'(?:[^']|'')*'", "''", t)
    if not re.match(r"select\b", bare, re.I):
        raise QueryError("only SELECT, SHOW and DESCRIBE")
    if r := _REFUSED.search(bare):
        raise QueryError(f"not in the subset: {r.group(0)}")
    tables = re.search(r"\bfrom\s+(.*?)(?:\bwhere\b|\bgroup\s+by\b|\border\s+by\b|\blimit\b|$)", bare, re.I | re.S)
    if not tables or "," in tables[1]:
        raise QueryError("exactly one table")
    for f in re.findall(r"\b([A-Za-z_]\w*)\s*\(", bare):
        if f.lower() not in FUNCTIONS | {"in", "and", "or", "where", "by"}:
            raise QueryError(f"no function {f}")
    if (o := re.search(r"\border\s+by\s+(.*?)(?:\blimit\b|$)", bare, re.I | re.S)) and "," in o[1]:
        raise QueryError("exactly one sort key")
    if w := re.search(r"\bwhere\s+(.*?)(?:\bgroup\s+by\b|\border\s+by\b|\blimit\b|$)", bare, re.I | re.S):
        if re.search(r"\b(like|in|between|is|not)\b", w[1], re.I):
            raise QueryError("WHERE takes AND, OR and comparisons")
    t = re.sub(r"\bcardinality\s*\(\s*([^)]+)\)", r"count(DISTINCT \1)", t, flags=re.I)
    t = re.sub(r'"(\w+)"', r"`\1`", t)
    if re.search(r"\bgroup\s+by\b", t, re.I) and not re.search(r"\blimit\b", t, re.I):
        t += " LIMIT 100"
    return engine.spark.sql(t)
