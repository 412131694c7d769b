"""The engine: texts in, DataFrames out."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.lang import lex, search
from tracelode.lang.lex import QueryError
from tracelode.operators import generate, groups, order, rows
from tracelode.plans import bind
from tracelode.plans.frame import Frame, events
from tracelode.sources.catalog import Catalog
from tracelode.sources.readers import read_lookup

COMMANDS = {
    "search": rows.search_cmd, "where": rows.where, "regex": rows.regex, "fields": rows.fields, "table": rows.table, "rename": rows.rename, "eval": rows.eval_cmd, "rex": rows.rex,
    "fillnull": rows.fillnull, "makemv": rows.makemv, "mvexpand": rows.mvexpand, "spath": rows.spath, "tojson": rows.tojson, "bin": rows.bin_cmd, "bucket": rows.bin_cmd,
    "stats": groups.stats, "eventstats": groups.eventstats, "timechart": groups.timechart, "top": groups.top, "rare": groups.rare,
    "sort": order.sort, "head": order.head, "tail": order.tail, "dedup": order.dedup, "streamstats": order.streamstats, "transaction": order.transaction,
    "lookup": generate.lookup, "format": generate.format_cmd, "eventcount": generate.eventcount, "filldown": generate.filldown,
}


class Engine:
    """Registered indices and lookups, and the query languages over them.

    Percentiles and distinct counts keep states of bounded size (rank error 1e-4, relative error 1 %)
    unless ``exact`` is set; ``exactperc`` is exact always."""

    def __init__(self, spark: SparkSession, now: dt.datetime | None = None, exact: bool = False) -> None:
        self.spark, self.catalog, self.exact = spark, Catalog(spark), exact
        self.now = now or dt.datetime.now(dt.timezone.utc)
        self.lookups: dict[str, DataFrame | Callable[[], DataFrame]] = {}

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame], time: str | None = None, tie: list[str] | None = None) -> "Engine":
        self.catalog.register(name, df, time, tie)
        return self

    def frame(self, index: str, start_ms: int | None = None, end_ms: int | None = None) -> Frame:
        df, time, tie = self.catalog.resolve(index)
        return events(df, time, tie, self.now, start_ms, end_ms, exact=self.exact, engine=self)

    def lookup(self, name: str) -> DataFrame:
        """A registered lookup, else the csv file of that name."""
        df = self.lookups.get(name)
        if df is None:
            return read_lookup(self.spark, name)
        return df if isinstance(df, DataFrame) else df()

    # ---- the pipe language
    def search(self, text: str, index: str = "*", start_ms: int | None = None, end_ms: int | None = None, size: int | None = None, offset: int = 0) -> DataFrame:
        """Rows of a query in order.  ``size`` and ``offset`` page through them; by default all are returned."""
        fr = self.plan(text, index, start_ms, end_ms)
        df = fr.result()
        if offset:
            df = df.offset(offset)
        return df.limit(size) if size is not None else df

    def plan(self, text: str, index: str = "*", start_ms: int | None = None, end_ms: int | None = None) -> Frame:
        parts = lex.cut(text, "|")
        if parts and parts[0] == "" and len(parts) > 1:
            parts = parts[1:]
            head = ""
        else:
            head = parts.pop(0) if not re.match(r"(gentimes|inputlookup)\b", parts[0], re.I) else ""
        if parts and not head and re.match(r"(gentimes|inputlookup)\b", parts[0], re.I):
            name, _, args = parts.pop(0).partition(" ")
            base = Frame(self.spark.range(0), None, self.now, start_ms, end_ms, exact=self.exact, engine=self)
            fr = generate.gentimes(base, args) if name.lower() == "gentimes" else generate.inputlookup(base, args, True)
        else:
            fr = self.scan(re.sub(r"^search\b", "", head, flags=re.I), index, start_ms, end_ms)
        return self.pipe(fr, parts)

    def scan(self, clause: str, index: str, start_ms: int | None = None, end_ms: int | None = None, case: bool = False) -> Frame:
        """Events of the indices that match a search clause within the time range."""
        names = re.findall(r'(?:^|\s)_?index\s*=\s*("[^"]*"|\S+)', clause)
        if names:
            index = ",".join(n.strip('"') for n in names)
            clause = re.sub(r'(?:^|(?<=\s))_?index\s*=\s*("[^"]*"|\S+)(\s+OR\b)?', " ", clause)
        n = search.parse(clause)
        t = bind.times(n, self.now) if n is not None else {}
        fr = self.frame(index, t.get("earliest", start_ms), t.get("latest", end_ms))
        return fr if n is None else fr.with_df(fr.df.where(bind.clause(fr, n, case)))

    def pipe(self, fr: Frame, commands: list[str]) -> Frame:
        for c in commands:
            m = re.match(r"(\w+)\s*(.*)", c, re.S)
            if not m:
                raise QueryError(f"no command: {c!r}")
            name, args = m[1].lower(), m[2]
            if name == "inputlookup":
                fr = generate.inputlookup(fr, args, False)
            elif name == "append":
                sub = args.strip()
                if not (sub.startswith("[") and sub.endswith("]")):
                    raise QueryError("append takes [subsearch]")
                inner = self.plan(sub[1:-1], "*", fr.start_ms, fr.end_ms)
                fr = generate.append_rows(fr, inner.df.drop(*inner.hidden))
            elif name in COMMANDS:
                fr = COMMANDS[name](fr, args)
            else:
                raise QueryError(f"unknown command {name}")  # never end a pipeline silently
        return fr

    # ---- the other languages
    def pipeql(self, text: str, index: str = "*", **kw: int) -> DataFrame:
        from tracelode.lang import pipeql

        return pipeql.run(self, text, index, **kw).result()

    def sql(self, text: str, extended: bool = False) -> DataFrame:
        from tracelode.lang import sql

        return sql.run(self, text, extended)

    def es(self, body: dict, index: str = "*") -> DataFrame:
        from tracelode.lang import esdsl

        return esdsl.run(self, body, index)
