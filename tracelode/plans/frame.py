"""A DataFrame together with what the command language knows of it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.typing import q
from tracelode.lang.lex import QueryError

HIDDEN = "__o"
TS = "__o_ts"  # event time in ms


@dataclass(frozen=True)
class Frame:
    """``order`` lists hidden columns and whether each falls; None: rows have no order.

    Rows of a Spark plan have none by themselves, so commands that depend on
    order take it from these columns, and fail where an earlier command removed it."""

    df: DataFrame
    order: tuple[tuple[str, bool], ...] | None
    now: dt.datetime
    start_ms: int | None = None
    end_ms: int | None = None
    limit: int | None = None
    exact: bool = True
    engine: object = field(default=None, compare=False)

    def with_df(self, df: DataFrame, **kw: object) -> "Frame":
        return replace(self, df=df, **kw)  # type: ignore[arg-type]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    @property
    def time(self) -> Column | None:
        return F.col(TS) if TS in self.df.columns else None

    def sort_keys(self, backwards: bool = False) -> list[Column]:
        if self.order is None:
            raise QueryError("the command needs an order of rows, which an earlier command removed; add a sort")
        return [(F.col(c).asc_nulls_last() if falls == backwards else F.col(c).desc_nulls_last()) for c, falls in self.order]

    def select(self, *cols: Column) -> "Frame":
        """Visible columns replaced, hidden ones kept."""
        return self.with_df(self.df.select(*cols, *map(F.col, self.hidden)))

    def put(self, cols: dict[str, Column]) -> "Frame":
        """Sets columns in place; new ones come last among the visible."""
        have = self.columns
        out = [cols[c].alias(c) if c in cols else q(c) for c in have] + [v.alias(k) for k, v in cols.items() if k not in have]
        return self.select(*out)

    def result(self) -> DataFrame:
        """What a caller sees: ordered rows without hidden columns."""
        df = self.df
        if self.order is not None and self.order:
            df = df.orderBy(*self.sort_keys())
        if self.limit is not None:
            df = df.limit(self.limit)
        return df.select(*map(q, self.columns))


def events(df: DataFrame, time: str | None, tie: list[str], now: dt.datetime, start_ms: int | None = None, end_ms: int | None = None, **kw: object) -> Frame:
    """Newest-first events of a table; the range predicate stays on the plain time column so that the scan can use it."""
    if time is None:
        return Frame(df, None, now, start_ms, end_ms, **kw)  # type: ignore[arg-type]
    t = dict(df.dtypes)[time]
    if t.startswith("timestamp"):
        # compare in the column's own type: a bound as literal reaches the reader's statistics
        bound = lambda ms: F.lit(dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
        bound2 = (lambda ms: bound(ms)) if t == "timestamp_ntz" else (lambda ms: F.timestamp_micros(F.lit(ms * 1000).cast("bigint")))
        ms = (F.unix_date(q(time).cast("date")).cast("bigint") * 86_400_000 + (F.hour(q(time)) * 3_600_000 + F.minute(q(time)) * 60_000).cast("bigint") + F.floor(F.extract(F.lit("SECOND"), q(time)) * 1000).cast("bigint")) if t == "timestamp_ntz" else F.unix_millis(q(time))
        ms = ms.cast("bigint")
    else:
        bound2 = lambda m: F.lit(m)
        ms = q(time).cast("bigint")
    if start_ms is not None:
        df = df.where(q(time) >= bound2(start_ms))
    if end_ms is not None:
        df = df.where(q(time) < bound2(end_ms))
    df = df.withColumn(TS, ms)
    order = [(TS, True)]
    for i, c in enumerate(tie):
        df = df.withColumn(f"{HIDDEN}_tie{i}", q(c))
        order.append((f"{HIDDEN}_tie{i}", False))
    return Frame(df, tuple(order), now, start_ms, end_ms, **kw)  # type: ignore[arg-type]
