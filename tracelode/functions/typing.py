"""How values of dynamic type are read as numbers, texts and booleans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


class Val:
    """A column together with its static type; ``lit`` holds a literal's value."""

    __slots__ = ("c", "t", "lit")

    def __init__(self, c: Column, t: T.DataType, lit: object = None) -> None:
        self.c, self.t, self.lit = c, t, lit

    @property
    def is_num(self) -> bool:
        return isinstance(self.t, NUMERIC)

    @property
    def is_str(self) -> bool:
        return isinstance(self.t, T.StringType)

    @property
    def is_bool(self) -> bool:
        return isinstance(self.t, T.BooleanType)

    @property
    def is_mv(self) -> bool:
        return isinstance(self.t, T.ArrayType)

    @property
    def is_null(self) -> bool:
        return isinstance(self.t, T.NullType)


def lit(v: object) -> Val:
    if v is None:
        return Val(F.lit(None), T.NullType())
    t = T.BooleanType() if isinstance(v, bool) else T.DoubleType() if isinstance(v, (int, float)) else T.StringType()
    return Val(F.lit(float(v) if isinstance(t, T.DoubleType) else v), t, v)


def num(c: Column) -> Val:
    return Val(c, T.DoubleType())


def text(c: Column) -> Val:
    return Val(c, T.StringType())


def boolean(c: Column) -> Val:
    return Val(c, T.BooleanType())


def mv(c: Column) -> Val:
    return Val(c, T.ArrayType(T.StringType()))


def column(df: DataFrame, name: str) -> Val | None:
    for f in df.schema.fields:
        if f.name == name:
            return Val(q(name), f.dataType)
    return None


def as_num(v: Val) -> Column:
    """Double, or NULL where the value reads as no number."""
    if isinstance(v.t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(v.c.cast("timestamp")).cast("double")
    if v.is_num:
        return v.c.cast("double")
    if v.is_str:
        return F.trim(v.c).try_cast("double")
    return F.lit(None).cast("double")


def number_text(c: Column) -> Column:
    """A double as text: whole numbers without fraction."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.try_cast("bigint").cast("string")).otherwise(c.cast("string"))


def as_str(v: Val) -> Column:
    if v.is_mv:
        return F.array_join(v.c.cast("array<string>"), " ")
    if isinstance(v.t, (T.FloatType, T.DoubleType)):
        return number_text(v.c.cast("double"))
    if isinstance(v.t, (T.StructType, T.MapType)):
        return F.to_json(v.c)
    if isinstance(v.t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(v.c.cast("timestamp")).cast("string")
    return v.c.cast("string")


def as_bool(v: Val) -> Column:
    """Two-valued: NULL counts as false."""
    if v.is_bool:
        return F.coalesce(v.c, F.lit(False))
    if v.is_num:
        return F.coalesce(v.c != 0, F.lit(False))
    return F.coalesce(F.lower(as_str(v)).isin("true", "1"), F.lit(False))


def as_mv(v: Val) -> Column:
    return v.c.cast("array<string>") if v.is_mv else F.when(as_str(v).isNotNull(), F.array(as_str(v)))


def is_numeric_text(s: str) -> bool:
    return bool(re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", s.strip()))


def compare(a: Val, op: str, b: Val) -> Column:
    """Both sides as numbers if both read as such, else as texts; NULL gives NULL."""
    f = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if a.is_null or b.is_null:
        return F.lit(None).cast("boolean")
    if a.is_bool and b.is_bool:
        return f(a.c, b.c)
    if a.is_num and b.is_num:
        for x, y, turned in ((a, b, False), (b, a, True)):
            # an integral column against a whole literal: no cast, so that the reader can use it
            if isinstance(x.t, INTEGRAL) and x.lit is None and isinstance(y.lit, (int, float)) and float(y.lit).is_integer() and abs(y.lit) < 2**53:
                k = F.lit(int(y.lit))
                return f(k, x.c) if turned else f(x.c, k)
        return f(as_num(a), as_num(b))
    for x in (a, b):
        if isinstance(x.lit, str) and not is_numeric_text(x.lit):
            return f(as_str(a), as_str(b))
    x, y = as_num(a), as_num(b)
    return F.when(x.isNotNull() & y.isNotNull(), f(x, y)).otherwise(f(as_str(a), as_str(b)))
