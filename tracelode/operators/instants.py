"""Mixed timestamp formats and zones to one UTC instant in milliseconds (problem 6).

An ordered cascade of anchored patterns splits a text into civil fields; a text
must match one pattern from its first to its last character (blanks around it
aside).  The fields are checked against the calendar, then turned into an
instant by the text's own offset or abbreviation, else by the zone looked up
for the row.  Civil times which the zone's clock skips or repeats are resolved
by policy ``strict``: they state no instant and are marked ``skipped`` or
``ambiguous``.  ``policy="earlier"``/``"later"`` picks a side instead.

Everything is built-in column expressions, so the whole operator is one
projection without shuffle: plans for 10 rows and for 10^12 rows are the same.

Defined results: NULL, empty or blank text, text of no known pattern, dates the
calendar lacks (30 Feb), unknown abbreviations, and local times without any
zone give ``utc_ms`` NULL and a ``status`` telling why.  Every input row gives
exactly one output row; repeated rows each give their own.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions.instants import int_to_ms

# Abbreviations in their European or North American sense, minutes east of UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
}

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "mon tue wed thu fri sat sun".split()

_MON = "(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_WKD = "(Mon(?:day)?|Tue(?:s(?:day)?)?|Wed(?:nesday)?|Thu(?:rs(?:day)?)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)"
_HMS = r"(\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?"
_ZONE = r"\s*([Zz]|[+-]\d{2}(?::?\d{2})?|(?<=\s)[A-Za-z]{2,5})?"

#: The cascade: name, pattern, and which group holds which field.
CASCADE: list[tuple[str, str, dict[str, int]]] = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt]|\s+){_HMS}{_ZONE}$", dict(y=1, mo=2, d=3, h=4, mi=5, s=6, f=7, z=8)),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}$", dict(y=1, mo=2, d=3, h=4, mi=5, s=6, f=7, z=8)),
    ("ymd_slash", rf"^(\d{{4}})/(\d{{2}})/(\d{{2}})\s+{_HMS}{_ZONE}$", dict(y=1, mo=2, d=3, h=4, mi=5, s=6, f=7, z=8)),
    ("dmy_dot", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})\s+{_HMS}{_ZONE}$", dict(d=1, mo=2, y=3, h=4, mi=5, s=6, f=7, z=8)),
    ("mdy_12h", rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+(\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:[.,](\d{{1,9}}))?\s*([ap]m)\b{_ZONE}$", dict(mo=1, d=2, y=3, h=4, mi=5, s=6, f=7, ap=8, z=9)),
    ("mdy_24h", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+{_HMS}{_ZONE}$", dict(mo=1, d=2, y=3, h=4, mi=5, s=6, f=7, z=8)),
    ("clf", rf"(?i)^(\d{{1,2}})/{_MON}/(\d{{4}}):{_HMS}{_ZONE}$", dict(d=1, mo=2, y=3, h=4, mi=5, s=6, f=7, z=8)),
    ("dmy_name", rf"(?i)^(?:{_WKD},?\s+)?(\d{{1,2}})[ -]{_MON}[ -](\d{{4}})\s+{_HMS}{_ZONE}$", dict(w=1, d=2, mo=3, y=4, h=5, mi=6, s=7, f=8, z=9)),
    ("mdy_name", rf"(?i)^(?:{_WKD},?\s+)?{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}})\s+{_HMS}{_ZONE}$", dict(w=1, mo=2, d=3, y=4, h=5, mi=6, s=7, f=8, z=9)),
    ("ctime", rf"(?i)^{_WKD}\s+{_MON}\s+(\d{{1,2}})\s+{_HMS}\s+(\d{{4}}){_ZONE}$", dict(w=1, mo=2, d=3, h=4, mi=5, s=6, f=7, y=8, z=9)),
    ("ctime_zone", rf"(?i)^{_WKD}\s+{_MON}\s+(\d{{1,2}})\s+{_HMS}\s+([A-Za-z]{{2,5}}|[+-]\d{{2}}:?\d{{2}})\s+(\d{{4}})$", dict(w=1, mo=2, d=3, h=4, mi=5, s=6, f=7, z=8, y=9)),
]

_FIELDS = ("y", "mo", "d", "h", "mi", "s", "f", "ap", "z", "w")
_DAY_US, _SEC_US = 86_400_000_000, 1_000_000


def known_zones() -> list[str]:
    """The lookup of zone names that count; a fixed list of some 600 names."""
    return sorted(zoneinfo.available_timezones())


def _const_map(d: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _blank_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s ﻿]+|[\s ﻿]+$", "")


def _local_us(us: Column, zone: Column) -> Column:
    """Civil microseconds shown by the zone's clock at instant ``us``."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def with_instant(
    df: DataFrame,
    text: str | Column,
    zone: str | Column,
    now_ms: str | Column,
    policy: str = "strict",
    prefix: str = "",
) -> DataFrame:
    """``df`` with ``{prefix}utc_ms``, ``{prefix}pattern`` and ``{prefix}status`` added.

    ``text`` is the text, ``zone`` the row's IANA zone (NULL or unknown: none),
    ``now_ms`` the instant that ``now`` stands for."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    t, zones, now = "__t", "__zone", "__now"
    x = df.withColumns({t: _blank_trim(col(text).cast("string")), now: col(now_ms).cast("bigint"), zones: F.when(col(zone).isin(known_zones()), col(zone))})
    c = F.col(t)

    # one string "y|mo|d|...": a single regex replacement for each row instead of one per field
    fields, pattern = None, None
    for name, pat, at in CASCADE:
        laid_out = F.regexp_replace(c, pat, name + "|" + "|".join(f"${at[k]}" if k in at else "" for k in _FIELDS))
        fields = F.when(c.rlike(pat), laid_out) if fields is None else fields.when(c.rlike(pat), laid_out)
    numeric, relative = r"^\d{10,19}(\.\d*)?$", r"^now(-\d{1,6}[mhd])?$"
    squeezed = F.regexp_replace(c, r"\s+", "")
    kind = F.when(c.rlike(numeric), F.lit("number")).when(squeezed.rlike(relative), F.lit("relative")).otherwise(fields)
    # the generator keeps the optimizer from copying the cascade into each use of its fields
    x = x.withColumn("__f", F.explode(F.array(F.coalesce(kind, F.lit("")))))
    x = x.withColumn("__f", F.explode(F.array(F.split("__f", r"\|", -1))))
    x = x.withColumn("__p", F.nullif(F.col("__f")[0], F.lit("")))
    f = lambda k: F.get(F.col("__f"), F.lit(_FIELDS.index(k) + 1))
    num = lambda k: f(k).try_cast("int")
    month = F.coalesce(num("mo"), _const_map({m: i + 1 for i, m in enumerate(MONTHS)})[F.lower(F.substring(f("mo"), 1, 3))])
    h12 = f("ap") != ""
    hour = F.when(~h12, num("h")).when(num("h").between(1, 12), num("h") % 12 + F.when(F.lower(f("ap")) == "pm", 12).otherwise(0))
    x = x.withColumns({"__mo": month, "__h": hour})
    valid = F.col("__h").between(0, 23) & num("mi").between(0, 59) & num("s").between(0, 59)
    date = F.to_date(F.try_make_timestamp_ntz(num("y"), F.col("__mo"), num("d"), F.lit(0), F.lit(0), F.lit(0)))
    right_day = (f("w") == "") | (_const_map({d: i for i, d in enumerate(DAYS)})[F.lower(F.substring(f("w"), 1, 3))] == F.weekday(date))
    ms_of_sec = F.rpad(F.substring(f("f"), 1, 3), 3, "0").try_cast("int")
    x = x.withColumn("__civil", F.explode(F.array(F.when(valid & right_day, F.unix_date(date).cast("bigint") * _DAY_US + (F.col("__h") * 3600 + num("mi") * 60 + num("s")).cast("bigint") * _SEC_US + F.coalesce(ms_of_sec, F.lit(0)) * 1000))))

    z = F.upper(f("z"))
    digits = F.regexp_replace(z, "[^0-9]", "")
    off_h, off_m = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("int"), F.lit(0))
    offset = F.when(z.rlike("^[+-]"), F.when((off_h <= 15) & (off_m < 60), (off_h * 60 + off_m) * F.when(F.startswith(z, F.lit("-")), -1).otherwise(1))).otherwise(_const_map(ABBREVIATIONS)[z])
    x = x.withColumn("__off", F.when(z != "", offset.cast("bigint")))

    civil, zc = F.col("__civil"), F.col(zones)
    # the zone's offsets a day before and after bracket any single change of the clock
    before = civil - (_local_us(civil - _DAY_US, zc) - (civil - _DAY_US))
    after = civil - (_local_us(civil + _DAY_US, zc) - (civil + _DAY_US))
    x = x.withColumns({"__u1": before, "__u2": after})
    u1, u2 = F.col("__u1"), F.col("__u2")
    x = x.withColumns({"__ok1": _local_us(u1, zc) == civil, "__ok2": _local_us(u2, zc) == civil})
    ok1, ok2 = F.col("__ok1"), F.col("__ok2")
    side = {"strict": F.lit(None).cast("bigint"), "earlier": F.least(u1, u2), "later": F.greatest(u1, u2)}[policy]
    zoned = F.when(ok1 & ok2 & (u1 != u2), side).when(ok1, u1).when(ok2, u2).otherwise(side)
    zoned_status = F.when(ok1 & ok2 & (u1 != u2), F.lit("ambiguous")).when(ok1 | ok2, F.lit("ok")).otherwise(F.lit("skipped"))

    n, unit = F.regexp_extract(squeezed, r"^now-(\d+)", 1).try_cast("bigint"), F.regexp_extract(squeezed, "([mhd])$", 1)
    back = F.coalesce(n, F.lit(0)) * F.coalesce(_const_map({"m": 60_000, "h": 3_600_000, "d": 86_400_000})[unit], F.lit(0))
    p, has_own = F.col("__p"), f("z") != ""
    by_number = _numeric_text_ms(c)
    ms = (
        F.when(p == "number", by_number)
        .when(p == "relative", F.col(now) - back)
        .when(has_own, F.floor((civil - F.col("__off") * 60 * _SEC_US) / 1000).cast("bigint"))
        .otherwise(F.floor(zoned / 1000).cast("bigint"))
    )
    status = (
        F.when(c.isNull() | (c == ""), "empty")
        .when(p.isNull(), "no pattern")
        .when(p == "number", F.when(by_number.isNull(), "no unit").otherwise("ok"))
        .when(p == "relative", F.when(F.col(now).isNull(), "no reference").otherwise("ok"))
        .when(civil.isNull(), "not in calendar")
        .when(has_own, F.when(F.col("__off").isNull(), "unknown offset").otherwise("ok"))
        .when(zc.isNull(), "no zone")
        .otherwise(zoned_status)
    )
    out = x.withColumns({f"{prefix}utc_ms": ms, f"{prefix}pattern": p, f"{prefix}status": status})
    return out.drop(*[k for k in out.columns if k.startswith("__") and k not in df.columns])


def _numeric_text_ms(c: Column) -> Column:
    """ms of a digit text, with or without fraction; the unit follows from the integer part."""
    whole = F.regexp_extract(c, r"^(\d+)", 1).try_cast("bigint")
    frac = F.rpad(F.substring(F.regexp_extract(c, r"\.(\d*)$", 1), 1, 3), 3, "0").try_cast("int")
    base = int_to_ms(whole)
    return F.when(whole == F.call_function("div", base, F.lit(1000)), base + F.coalesce(frac, F.lit(0))).otherwise(base)


def all_instants(epoch_inputs: DataFrame, otlp_points: DataFrame, segmeta: DataFrame) -> DataFrame:
    """One row per record of the three tables: ``src, rec_id, utc_ms, pattern, status``.

    Records of ``epoch_inputs`` count only if exactly one of their two flags
    holds (NULL flags do not hold); otherwise status is ``flags``."""
    e = epoch_inputs.select("rec_id", "int_value", "string_value", "zone", "received_ms", F.coalesce("is_int", F.lit(False)).alias("i"), F.coalesce("is_string", F.lit(False)).alias("s"))
    e = with_instant(e, F.when(F.col("s") & ~F.col("i"), F.col("string_value")), "zone", "received_ms")
    as_int = F.col("i") & ~F.col("s")
    by_int = int_to_ms(F.col("int_value"))
    e = e.select(
        F.lit("epoch_inputs").alias("src"),
        "rec_id",
        F.when(as_int, by_int).otherwise(F.col("utc_ms")).alias("utc_ms"),
        F.when(as_int, F.lit("integer")).otherwise(F.col("pattern")).alias("pattern"),
        F.when(F.col("i") == F.col("s"), "flags").when(as_int, F.when(by_int.isNull(), "no unit").otherwise("ok")).otherwise(F.col("status")).alias("status"),
    )
    return e.unionByName(integer_instants(otlp_points, "otlp_points", "rec_id", "time_unix_nano")).unionByName(integer_instants(segmeta, "segmeta", "seg_id", "earliest_epoch_ms"))


def integer_instants(df: DataFrame, src: str, id_col: str, value_col: str) -> DataFrame:
    ms = int_to_ms(F.col(value_col))
    return df.select(F.lit(src).alias("src"), F.col(id_col).alias("rec_id"), ms.alias("utc_ms"), F.lit("integer").alias("pattern"), F.when(ms.isNull(), "no unit").otherwise("ok").alias("status"))
