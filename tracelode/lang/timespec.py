"""Spans, relative times and default bucket widths."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from tracelode.lang.lex import QueryError

UTC = dt.timezone.utc
# Spellings of units.
UNITS = {
    **dict.fromkeys("ms millisecond milliseconds".split(), "ms"), **dict.fromkeys("cs centiseconds".split(), "cs"), **dict.fromkeys("ds deciseconds".split(), "ds"), **dict.fromkeys("us microseconds".split(), "us"),
    **dict.fromkeys("s sec secs second seconds".split(), "s"), **dict.fromkeys("m min mins minute minutes".split(), "m"), **dict.fromkeys("h hr hrs hour hours".split(), "h"),
    **dict.fromkeys("d day days".split(), "d"), **dict.fromkeys("w week weeks".split(), "w"), **dict.fromkeys("mon month months".split(), "mon"), **dict.fromkeys("q qtr qtrs quarter quarters".split(), "q"), **dict.fromkeys("y yr yrs year years".split(), "y"),
}
MS = {"us": 0.001, "ms": 1, "cs": 10, "ds": 100, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "mon": 30 * 86_400_000, "q": 120 * 86_400_000, "y": 365 * 86_400_000}
#: Widest range in ms and its timechart span in ms.
CHART_SPANS = [(15 * 60_000, 10_000), (3_600_000, 60_000), (4 * 3_600_000, 300_000), (86_400_000, 1_800_000), (7 * 86_400_000, 3_600_000), (180 * 86_400_000, 86_400_000)]


def span(s: str) -> tuple[float, str | None]:
    """``5m`` -> (5, "m"); ``10`` -> (10, None)."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)?\s*([A-Za-z]+)?", s.strip())
    if not m or not (m[1] or m[2]):
        raise QueryError(f"no span: {s!r}")
    if m[2] and m[2] not in UNITS and m[2].lower() not in UNITS:
        raise QueryError(f"unknown unit: {s!r}")
    return float(m[1] or 1), (UNITS.get(m[2]) or UNITS[m[2].lower()]) if m[2] else None


def span_ms(s: str) -> int:
    n, u = span(s)
    return int(n * MS[u or "s"])


def default_chart_span(range_ms: int) -> int:
    return next((w for r, w in CHART_SPANS if range_ms <= r), MS["mon"])  # type: ignore[return-value]


def _months(t: dt.datetime, n: int) -> dt.datetime:
    k = t.year * 12 + t.month - 1 + n
    y, m = divmod(k, 12)
    return t.replace(year=y, month=m + 1, day=min(t.day, calendar.monthrange(y, m + 1)[1]))


def snap(t: dt.datetime, u: str, weekday: int = 0) -> dt.datetime:
    if u in ("us", "ms", "cs", "ds"):
        return t
    t = t.replace(microsecond=0)
    if u == "s":
        return t
    t = t.replace(second=0)
    if u == "m":
        return t
    t = t.replace(minute=0)
    if u == "h":
        return t
    t = t.replace(hour=0)
    if u == "d":
        return t
    if u == "w":  # weeks begin on Sunday (w0)
        return t - dt.timedelta(days=(t.isoweekday() % 7 - weekday) % 7)
    t = t.replace(day=1)
    if u == "mon":
        return t
    if u == "q":
        return t.replace(month=(t.month - 1) // 3 * 3 + 1)
    return t.replace(month=1)


def resolve(s: str, now: dt.datetime) -> int:
    """Epoch ms of ``now``, ``-1d@h+2h``, ``@w1``, ``10/19/2024:14:00:00`` or an epoch number."""
    s = s.strip()
    if re.fullmatch(r"\d{9,}", s):
        return int(s) * (1000 if len(s) <= 11 else 1)
    m = re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4}):(\d{1,2}):(\d{2}):(\d{2})", s)
    if m:
        mo, d, y, h, mi, sec = map(int, m.groups())
        return int(dt.datetime(y, mo, d, h, mi, sec, tzinfo=UTC).timestamp() * 1000)
    rest = s[3:] if s.startswith("now") else s
    t, i = now, 0
    for m in re.finditer(r"([+-])(\d*)([A-Za-z]+)|@([A-Za-z]+?)([0-7]?)(?=$|[+@-])", rest):
        if m.start() != i:
            break
        i = m.end()
        u = UNITS.get((m[3] or m[4]).lower())
        if u is None:
            raise QueryError(f"unknown unit in {s!r}")
        if m[4]:
            t = snap(t, u, int(m[5] or 0) % 7)
            continue
        n = int(m[2] or 1) * (1 if m[1] == "+" else -1)
        if u in ("mon", "q", "y"):
            t = _months(t, n * {"mon": 1, "q": 3, "y": 12}[u])
        else:
            t = t + dt.timedelta(milliseconds=n * MS[u])
    if i != len(rest):
        raise QueryError(f"no time: {s!r}")
    return int(t.timestamp() * 1000)
