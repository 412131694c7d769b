"""Log lines of many layouts to entries with time, level, component, message (problem 4).

A deterministic character-level machine cuts the head of a value into tokens
(numbers, words, blanks, quoted strings, escape sequences, single delimiters);
its first tokens pick the one grammar that can apply, and the grammar assigns
the fields.  A value that no grammar accepts is a continuation and is attached
to the entry before it; a ``{`` opens a lookahead state that reads on, over
further values, until the braces balance.

A push is parsed by itself, so the operator is a narrow map: no shuffle, any
number of pushes, one push in memory at a time (Arrow hands over batches).

Defined results: NULL lines are continuations without text; values before the first header of
a push give no entry; NULL or empty ``values`` give none; a ``ts`` that is no
number leaves times without a date NULL; dates the calendar lacks make no
header; repeated pushes are parsed as often as they come.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.instants import AFTER_SEC, FIRST_SEC

# How programs spell levels.
LEVELS = {
    **dict.fromkeys(["t", "trace", "trc", "finest", "10"], "trace"),
    **dict.fromkeys(["d", "debug", "dbg", "fine", "verbose", "20"], "debug"),
    **dict.fromkeys(["i", "info", "information", "notice", "30"], "info"),
    **dict.fromkeys(["w", "warn", "warning", "wrn", "40"], "warn"),
    **dict.fromkeys(["e", "err", "error", "severe", "50"], "error"),
    **dict.fromkeys(["f", "c", "fatal", "critical", "crit", "panic", "alert", "emerg", "emergency", "60"], "fatal"),
}
SEVERITIES = ("fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug")
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "t", "datetime")
LEVEL_KEYS = ("level", "severity", "lvl", "loglevel", "levelname")
COMPONENT_KEYS = ("logger", "component", "name", "module", "program", "app", "service")
SOURCE_KEYS = ("caller", "source", "file")
MESSAGE_KEYS = ("msg", "message", "text")

# ---- the machine: states, character classes, transitions --------------------------------------
NUM, WORD, BLANK, QUOTED, ESCAPE, MARK = "num", "word", "blank", "quoted", "escape", "mark"
_START, _NUM, _WORD, _BLANK, _Q, _QE, _QEND, _E1, _E2, _EEND, _MARK = range(11)
_KIND = {_NUM: NUM, _WORD: WORD, _BLANK: BLANK, _Q: QUOTED, _QE: QUOTED, _QEND: QUOTED, _E1: ESCAPE, _E2: ESCAPE, _EEND: ESCAPE, _MARK: MARK}
_C_DIGIT, _C_LETTER, _C_BLANK, _C_QUOTE, _C_BACK, _C_ESC, _C_OPEN, _C_OTHER = range(8)


def _class_of(ch: str) -> int:
    if "0" <= ch <= "9":
        return _C_DIGIT
    if ch.isalpha() or ch == "_":
        return _C_LETTER
    return {" ": _C_BLANK, "\t": _C_BLANK, '"': _C_QUOTE, "\\": _C_BACK, "\x1b": _C_ESC, "[": _C_OPEN}.get(ch, _C_OTHER)


_CLASS = [_class_of(chr(i)) for i in range(128)]
_FIRST = {_C_DIGIT: _NUM, _C_LETTER: _WORD, _C_BLANK: _BLANK, _C_QUOTE: _Q, _C_ESC: _E1, _C_BACK: _MARK, _C_OPEN: _MARK, _C_OTHER: _MARK}
_STEP: dict[int, dict[int, int]] = {
    _NUM: {_C_DIGIT: _NUM},
    _WORD: {_C_LETTER: _WORD, _C_DIGIT: _WORD},
    _BLANK: {_C_BLANK: _BLANK},
    _Q: {c: _Q for c in range(8)} | {_C_QUOTE: _QEND, _C_BACK: _QE},
    _QE: {c: _Q for c in range(8)},
    _QEND: {},
    _E1: {_C_OPEN: _E2},
    _E2: {_C_DIGIT: _E2, _C_OTHER: _E2, _C_LETTER: _EEND},
    _EEND: {},
    _MARK: {},
}


#: The same as a table, -1 where a token ends.
_ROWS = [[_STEP.get(state, {}).get(c, -1) for c in range(8)] for state in range(11)]


class Tokens:
    """Tokens of one value, made as the grammar asks for them; escape sequences are skipped."""

    __slots__ = ("s", "at", "kind", "text", "start")

    def __init__(self, s: str) -> None:
        self.s, self.at = s, 0
        self.next()

    def next(self) -> None:
        s, i, n = self.s, self.at, len(self.s)
        while True:
            if i >= n:
                self.kind, self.text, self.start, self.at = "", "", n, n
                return
            o = ord(s[i])
            state = _FIRST[_CLASS[o] if o < 128 else _class_of(s[i])]
            row = _ROWS[state]
            j = i + 1
            while j < n:
                o = ord(s[j])
                to = row[_CLASS[o] if o < 128 else _class_of(s[j])]
                if to != state:
                    if to < 0:
                        break
                    state, row = to, _ROWS[to]
                j += 1
            kind = _KIND[state]
            if kind != ESCAPE:
                break
            i = j
        self.kind, self.text, self.start, self.at = kind, s[i:j], i, j

    # what grammars use; each returns None where the token is another
    def mark(self, ch: str) -> bool:
        if self.kind == MARK and self.text == ch:
            self.next()
            return True
        return False

    def number(self, *lengths: int) -> int | None:
        if self.kind == NUM and (not lengths or len(self.text) in lengths):
            v = int(self.text)
            self.next()
            return v
        return None

    def word(self) -> str | None:
        if self.kind == WORD:
            w = self.text
            self.next()
            return w
        return None

    def blank(self) -> bool:
        if self.kind == BLANK:
            self.next()
            return True
        return False

    def run(self, stop: str) -> str | None:
        """Text up to a blank or one of ``stop``; None if empty."""
        a = self.start
        while self.kind and self.kind != BLANK and not (self.kind == MARK and (self.text in stop or self.text in "\r\n")):
            self.next()
        return self.s[a : self.start] or None

    def rest(self) -> str:
        return self.s[self.start :]


# ---- times -----------------------------------------------------------------------------------
def days_from_civil(y: int, m: int, d: int) -> int | None:
    """Days since 1970-01-01, None if the calendar lacks the date."""
    if not (1 <= m <= 12 and 1 <= d <= 31 and y >= 1):
        return None
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    if d > (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]:
        return None
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _clock(t: Tokens, fraction: str = ".,") -> int | None:
    """hh:mm:ss with optional fraction, as nanoseconds of the day."""
    h = t.number(2)
    if h is None or not t.mark(":"):
        return None
    m = t.number(2)
    if m is None or not t.mark(":"):
        return None
    s = t.number(2)
    if s is None or h > 23 or m > 59 or s > 59:
        return None
    ns = ((h * 60 + m) * 60 + s) * 1_000_000_000
    if t.kind == MARK and t.text in fraction:
        t.next()
        if t.kind != NUM:
            return None
        ns += int(t.text[:9].ljust(9, "0"))
        t.next()
    return ns


def _offset(t: Tokens) -> int | None:
    """Nanoseconds east of UTC of ``Z``, ``+hh``, ``+hhmm``, ``+hh:mm``; 0 if there is none."""
    if t.kind == WORD and t.text in "Zz":
        t.next()
        return 0
    if t.kind == MARK and t.text in "+-":
        sign = -1 if t.text == "-" else 1
        t.next()
        if t.kind != NUM or len(t.text) not in (2, 4):
            return None
        h, m = int(t.text[:2]), int(t.text[2:] or 0)
        whole = len(t.text) == 4
        t.next()
        if not whole and t.mark(":"):
            m = t.number(2)  # type: ignore[assignment]
            if m is None:
                return None
        return sign * (h * 60 + m) * 60_000_000_000
    return 0


_DAY_NS = 86_400_000_000_000


def _iso(t: Tokens) -> int | None:
    """yyyy-mm-ddThh:mm:ss[.f][offset], as nanoseconds since the epoch."""
    y = t.number(4)
    if y is None or not t.mark("-"):
        return None
    m = t.number(2)
    if m is None or not t.mark("-"):
        return None
    # "07T04" is cut as number 07, word T04: the machine keeps digits in words
    d = t.number(2)
    days = d is not None and days_from_civil(y, m, d)
    if days is None or days is False:
        return None
    if t.kind == WORD and t.text[0] in "Tt" and t.text[1:].isdigit():
        u = Tokens(t.s[t.start + 1 :])
        shift = t.start + 1
        ns = _clock(u)
        if ns is None:
            return None
        off = _offset(u)
        t.at = shift + u.start
        t.next()
    else:
        if not t.blank():
            return None
        ns = _clock(t)
        off = None if ns is None else _offset(t)
    return None if ns is None or off is None else days * _DAY_NS + ns - off


def _latest(ts: int | None, make: Callable[[int], int | None], back: range) -> int | None:
    """The latest instant ``make(k)`` for ``k`` in ``back`` that is not after ``ts``."""
    if ts is None:
        return None
    for k in back:
        v = make(k)
        if v is not None and v <= ts:
            return v
    return None


# ---- grammars: (time ns | None, level, component, offset of the message) or None --------------
Header = tuple[int | None, str, str | None, object]


def _level(w: str | None) -> str:
    return LEVELS.get((w or "").lower(), "unknown")


def _year_of(ts: int | None) -> int:
    y = 1970 + (ts or 0) // (365 * _DAY_NS) + 1
    while ts is not None and y > 1 and days_from_civil(y, 1, 1) * _DAY_NS > ts:  # type: ignore[operator]
        y -= 1
    return y


def _yearless(ts: int | None, month: int, day: int, ns: int) -> int | None:
    def at(y: int) -> int | None:
        d = days_from_civil(y, month, day)
        return None if d is None else d * _DAY_NS + ns

    y = _year_of(ts)
    return _latest(ts, at, range(y, y - 9, -1))


def _g_letter(t: Tokens, ts: int | None) -> Header | None:
    """``I0110 04:19:08.268348   53165 file.go:536] message``"""
    w = t.text
    if len(w) != 5 or not w[1:].isdigit() or _level(w[0]) == "unknown":
        return None
    month, day = int(w[1:3]), int(w[3:])
    if days_from_civil(2000, month, day) is None:
        return None
    t.next()
    ns = _clock(t) if t.blank() else None
    if ns is None or not t.blank() or t.number() is None or not t.blank():
        return None
    source = t.run(":]")
    if source is None or not t.mark(":") or t.number() is None or not t.mark("]"):
        return None
    t.blank()
    return _yearless(ts, month, day, ns), _level(w[0]), source, t.start


def _g_bracket(t: Tokens, ts: int | None) -> Header | None:
    """``[20:47:58.166] [warn ] [component] message``; also with a date in the first bracket"""
    t.next()
    if t.kind == NUM and len(t.text) == 4:
        when = _iso(t)
    else:
        ns = _clock(t)
        if ns is None:
            return None
        when = None if ts is None else _latest(ts, lambda k: (ts // _DAY_NS - k) * _DAY_NS + ns, range(0, 2))
    if not t.mark("]") or not t.blank() or not t.mark("["):
        return None
    level = t.word()
    t.blank()
    if level is None or not t.mark("]") or not t.blank() or not t.mark("["):
        return None
    comp = t.run("]")
    if comp is None or not t.mark("]"):
        return None
    t.blank()
    return when, _level(level), comp, t.start


def _g_dashed(t: Tokens, ts: int | None) -> Header | None:
    """``2021-01-10 19:24:59,359 ERROR [component] - message``"""
    when = _iso(t)
    if when is None or not t.blank():
        return None
    level = t.word()
    if level is not None:
        t.blank()
    if not t.mark("["):
        return None
    comp = t.run("]")
    if comp is None or not t.mark("]") or not t.blank() or not t.mark("-"):
        return None
    t.blank()
    return when, _level(level), comp, t.start


def _g_slashed(t: Tokens, ts: int | None) -> Header | None:
    """``2021/01/05 08:18:23[.f] component: [INFO] message``, the level may be missing"""
    y = t.number(4)
    if y is None or not t.mark("/"):
        return None
    m = t.number(2)
    if m is None or not t.mark("/"):
        return None
    d = t.number(2)
    days = None if d is None else days_from_civil(y, m, d)
    if days is None or not t.blank():
        return None
    ns = _clock(t)
    if ns is None or not t.blank():
        return None
    comp = t.run(":")
    if comp is None or not t.mark(":") or not t.blank():
        return None
    at, level = t.start, None
    if t.mark("["):
        level = t.word()
        if level is not None and t.mark("]") and _level(level) != "unknown":
            t.blank()
            at = t.start
        else:
            level = None
    return days * _DAY_NS + ns, _level(level), comp, at


def _g_barred(t: Tokens, ts: int | None) -> Header | None:
    """``09/Jan/2021:13:15:15 +0100 | INFO | component | message``"""
    d = t.number(2)
    if d is None or not t.mark("/"):
        return None
    m = MONTHS.get(t.word() or "")
    if m is None or not t.mark("/"):
        return None
    y = t.number(4)
    days = None if y is None else days_from_civil(y, m, d)
    if days is None or not t.mark(":"):
        return None
    ns = _clock(t)
    if ns is None:
        return None
    t.blank()
    off = _offset(t)
    t.blank()
    if off is None or not t.mark("|"):
        return None
    t.blank()
    level = t.run("|")
    t.blank()
    if not t.mark("|"):
        return None
    t.blank()
    comp = t.run("|")
    t.blank()
    if comp is None or not t.mark("|"):
        return None
    t.blank()
    return days * _DAY_NS + ns - off, _level(level), comp, t.start


def _g_syslog(t: Tokens, ts: int | None) -> Header | None:
    """``<165>Jan  8 07:10:20 host program[484]: message`` and ``<15>1 time host program pid id data message``"""
    t.next()
    pri = t.number(1, 2, 3)
    if pri is None or pri > 191 or not t.mark(">"):
        return None
    level = SEVERITIES[pri % 8]
    if t.kind == NUM:
        if t.number() is None or not t.blank():
            return None
        if t.kind == MARK and t.text == "-":
            t.next()
            when = ts
        else:
            when = _iso(t)
            if when is None:
                return None
        fields = []
        for _ in range(4):  # host, program, process, message id
            if not t.blank():
                return None
            fields.append(t.run(""))
        if None in fields or not t.blank():
            return None
        if t.mark("["):  # structured data: quoted values may hold brackets
            depth = 1
            while depth or (t.kind == MARK and t.text == "["):
                if not t.kind:
                    return None
                depth += (t.kind == MARK and t.text == "[") - (t.kind == MARK and t.text == "]")
                t.next()
        elif not t.mark("-"):
            return None
        t.blank()
        return when, level, None if fields[1] == "-" else fields[1], t.start
    month = MONTHS.get(t.word() or "")
    if month is None or not t.blank():
        return None
    day = t.number(1, 2)
    if day is None or days_from_civil(2000, month, day) is None or not t.blank():
        return None
    ns = _clock(t)
    if ns is None or not t.blank() or t.run("") is None or not t.blank():
        return None
    comp = t.run("[:")
    if comp is None:
        return None
    if t.mark("["):
        if t.run("]") is None or not t.mark("]"):
            return None
    if not t.mark(":"):
        return None
    t.blank()
    return _yearless(ts, month, day, ns), level, comp, t.start


def _unquote(s: str) -> str:
    if len(s) >= 2 and s[0] == s[-1] == '"':
        try:
            return json.loads(s)
        except ValueError:
            return s[1:-1]
    return s


def _g_pairs(t: Tokens, ts: int | None) -> Header | None:
    """``ts=2021-01-09T18:10:28Z level=debug caller=f.go:76 component=gateway msg="..."`` in any order"""
    found: dict[str, str] = {}
    message: object = None
    while t.kind == WORD:
        key = t.word()
        while t.kind == MARK and t.text in ".-@":
            t.next()
            key = f"{key}.{t.word() or ''}"
        if not t.mark("="):
            break
        a = t.start
        value = None
        if t.kind == QUOTED:
            t.next()
            value = _unquote(t.s[a : t.start])
        else:
            value = t.run("") or ""
        if key in MESSAGE_KEYS and message is None:
            message = (value, t.start)
            break
        found.setdefault(key, value)  # type: ignore[arg-type]
        if not t.blank():
            break
    when = next((found[k] for k in TIME_KEYS if k in found), None)
    level = next((found[k] for k in LEVEL_KEYS if k in found), None)
    if (when is None) + (level is None) + (message is None) > 1:
        return None
    comp = next((found[k] for k in COMPONENT_KEYS if found.get(k)), None)
    if comp is None:
        source = next((found[k] for k in SOURCE_KEYS if found.get(k)), None)
        comp = source.rsplit(":", 1)[0] if source and source.rsplit(":", 1)[-1].isdigit() else source
    ns = ts if when is None else _json_time(when)
    if when is not None and ns is None:
        return None
    return ns, _level(level), comp, message if message is not None else t.start


def _g_colons(t: Tokens, ts: int | None) -> Header | None:
    """``WARNING:scheduler:message``: no time at all"""
    level = t.word()
    if _level(level) == "unknown" or len(level or "") < 3 or not (level or "").isupper() or not t.mark(":"):
        return None
    comp = t.run(":")
    if comp is None or not t.mark(":"):
        return None
    return ts, _level(level), comp, t.start


def _json_time(v: object) -> int | None:
    """Nanoseconds of a JSON time: a number whose unit its size shows, or an ISO text."""
    if isinstance(v, str):
        t = Tokens(v.strip())
        if t.kind == NUM and len(t.text) >= 10 and t.at == len(t.s):
            return _json_time(int(t.text))
        ns = _iso(t)
        return None if ns is None or t.kind else ns
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return None
    for unit in (1_000_000_000, 1_000_000, 1_000, 1):
        if FIRST_SEC <= v * unit / 1e9 < AFTER_SEC:
            return int(v * unit) if isinstance(v, int) else int(v * 1000) * (unit // 1000 or 1)
    return None


def _of_object(o: dict, ts: int | None) -> Header | None:
    low = {str(k).lower(): v for k, v in o.items()}
    pick = lambda keys: next((low[k] for k in keys if low.get(k) is not None), None)
    when, level, comp, message = pick(TIME_KEYS), pick(LEVEL_KEYS), pick(COMPONENT_KEYS), pick(MESSAGE_KEYS)
    if sum(x is not None for x in (when, level, message)) < 2:
        return None
    ns = _json_time(when)
    if comp is None and (source := pick(SOURCE_KEYS)) is not None:
        head, _, line = str(source).rpartition(":")
        comp = head if head and line.isdigit() else source
    name = str(level) if not isinstance(level, float) else str(int(level))
    return (ts if when is None else ns), _level(name), None if comp is None else str(comp), message if message is None else str(message)


_GRAMMARS = {"[": _g_bracket, "<": _g_syslog}


def header_of(line: str, ts: int | None) -> Header | None:
    """The header at the first character of a value other than a JSON object."""
    if not line or line[0] in " \t\r\n":
        return None
    t = Tokens(line)
    if t.kind == MARK:
        g = _GRAMMARS.get(t.text)
        return g(t, ts) if g else None
    if t.kind == NUM:
        follows = line[t.at : t.at + 1]
        if len(t.text) == 4:
            return _g_dashed(t, ts) if follows == "-" else _g_slashed(t, ts) if follows == "/" else None
        return _g_barred(t, ts) if len(t.text) == 2 and follows == "/" else None
    if t.kind == WORD:
        follows = line[t.at : t.at + 1]
        if follows == "=":
            return _g_pairs(t, ts)
        if follows == ":":
            return _g_colons(t, ts)
        if follows == " " and len(t.text) == 5:
            return _g_letter(t, ts)
    return None


_SPLIT_AT_EOL = str.maketrans("", "", "\r")


def _object_end(depth: int, in_string: bool, s: str) -> tuple[int, bool, int]:
    """Reads ``s`` from a brace state on; the index after the closing brace, or -1."""
    i, n = 0, len(s)
    while i < n:
        ch = s[i]
        if in_string:
            if ch == "\\":
                i += 1
            elif ch == '"':
                in_string = False
        elif ch == '"':
            in_string = True
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if not depth:
                return 0, False, i + 1
        i += 1
    return depth, in_string, -1


def _object_header(lines: list[str | None], i: int, ts: int | None) -> tuple[Header, int, str] | None:
    """A JSON object that begins at value ``i``: its header, its last value, what follows it there."""
    depth, in_string, j, parts = 0, False, i, []
    while j < len(lines):
        s = lines[j] or ""
        if j > i and header_of(s, ts) is not None:
            return None
        depth, in_string, end = _object_end(depth, in_string, s)
        if end >= 0:
            parts.append(s[:end])
            try:
                o = json.loads("\n".join(parts), strict=False)
            except ValueError:
                return None
            h = _of_object(o, ts) if isinstance(o, dict) else None
            return None if h is None else (h, j, s[end:])
        parts.append(s)
        j += 1
    return None


def parse_push(stamps: list[str | None], lines: list[str | None]) -> Iterator[tuple[int, int, int | None, str, str | None, str]]:
    """Entries of one push: first_pos, last_pos, ts_ms, level, component, message."""
    entry: list | None = None
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        raw = stamps[i]
        ts = int(raw) if raw and raw.isascii() and raw.isdigit() else None
        found, last, rest = None, i, ""
        if line:
            if line[0] == "{":
                if (x := _object_header(lines, i, ts)) is not None:
                    found, last, rest = x
            else:
                found = header_of(line, ts)
        if found is not None:
            if entry is not None:
                yield _done(entry, i - 1)
            when, level, comp, m = found
            if isinstance(m, int):
                text = line[m:]  # type: ignore[index]
            elif isinstance(m, tuple):
                text = m[0] + line[m[1] :]  # type: ignore[index]
            else:
                text = (m or "") + rest
            entry = [i, None if when is None else when // 1_000_000, level, comp, [text]]
            i = last + 1
            continue
        if entry is not None:
            entry[4].append(line or "")
        i += 1
    if entry is not None:
        yield _done(entry, n - 1)


def _done(entry: list, last: int) -> tuple[int, int, int | None, str, str | None, str]:
    first, ms, level, comp, parts = entry
    return first, last, ms, level, comp, "\n".join(p.rstrip("\r") for p in parts).rstrip("\n")


ENTRY_SCHEMA = "push_id bigint, first_pos int, last_pos int, ts_ms bigint, level string, component string, message string"


def _parser(with_message: bool):
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["push_id", "first_pos", "last_pos", "ts_ms", "level", "component", "message"]
    k = 7 if with_message else 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for push, stamps, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for e in parse_push(stamps, lines):
                    out[0].append(push)
                    for c, v in zip(out[1:], e):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:k], types)], names=names[:k])

    return run


def log_entries(streams: DataFrame, with_message: bool = True) -> DataFrame:
    """One row per log entry of ``push_id, values(ts, line, ...)``; other columns are left aside.

    ``with_message=False`` leaves the message out where only the header's fields are wanted."""
    x = streams.where(F.size("values") > 0).select(
        F.col("push_id").cast("bigint"),
        F.transform("values", lambda v: v["ts"].cast("string")).alias("stamps"),
        F.transform("values", lambda v: v["line"]).alias("lines"),
    )
    schema = ENTRY_SCHEMA if with_message else ENTRY_SCHEMA.rsplit(",", 1)[0]
    return x.mapInArrow(_parser(with_message), schema)
