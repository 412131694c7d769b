"""Log layouts, continuations, lookahead, edge cases."""

from tracelode.operators.logparse import days_from_civil, header_of, log_entries, parse_push

TS = "1610252346268818568"  # 2021-01-10T04:19:06.268818568Z


def one(*lines, ts=TS):
    return [e[:5] + (e[5],) for e in parse_push([ts] * len(lines), list(lines))]


def test_layouts():
    cases = {
        "I0110 04:19:04.776317   53165 alert_router.go:737] hello": (1610252344776, "info", "alert_router.go", "hello"),
        "[04:19:04.776] [warn ] [a.b] x [y]": (1610252344776, "warn", "a.b", "x [y]"),
        "[05:00:00.000] [fatal] [a-b] x": (1610168400000, "fatal", "a-b", "x"),  # the latest not after ts is the day before
        "2021-01-10 04:19:04,359 CRITICAL [quota] - block": (1610252344359, "fatal", "quota", "block"),
        "2021-01-10 04:19:04,359 \x1b[33mWARN\x1b[0m  [quota] - b": (1610252344359, "warn", "quota", "b"),
        "2021/01/10 04:19:04.1 ingest.flush: [TRACE] m": (1610252344100, "trace", "ingest.flush", "m"),
        "2021/01/10 04:19:04 ingest.flush: request done": (1610252344000, "unknown", "ingest.flush", "request done"),
        "10/Jan/2021:05:19:04 +0100 | ERROR | a_b | m | n": (1610252344000, "error", "a_b", "m | n"),
        "<165>Jan 10 04:19:04 host-1 prog.x[484]: m": (1610252344000, "info", "prog.x", "m"),
        "<0>Dec 31 23:59:59 host-1 prog[4]: m": (1609459199000, "fatal", "prog", "m"),
        '<12>1 2021-01-10T04:19:04.900Z h app 5 ID7 [a b="]"][c d="e"] m': (1610252344900, "warn", "app", "m"),
        "<15>1 - h app 5 - - m": (1610252346268, "debug", "app", "m"),
        'ts=2021-01-10T04:19:04Z level=err caller=f.go:12 msg="a \\"b\\""': (1610252344000, "error", "f.go", 'a "b"'),
        "level=warning ts=2021-01-10T04:19:04.5+01:00 component=c msg=hi": (1610248744500, "warn", "c", "hi"),
        "WARNING:scheduler:no time": (1610252346268, "warn", "scheduler", "no time"),
        '{"ts": 1610252344123, "level": 60, "name": "n", "msg": "m"}': (1610252344123, "fatal", "n", "m"),
        '{"time": "2021-01-10T04:19:04Z", "level": "INFO", "logger": "l", "msg": "m", "ctx": {"level": "error"}}': (1610252344000, "info", "l", "m"),
    }
    for line, want in cases.items():
        assert [e[2:] for e in one(line)] == [want], line


def test_no_headers():
    for line in [None, "", " 2021-01-10 04:19:04,359 INFO [q] - x", "INFO", "ERROR summary follows", "2021-01-06 totals per shard", "<end of x dump>", "[section 3]", "Caused by: a.B: ERROR", "SomeError: x:y", '{"a": 1}', "{", "}", "2021-02-30 04:19:04,359 INFO [q] - x", "<999>Jan 10 04:19:04 h p[1]: x", "\r", "SELECT a, count(*)", "WHERE:x:y", "00000000  38 22"]:
        assert one(line) == [], line


def test_continuations_and_objects():
    push = ["lost", "WARNING:a:first", "\tat x", "", None, "{", '  "time": "2021-01-10T04:19:04Z",', '  "level": "debug", "msg": "say \\"}\\" {", "logger": "z"', "}", "tail\r", '{"level": 30, "msg": "m", "ts": 1610252344}\nmore']
    got = one(*push)
    assert [(e[0], e[1]) for e in got] == [(1, 4), (5, 9), (10, 10)]
    assert got[0][5] == "first\n\tat x"
    assert got[1][2:5] == (1610252344000, "debug", "z") and got[1][5] == 'say "}" {\ntail'
    assert got[2][2] == 1610252344000 and got[2][5] == "m\nmore"
    # an object that a header interrupts is none
    assert [(e[0], e[1]) for e in one("WARNING:a:b", "{", "WARNING:a:c")] == [(0, 1), (2, 2)]


def test_operator(spark):
    s = "push_id bigint, stream map<string,string>, values array<struct<ts:string,line:string,metadata:map<string,string>>>, received_ms bigint"
    long = "WARNING:a:" + "x" * 200_000
    rows = [(1, None, [(TS, "INFO:a:b", None), (None, None, None)], 0), (2, {}, [], 0), (3, {}, None, 0), (4, {}, [("bad", "[01:02:03.000] [info] [c] d", None)], 0), (5, {}, [(TS, long, None)], 0), (6, {}, [(TS, long, None)], None)]
    df = spark.createDataFrame(rows, s)
    got = {r.push_id: r for r in log_entries(df).collect()}
    assert sorted(got) == [1, 4, 5, 6] and got[1].last_pos == 1
    assert got[4].ts_ms is None and got[4].component == "c"
    assert len(got[5].message) == 200_000
    assert log_entries(df, with_message=False).columns == ["push_id", "first_pos", "last_pos", "ts_ms", "level", "component"]
    assert log_entries(spark.createDataFrame([], s)).count() == 0


def test_days():
    import datetime as dt

    for d in range(-800_00, 400_00, 37):
        x = dt.date(1970, 1, 1) + dt.timedelta(days=d)
        assert days_from_civil(x.year, x.month, x.day) == d
    assert days_from_civil(2021, 2, 29) is None and header_of("", None) is None
