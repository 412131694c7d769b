"""Timestamp texts and zones."""

import datetime as dt
import zoneinfo

from tracelode.functions.instants import int_to_ms
from tracelode.operators.instants import all_instants, with_instant

S = "t string, z string, now bigint"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, 1_700_000_000_000) for i, r in enumerate(rows)], "i int, " + S)
    return [(r.utc_ms, r.status) for r in with_instant(df, "t", "z", "now", **kw).orderBy("i").collect()]


def ms(*a, tz="UTC"):
    return int(dt.datetime(*a, tzinfo=zoneinfo.ZoneInfo(tz)).timestamp() * 1000)


def test_formats(spark):
    B = "Europe/Berlin"
    cases = [
        ("2021-03-04T05:06:07Z", None, ms(2021, 3, 4, 5, 6, 7)), ("2021-03-04t05:06:07.9996z", B, ms(2021, 3, 4, 5, 6, 7) + 999), ("2021-03-04 05:06:07,5", B, ms(2021, 3, 4, 4, 6, 7) + 500),
        ("20210304T050607", B, ms(2021, 3, 4, 4, 6, 7)), ("20210304T050607 PST", B, ms(2021, 3, 4, 13, 6, 7)), ("2021/03/04 05:06:07 EDT", None, ms(2021, 3, 4, 9, 6, 7)),
        ("04.03.2021 05:06:07", B, ms(2021, 3, 4, 4, 6, 7)), ("03/04/2021 12:06:07 AM", "UTC", ms(2021, 3, 4, 0, 6, 7)), ("03/04/2021 12:06:07 pm GMT", None, ms(2021, 3, 4, 12, 6, 7)),
        ("04/Mar/2021:05:06:07 +0545", None, ms(2021, 3, 3, 23, 21, 7)), ("4 March 2021 05:06:07 CEST", None, ms(2021, 3, 4, 3, 6, 7)), ("Mar 4, 2021 05:06:07", "UTC", ms(2021, 3, 4, 5, 6, 7)),
        ("Thu, 04 Mar 2021 05:06:07 GMT", None, ms(2021, 3, 4, 5, 6, 7)), ("Thu Mar 4 05:06:07 2021 -0700", None, ms(2021, 3, 4, 12, 6, 7)), ("\t2021-03-04 05:06:07+01 ", None, ms(2021, 3, 4, 4, 6, 7)),
        ("1614834367", None, 1614834367000), ("1614834367.98765", None, 1614834367987), ("1614834367123456789", None, 1614834367123), ("now", None, 1_700_000_000_000), (" now - 2 h", None, 1_700_000_000_000 - 7_200_000), ("now-3d", B, 1_700_000_000_000 - 3 * 86_400_000),
    ]
    got = run(spark, [(t, z) for t, z, _ in cases])
    assert [(t, g) for (t, _, _), g in zip(cases, got)] == [(t, (w, "ok")) for t, _, w in cases]


def test_no_instants(spark):
    cases = [
        (None, "UTC", "empty"), ("  ", "UTC", "empty"), ("soon", "UTC", "no pattern"), ("x" * 100_000, None, "no pattern"), ("2021-02-30 01:02:03Z", None, "not in calendar"), ("2021-03-04 24:00:00Z", None, "not in calendar"), ("13/40/2021 1:02:03 am", "UTC", "not in calendar"),
        ("03/04/2021 13:06:07 AM", "UTC", "not in calendar"), ("Fri Mar 4 05:06:07 2021 +0000", None, "not in calendar"), ("2021-03-04 05:06:07", None, "no zone"), ("2021-03-04 05:06:07", "Mars/Base", "no zone"), ("2021-03-04 05:06:07 XYZ", "UTC", "unknown offset"), ("12345678901", None, "no unit"), ("now-3w", None, "no pattern"),
        ("2021-03-28 02:30:00", "Europe/Berlin", "skipped"), ("2021-10-31 02:30:00", "Europe/Berlin", "ambiguous"),
    ]
    assert run(spark, [(t, z) for t, z, _ in cases]) == [(None, s) for _, _, s in cases]
    early, late = run(spark, [("2021-10-31 02:30:00", "Europe/Berlin")], policy="earlier"), run(spark, [("2021-10-31 02:30:00", "Europe/Berlin")], policy="later")
    assert late[0][0] - early[0][0] == 3_600_000


def test_every_hour_of_a_year(spark):
    """Local times around all clock changes of several zones against zoneinfo."""
    rows, want = [], []
    for z in ("America/New_York", "Australia/Sydney", "Asia/Kathmandu", "Europe/London"):
        tz = zoneinfo.ZoneInfo(z)
        for h in range(0, 365 * 24, 5):
            c = dt.datetime(2023, 1, 1) + dt.timedelta(hours=h, minutes=30)
            opts = {int(c.replace(tzinfo=tz, fold=f).timestamp() * 1000) for f in (0, 1)}
            real = {u for u in opts if dt.datetime.fromtimestamp(u / 1000, tz).replace(tzinfo=None) == c}
            rows.append((c.isoformat(sep=" "), z))
            want.append(real.pop() if len(real) == 1 else None)
    assert [g[0] for g in run(spark, rows)] == want


def test_session_zone_does_not_matter(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert run(spark, [("2021-03-14 02:30:00", "UTC"), ("2021-03-04 05:06:07", "Asia/Tokyo")]) == [(ms(2021, 3, 14, 2, 30), "ok"), (ms(2021, 3, 3, 20, 6, 7), "ok")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_flags_and_integers(spark):
    e = spark.createDataFrame([(1, 1614834367, None, True, False, None, 0), (2, 1614834367, "now", True, True, None, 0), (3, 5, None, True, None, None, 0), (4, None, "now", None, True, None, 9), (5, 1, "1614834367", False, True, None, 0)], "rec_id bigint, int_value bigint, string_value string, is_int boolean, is_string boolean, zone string, received_ms bigint")
    o = spark.createDataFrame([(1, 1614834367123456789), (2, 0), (3, None)], "rec_id bigint, time_unix_nano bigint")
    s = spark.createDataFrame([(9, 1614834367123456)], "seg_id bigint, earliest_epoch_ms bigint")
    got = {(r.src, r.rec_id): (r.utc_ms, r.status) for r in all_instants(e, o, s).collect()}
    assert got == {("epoch_inputs", 1): (1614834367000, "ok"), ("epoch_inputs", 2): (None, "flags"), ("epoch_inputs", 3): (None, "no unit"), ("epoch_inputs", 4): (9, "ok"), ("epoch_inputs", 5): (1614834367000, "ok"), ("otlp_points", 1): (1614834367123, "ok"), ("otlp_points", 2): (None, "no unit"), ("otlp_points", 3): (None, "no unit"), ("segmeta", 9): (1614834367123, "ok")}
    assert spark.range(1).select(int_to_ms(__import__("pyspark").sql.functions.lit(None))).first()[0] is None
