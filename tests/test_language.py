"""The pipe language and its sisters: null rules, precedence, typing, errors, edge tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import Row

from tracelode.lang import expr, search, timespec
from tracelode.lang.lex import QueryError
from tracelode.metrics import promql
from tracelode.plans.engine import Engine

NOW = dt.datetime(2024, 5, 15, 13, 30, 20, tzinfo=dt.timezone.utc)
S = "timestamp bigint, id int, a double, s string, n string, b boolean"
ROWS = [(1000, 1, 1.0, "Apple", "10", True), (2000, 2, None, "banana", "9", False), (3000, 3, 3.0, None, "x", None), (4000, 4, -4.0, "apple pie", None, True), (5000, 5, 5.0, "", "10.0", False), (5000, 6, 5.0, "", "10.0", False)]


@pytest.fixture(scope="module")
def eng(spark):
    e = Engine(spark, NOW)
    e.register("t", spark.createDataFrame(ROWS, S), "timestamp", ["id"])
    e.register("empty", spark.createDataFrame([], S), "timestamp", ["id"])
    e.lookups["l.csv"] = spark.createDataFrame([("10", "ten"), ("9", "nine"), ("9", "again")], "n string, word string")
    return e


def ids(eng, text, **kw):
    return [r.id for r in eng.search(text, "t", **kw).collect()]


def val(eng, e, where="id=1"):
    r = eng.search(f"{where} | eval x={e} | fields x", "t").collect()
    return r[0].x


def test_search_rules(eng):
    assert ids(eng, "") == ids(eng, "*") == [5, 6, 4, 3, 2, 1]  # newest first
    assert sorted(ids(eng, "a=5 OR a=1 s=apple*")) == [1]  # OR binds tighter
    assert sorted(ids(eng, "NOT a>2")) == [1, 4]  # rows without the field stay out
    assert sorted(ids(eng, "NOT (a>2 OR s=apple)")) == [4]
    assert sorted(ids(eng, "s=APPLE")) == [1] and ids(eng, "s=CASE(APPLE)") == []
    assert sorted(ids(eng, "apple")) == [1, 4] and sorted(ids(eng, "app*")) == [1, 4] and ids(eng, "appl") == []
    assert sorted(ids(eng, "n=10")) == [1, 5, 6]  # texts that read as the number
    assert sorted(ids(eng, "n IN (9, x)")) == [2, 3] and sorted(ids(eng, "s=*")) == [1, 2, 4, 5, 6] and ids(eng, "s!=*") == [3]
    assert sorted(ids(eng, "b=true")) == [1, 4] and sorted(ids(eng, "n>9")) == [1, 5, 6] and ids(eng, "nosuch=1") == []
    assert ids(eng, "earliest=-1d latest=now") == [] and ids(eng, "*", start_ms=2000, end_ms=4000) == [3, 2]
    assert search.parse("a AND b OR c") == search.And((search.Term("a"), search.Or((search.Term("b"), search.Term("c")))))


def test_where_rules(eng):
    assert sorted(ids(eng, "* | where a>2 OR a<0 AND b")) == [3, 4, 5, 6]  # AND binds tighter
    assert sorted(ids(eng, "* | where NOT (a>2)")) == [1, 2, 4]  # NULL counts as false inside
    assert ids(eng, "* | where s=\"APPLE\"") == [] and ids(eng, "* | where nosuch=1") == []
    assert sorted(ids(eng, "* | where n=10")) == [1, 5, 6]
    assert sorted(ids(eng, '* | where s like "%pple%"')) == [1, 4] and sorted(ids(eng, "* | where a IN (1, 3)")) == [1, 3]
    assert sorted(ids(eng, '* | regex s!="^a"')) == [1, 2, 5, 6] and sorted(ids(eng, '* | regex "pie$"')) == [4]


def test_eval_values(eng):
    assert val(eng, "1/0") is None and val(eng, "-7 % 3") == -1 and val(eng, "2+3*4") == 14 and val(eng, "sqrt(-1)") is None
    assert val(eng, '"a"."b".id') == "ab1" and val(eng, '"5"+3') == 8 and val(eng, '"x"+"y"') == "xy"
    assert val(eng, "round(2.5)") == 3 and val(eng, "round(-2.5)") == -3 and val(eng, "round(1.256,2)") == 1.26
    assert val(eng, "substr(\"hello\",0,2)") == "he" and val(eng, 'substr("hello",-3,2)') == "ll"
    assert val(eng, 'tonumber("zz")') == 0 and val(eng, 'tonumber("-ff",16)') == -255 and val(eng, 'len("é")') == 2
    assert val(eng, 'case(a>5,"x")') == "" and val(eng, "coalesce(nosuch, null())") in ("", None) and val(eng, 'validate(a<0,"bad")') == "bad"
    assert val(eng, 'tostring(12345.6789,"commas")') == "12,345.68" and val(eng, 'tostring(255,"hex")') == "0xff" and val(eng, 'tostring(3661,"duration")') == "01:01:01" and val(eng, "tostring(5)") == "5"
    assert val(eng, "printf(\"%-5s|%+d|%x|%'d|%%|%.*f\", s, 3, 255, 1234567, 2, 1.005)").startswith("Apple|+3|ff|1,234,567|%|1.0")
    assert val(eng, "sigfig(1.00*1111)") == 1110.0 and val(eng, "typeof(s)") == "String" and val(eng, "typeof(nosuch)") == "Null"
    assert val(eng, 'strftime(0,"%Y-%m-%dT%H:%M:%S.%3Q %U %W %V %w %z")') == "1970-01-01T00:00:00.000 0 0 1 4 +0000"
    assert val(eng, 'strptime("12:30","%H:%M")') == "45000" and val(eng, 'strptime("bad","%Y")') is None
    assert val(eng, 'relative_time(1715779820,"-1mon@mon")') == 1711929600 and val(eng, 'relative_time(1715779820,"@w0")') == 1715472000
    assert val(eng, 'mvindex(split("a,b,c",","),-1)') == "c" and val(eng, 'mvindex(split("a,b",","),5)') == "" and val(eng, 'mvappend(split("a,b",","),null())') is None
    assert val(eng, 'cidrmatch("2001:db8::/32","2001:db8::1")') is True and val(eng, 'cidrmatch("10.0.0.0/8","x")') is False
    assert val(eng, 'spath("{\\"a\\":[{\\"b\\":1},{\\"b\\":2}]}","a{}.b")') == "[1,2]" and val(eng, 'spath("<r><x>7</x></r>","r.x")') == "7"
    assert val(eng, "isint(n)", "id=5") is False and val(eng, "isnum(n)", "id=5") is True and val(eng, "isbool(b)") is True
    assert val(eng, "bit_not(0)") == 2**53 - 1 and val(eng, "bit_and(-1,3)") is None and math.isclose(val(eng, "log(8,2)"), 3)


def test_commands(eng):
    r = lambda q: [tuple(x) for x in eng.search(q, "t").collect()]
    assert r("* | stats count, sum(n) AS s, min(s), dc(s)")[0][:2] == (6, 39.0)
    assert sorted(r("* | stats count AS c by s"), key=str) == sorted([("Apple", 1), ("banana", 1), (None, 1), ("apple pie", 1), ("", 2)], key=str)
    assert r("* | stats var(a) AS v, varp(nosuch) AS w, count(nosuch) AS c") == [(pytest.approx(14.0), None, 0)]
    assert r("id=1 | stats var(a) AS v") == [(0.0,)]
    assert [x[0] for x in r("* | sort n | table n")][:4] == ["9", "10.0", "10.0", "10"] and [x[0] for x in r("* | sort n | table n")][-1] is None
    assert [x[0] for x in r("* | sort -n | table n")][0] == "x" and [x[0] for x in r("* | sort -n | table n")][-1] is None
    assert [x[0] for x in r("* | head 3 | tail 2 | table id")] == [4, 6]
    assert [x[0] for x in r("* | head a>0 | table id")] == [5, 6] and [x[0] for x in r("* | head a<2 OR a>2 | table id")] == [5, 6, 4, 3] and [x[0] for x in r("* | head a<2 OR a>2 keeplast=true | table id")] == [5, 6, 4, 3, 2]
    assert [x[0] for x in r("* | dedup s | table id")] == [5, 4, 2, 1] and [x[0] for x in r("* | dedup s keepempty=true | table id")] == [5, 4, 3, 2, 1]
    assert [x[0] for x in r("* | dedup s consecutive=true keepempty=true | table id")] == [5, 4, 3, 2, 1]
    assert r('* | rex field=s "(?P<first_w>\\w+) (?P<rest>\\w+)" | where isnotnull(rest) | table first_w rest') == [("apple", "pie")]
    assert r("* | fields id s | rename s AS id") and "s" not in eng.search("* | fields id s | rename s AS id", "t").columns
    assert r('* | fillnull value="-" s | search id=3 | table s') == [("-",)]
    assert [(i, w in ("ten", "nine", "again")) for i, w in r("* | lookup l.csv n OUTPUT word | where isnotnull(word) | table id word | sort id")] == [(1, True), (2, True)]
    assert len(r("* | lookup l.csv n OUTPUT word")) == 6  # several rows of a key do not multiply events
    assert len(r("* | append [search id=1 | eval a=\"text\"]")) == 7
    assert r("* | streamstats sum(a) AS x current=false | sort id | table x") == [(9.0,), (9.0,), (6.0,), (10.0,), (None,), (5.0,)]
    assert r("| gentimes start=05/01/2024 end=05/02/2024 increment=6h | stats count") == [(4,)]
    assert r("* | transaction s | table eventcount")[0] == (2,)


def test_empty_table(eng):
    for c in ["", "| stats count by s", "| timechart span=1h count", "| top s", "| sort a", "| head 2", "| tail 2", "| dedup s", "| streamstats count", "| head a>1", "| transaction s", "| eventstats avg(a)", "| bin a", "| makemv s | mvexpand s", "| tojson", "| format", "| filldown a", "| rare s by n"]:
        n = eng.search("* " + c, "empty").count()
        assert n == (1 if c == "| format" else 0), c
    assert eng.search("* | stats count, sum(a) AS s", "empty").collect() == [Row(**{"count(*)": 0, "s": None})]


def test_clashing_names(spark):
    e = Engine(spark, NOW)
    e.register("c", spark.createDataFrame([(1, "x", 2, 3)], "timestamp bigint, count string, `a.b` int, percent int"), "timestamp")
    assert [tuple(r) for r in e.search("* | top count", "c").collect()] == [("x", 1, 100.0)]
    assert e.search("* | top count", "c").columns == ["count", "count_2", "percent"]
    assert [tuple(r) for r in e.search("* | stats count AS percent, count AS percent by percent", "c").collect()] == [(3, 1, 1)]
    assert e.search("* | eval z=a.b+1 | fields z", "c").collect()[0].z == 3
    assert e.search("* | stats sum(a.b) AS s by percent", "c").collect()[0].s == 2


def test_errors(eng):
    for q in ["* | nosuch", "* | eval x=", "* | eval x=foo(1)", "* | stats nosuch(a)", "* | where (a", "* | stats count | head a>1", "* | mvexpand s", "* | rex field=s \"x\"", "* | sort ip(s)", "(a", "* | stats perc101(a)", "* | stats count | streamstats count"]:
        with pytest.raises(QueryError):
            eng.search(q, "t").collect()
    with pytest.raises(QueryError):
        eng.search("*", "nosuch*")
    for q in ["SELECT a FROM t, empty", "SELECT DISTINCT a FROM t", "SELECT a FROM t ORDER BY a, s", "DELETE FROM t", "SELECT foo(a) FROM t", "SELECT a FROM t WHERE s LIKE 'x'"]:
        with pytest.raises(QueryError):
            eng.sql(q)


def test_other_languages(eng):
    assert eng.sql("SELECT count(*) AS n FROM t WHERE a > 2 OR s = 'banana'").first().n == 4
    assert [r.name for r in eng.sql("SHOW TABLES").collect()] == ["empty", "t"]
    assert eng.pipeql("s=Apple | columns id", "t").count() == 1 and eng.pipeql("s=apple | columns id", "t").count() == 0  # case counts here
    assert eng.es({"query": {"bool": {"should": [{"term": {"id": 1}}, {"match": {"s": "pie"}}]}}}, "t").count() == 2
    assert eng.es({"query": {"query_string": {"query": "s:banana OR pie"}}}, "t").count() == 2
    assert eng.es({"size": 2, "from": 1, "sort": [{"id": "desc"}]}, "t").collect()[0].id == 5


def test_time_words():
    r = lambda s: dt.datetime.fromtimestamp(timespec.resolve(s, NOW) / 1000, dt.timezone.utc).isoformat()[:19]
    assert r("now") == "2024-05-15T13:30:20" and r("-1d@d") == "2024-05-14T00:00:00" and r("@w0") == "2024-05-12T00:00:00" and r("-1mon@mon+2h") == "2024-04-01T02:00:00"
    assert r("@q") == "2024-04-01T00:00:00" and r("-1q@q") == "2024-01-01T00:00:00" and r("@y") == "2024-01-01T00:00:00" and r("05/01/2024:10:00:00") == "2024-05-01T10:00:00" and r("-h@h") == "2024-05-15T12:00:00"
    assert timespec.default_chart_span(3_600_000) == 60_000 and timespec.default_chart_span(10**12) == 30 * 86_400_000
    with pytest.raises(QueryError):
        timespec.resolve("nonsense", NOW)


def test_parsers():
    assert expr.parse("a OR b AND NOT c") == expr.Op("or", (expr.Field("a"), expr.Op("and", (expr.Field("b"), expr.Op("not", (expr.Field("c"),))))))
    assert promql.parse('sum by (a) (rate(x{b=~"c.*"}[5m] offset 1h)) > bool 2^3^2') .op == ">"
    e = promql.parse("a + b * c ^ -d or e")
    assert e.op == "or" and e.left.op == "+" and e.left.right.op == "*"
    for bad in ("sum(", "a{b}", "x[5m", "rate(x[5m]))", "1 +"):
        with pytest.raises(QueryError):
            promql.parse(bad)


def test_hot_groups_give_the_same(eng, monkeypatch, spark):
    """Block-wise forms against plain windows, with blocks so small that all edges occur."""
    import random

    from tracelode.plans import ordered

    rnd = random.Random(4)
    rows = [(rnd.randint(0, 500), i, float(rnd.randint(0, 20)), rnd.choice("ab") if rnd.random() < 0.9 else None) for i in range(400)]
    e = Engine(spark, NOW)
    e.register("h", spark.createDataFrame(rows, "timestamp bigint, id int, v double, k string"), "timestamp", ["id"])
    qs = ["* | streamstats window=7 global=false sum(v) AS x, count AS n by k", "* | streamstats window=7 global=false current=false dc(v) AS x by k", "* | streamstats sum(v) AS x, min(v) AS m, avg(v) AS a by k", "* | streamstats window=9 max(v) AS x", "* | streamstats window=9 count AS x by k", "* | streamstats reset_after=(v>18) count AS x by k", "* | transaction k startswith=(v>15) | table k timestamp eventcount duration", "* | transaction k startswith=(v>15) endswith=(v<3) | table k timestamp eventcount", "* | filldown k", "* | dedup 2 k consecutive=true"]
    plain = [sorted(map(str, e.search(q, "h").collect())) for q in qs]
    monkeypatch.setattr(ordered, "WIDE", 0)
    monkeypatch.setattr(ordered, "BLOCK", 16)
    assert [sorted(map(str, e.search(q, "h").collect())) for q in qs] == plain


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    p = str(tmp_path / "e")
    spark.createDataFrame(ROWS, S).write.parquet(p)
    e = Engine(spark, NOW)
    e.register("p", spark.read.parquet(p), "timestamp", ["id"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = e.search("id>2 | where a<100 AND id<9 | stats avg(a) by s", "p", 1000)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    for f in ("GreaterThan(id,2)", "LessThan(a,100.0)", "LessThan(id,9)", "GreaterThanOrEqual(timestamp,1000)"):
        assert f in pushed, pushed
    assert "n:string" not in plan[plan.index("ReadSchema") :]


def test_significant_figures(spark):
    e = Engine(spark, NOW)
    e.register("n", spark.createDataFrame([(1, 7.0, "0.0150"), (2, 123.0, "x")], "timestamp bigint, v double, s string"), "timestamp")
    got = e.search("* | sort timestamp | eval a=sigfig(1.00*1111), b=sigfig(3.2+1.234), c=sigfig(v), d=sigfig(v*0.30), e=sigfig(s*2.00), f=sigfig(10.5-0.26*2.0), g=sigfig(v/0)", "n").collect()
    assert [got[0][c] for c in "abcdefg"] == [1110.0, 4.4, 7.0, 2.0, 0.03, 10.0, None]
    assert [got[1][c] for c in "cde"] == [123.0, 37.0, None]


def test_bounded_states_by_default(spark):
    df = spark.createDataFrame([(i, float(i % 100)) for i in range(1000)], "timestamp bigint, v double")
    for exact, want in ((False, 49.0), (True, 49.5)):
        e = Engine(spark, NOW, exact=exact)
        e.register("n", df, "timestamp")
        r = e.search("* | stats median(v) AS m, dc(v) AS d, upperperc50(v) AS u, exactperc50(v) AS x", "n").first()
        assert (r.m, r.u, r.x) == (want, want, 49.5) and abs(r.d - 100) <= 2
        plan = e.search("* | stats median(v) AS m, dc(v) AS d", "n")._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("approx") >= 2) == (not exact)


def test_format_is_bounded(spark):
    e = Engine(spark, NOW)
    e.register("n", spark.range(30).withColumnRenamed("id", "v"))
    assert e.search("* | format maxresults=30", "n").first()[0].count(" OR ") == 29
    with pytest.raises(Exception, match="more than 29 rows"):
        e.search("* | format maxresults=29", "n").collect()
    with pytest.raises(QueryError):
        e.search("* | format nosuch=1", "n")


def test_running_functions_by_blocks_match_windows(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tracelode.plans import ordered

    monkeypatch.setattr(ordered, "BLOCK", 16)
    rows = [(i, i, ["a", "b", None][i % 3], None if i % 5 == 0 else float((i * 7) % 13) + 1e6, None if i % 4 == 0 else f"s{i % 6}") for i in range(120)]
    df = spark.createDataFrame(rows, "timestamp bigint, id int, k string, v double, s string")
    e = Engine(spark, NOW)
    e.register("n", df, "timestamp", ["id"])
    for by in ("", " by k"):
        for cur in (True, False):
            q = f"* | streamstats current={str(cur).lower()} dc(s) AS d, first(s) AS f, last(v) AS l, var(v) AS x, stdev(v) AS y, estdc_error(s) AS e, count AS c{by} | fields id d f l x y e c"
            got = {r.id: r for r in e.search(q, "n").collect()}
            w = (Window.partitionBy("k") if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("timestamp"), "id").rowsBetween(Window.unboundedPreceding, 0 if cur else -1)
            want = df.select("id", F.size(F.collect_set("s").over(w)).alias("d"), F.first("s", True).over(w).alias("f"), F.last("v", True).over(w).alias("l"), F.when(F.count("v").over(w) < 2, 0.0).otherwise(F.var_samp("v").over(w)).alias("x"), F.count(F.lit(1)).over(w).alias("c")).collect()
            for r in want:
                g = got[r.id]
                assert (g.d, g.f, g.l, g.c, g.e) == (r.d, r.f, r.l, r.c, 0.0) and g.x == pytest.approx(r.x, abs=1e-9) and g.y == pytest.approx(math.sqrt(r.x), abs=1e-6), (by, cur, r, g)
    plan = e.search("* | streamstats dc(s) AS d, first(s) AS f, var(v) AS x", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def test_unclosed_transactions_are_not_gathered(spark, monkeypatch):
    from tracelode.operators import order
    from tracelode.plans import ordered

    rows = [(1000 - i, "k", "end" if i in (3, 7) else "x") for i in range(60)]
    e = Engine(spark, NOW)
    e.register("n", spark.createDataFrame(rows, "timestamp bigint, k string, t string"), "timestamp")
    go = lambda: sorted(r.eventcount for r in e.search("* | transaction k endswith=(t=end)", "n").collect())
    assert go() == [4, 4]
    monkeypatch.setattr(ordered, "WIDE", 20)
    monkeypatch.setattr(order, "EVENTS_MOST", 20)
    assert go() == [4, 4]  # the long rest never closes
    with pytest.raises(QueryError):
        e.search("* | transaction k", "n").collect()


def test_whole_document_by_spath_and_nested_elements(spark):
    docs = ['{"a": {"b": 1, "c": [1, 2]}, "s": "x"}', '{"a": {"b": 2}, "o": [{"p": 1}]}', "no json", None]
    e = Engine(spark, NOW)
    e.register("n", spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "timestamp bigint, _raw string"), "timestamp")
    rows = e.search("* | spath | sort timestamp", "n").collect()
    assert [r["a.b"] for r in rows] == [1, 2, None, None] and rows[0]["a.c{}"] == ["1", "2"] and rows[0].s == "x" and rows[1]["o{}"] == ['{"p":1}']
    e.register("o", spark.createDataFrame([(1, [("red", 3), ("blue", None)]), (2, [("green", 5)]), (3, None)], "id int, t array<struct<c:string,n:int>>"))
    ids = lambda q: sorted(r.id for r in e.es({"query": {"nested": {"path": "t", "query": q}}}, "o").collect())
    assert ids({"exists": {"field": "t.n"}}) == [1, 2] and ids({"terms": {"t.c": ["blue", "green"]}}) == [1, 2] and ids({"prefix": {"t.c": "gr"}}) == [2]
    assert ids({"wildcard": {"t.c": "?l*"}}) == [1] and ids({"bool": {"must": [{"term": {"t.c": "blue"}}, {"exists": {"field": "t.n"}}]}}) == [] and ids({"match_all": {}}) == [1, 2]


def test_time_windows_pass_each_row_a_fixed_number_of_times(spark):
    """All aggregates of a time window against a plain loop: ties, gaps, rows without time, huge values that left the window."""
    import random
    import statistics

    rnd = random.Random(7)
    rows = [(None if i % 41 == 0 else rnd.choice([0, 10, 10, 20]) * 100 + rnd.randint(0, 300) - 900, i, None if rnd.random() < 0.2 else 1e17 if i % 50 == 0 else float(rnd.randint(0, 20)), rnd.choice(["x", "y", None]), rnd.choice("ab") if rnd.random() < 0.9 else None) for i in range(300)]
    rows += [(j, 1000 + j, 5.0, "y", "a") for j in (0, 100, 200, 201)]
    e = Engine(spark, NOW)
    e.register("n", spark.createDataFrame(rows, "timestamp bigint, id int, v double, s string, k string"), "timestamp", ["id"])
    plan = e.search("* | streamstats time_window=6h count AS n, avg(v) AS a by k", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan  # Spark passes a frame that moves at both ends anew for each row
    assert e.search("* | streamstats time_window=6h count AS n", "n").count() == len(rows)
    calls = "count AS n, count(v) AS c, sum(v) AS u, avg(v) AS a, min(v) AS lo, max(s) AS hi, range(v) AS r, first(v) AS f, last(s) AS l, var(v) AS x, estdc_error(s) AS z"
    for by, more in (("", ", dc(s) AS d, median(v) AS m"), (" by k", "")):
        got = {r.id: r for r in e.search(f"* | streamstats time_window=100ms {calls}{more}{by}", "n").collect()}
        assert len(got) == len(rows)
        for t, i, v, s, k in rows:
            near = [r for r in rows if (r[0] is None if t is None else r[0] is not None and t <= r[0] <= t + 100) and (not by or r[4] == k)]
            near.sort(key=lambda r: (-(r[0] or 0), r[1]))
            vs, ss = [r[2] for r in near if r[2] is not None], [r[3] for r in near if r[3] is not None]
            g = got[i]
            assert (g.timestamp, g.v, g.s, g.k) == (t, v, s, k)
            assert (g.n, g.c, g.lo, g.f, g.z) == (len(near), len(vs), min(vs, default=None), vs[0] if vs else None, 0.0)
            assert (g.hi, g.l) == (max(ss, default=None), ss[-1] if ss else None)
            if not vs:
                assert (g.u, g.a, g.r) == (None, None, None)
            else:
                assert g.u == pytest.approx(sum(vs), rel=1e-14) and g.a == pytest.approx(sum(vs) / len(vs), rel=1e-14) and g.r == max(vs) - min(vs)
            assert g.x == pytest.approx(statistics.variance(vs) if len(vs) > 1 else 0.0, rel=1e-9)
            if more:
                assert g.d == len(set(ss)) and g.m == (pytest.approx(statistics.median(vs), rel=1e-14) if vs else None)
    e.search("* | streamstats time_window=100ms first(v) AS f | streamstats time_window=200ms count AS n", "n").collect()


def test_sums_of_time_windows_keep_all_digits(spark):
    import random

    rnd, inf = random.Random(3), float("inf")
    rows = [(i, 0, rnd.randint(0, 20_000) / 100) for i in range(1500)]
    rows += [(10**6 + i, 1, v) for i, v in enumerate([inf, 1.0, -0.5])] + [(2 * 10**6 + i, 1, v) for i, v in enumerate([1.7e308, -1.7e308, 0.0, None])]
    rows += [(3 * 10**6 + i, 1, v) for i, v in enumerate([float("nan"), 2.0])] + [(4 * 10**6, 1, 0.0), (5 * 10**6, 1, None), (6 * 10**6, 1, 5e-324), (7 * 10**6, 1, -0.25)]
    e = Engine(spark, NOW)
    e.register("n", spark.createDataFrame(rows, "timestamp bigint, part int, v double"), "timestamp")
    got = {r.timestamp: r.u for r in e.search("* | streamstats time_window=1s sum(v) AS u", "n").collect()}
    for t, part, _ in rows:
        near = [v for x, _, v in rows if t <= x <= t + 1000 and v is not None]
        want = math.fsum(near) if near else None
        assert got[t] == want or want != want and got[t] != got[t], (t, got[t], want)
