"""One query an operator of the engine, over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions.series import metric_name
from tracelode.functions.typing import q
from tracelode.lang import esdsl
from tracelode.lang.lex import QueryError
from tracelode.metrics import otsdb
from tracelode.metrics.evaluate import Evaluator, labels_text
from tracelode.operators import groups
from tracelode.plans.engine import Engine
from tracelode.session import shared_dir, shared_path, table
from tracelode.sources import catalog
from tracelode.streaming import live
from tracelode.traces import spans as traces

Query = Callable[[SparkSession, str], DataFrame]
NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
DAY0, DAY30 = 1_704_067_200_000, 1_706_659_200_000  # 2024-01-01 and 30 days on

_TABLES = {"events": ("ts", ["event_id"]), "lineitem": ("l_shipdate", ["l_orderkey", "l_linenumber"]), "orders": ("o_orderdate", ["o_orderkey"]), "documents": (None, []), "nation": (None, []), "region": (None, []), "customer": (None, []), "part": (None, []), "supplier": (None, []), "embeddings": (None, [])}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, NOW, exact=True)
    for t, (time, tie) in _TABLES.items():
        e.register(t, partial(table, spark, sf_dir, t), time, tie)
    e.lookups = {"nations.csv": partial(table, spark, sf_dir, "nation"), "regions.csv": partial(table, spark, sf_dir, "region")}
    return e


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, arrays as texts: sums differ in their last digits between engines."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        c = q(f.name)
        out.append(((F.round(c.cast("double"), places) + 0.0) if t in ("double", "float") else F.array_join(c.cast("array<string>"), ",") if t.startswith("array") else c.cast("bigint") if t == "int" else c).alias(f.name))
    return df.select(*out)


def pipe(text: str, index: str = "events", start: int | None = None, end: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(engine(spark, sf_dir).search(text, index, start, end))

    return run


_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def add(name: str, f: Query, sql: str | None = None) -> None:
    _Q[name] = f
    if sql:
        _SQL[name] = sql


W = r"(^|[^A-Za-z0-9_]){}($|[^A-Za-z0-9_])"
ORD = "ORDER BY ts DESC, event_id"
MS = "CAST(epoch_us(ts) // 1000 AS BIGINT)"

# ---- search clause ---------------------------------------------------------------------------------
add("search_field", pipe("event_type=purchase value>50 | stats count, sum(value) AS total by user_id"), "SELECT user_id, count(*) AS \"count(*)\", round(sum(value), 4) AS total FROM events WHERE event_type = 'purchase' AND value > 50 GROUP BY user_id")
add("search_precedence", pipe("event_type=purchase OR event_type=click value>90 | stats count AS n by event_type"), "SELECT event_type, count(*) AS n FROM events WHERE (event_type = 'purchase' OR event_type = 'click') AND value > 90 GROUP BY event_type")
add("search_not", pipe("NOT (event_type=click OR value<20) | stats count AS n, avg(value) AS mean by event_type"), "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE event_type <> 'click' AND value >= 20 GROUP BY event_type")
add("search_wildcard", pipe("event_type=*UR* | stats count AS n by event_type"), "SELECT event_type, count(*) AS n FROM events WHERE lower(event_type) LIKE '%ur%' GROUP BY event_type")
add("search_in", pipe("event_type IN (signup, ERROR) | stats count AS n by event_type"), "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('signup', 'error') GROUP BY event_type")
add("search_case", pipe("event_type=CASE(Purchase) OR event_type=CASE(click) | stats count AS n by event_type"), "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('Purchase', 'click') GROUP BY event_type")
_free = "(regexp_matches(coalesce(text, ''), '(?i){w}') OR regexp_matches(coalesce(lang, ''), '(?i){w}') OR regexp_matches(coalesce(source, ''), '(?i){w}') OR regexp_matches(coalesce(author, ''), '(?i){w}'))"
add("search_free_text", pipe("gateway | stats count AS n by lang", "documents"), f"SELECT lang, count(*) AS n FROM documents WHERE {_free.replace('{w}', W.format('gateway'))} GROUP BY lang")
add("search_phrase", pipe('"same here" NOT TERM(gateway) | stats count AS n', "documents"), f"SELECT count(*) AS n FROM documents WHERE {_free.replace('{w}', W.format('same here'))} AND NOT {_free.replace('{w}', r'(^|[\s,;\[\](){{}}{q}])gateway($|[\s,;\[\](){{}}{q}])'.replace('{{', '{').replace('}}', '}').replace('{q}', chr(34) + chr(39) * 2))}")
add("search_time_range", pipe("earliest=01/05/2024:00:00:00 latest=01/10/2024:12:00:00 | stats count AS n"), "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10 12:00:00'")
add("search_relative_time", pipe("earliest=-20d@d latest=@mon+15d | stats count AS n, min(value) AS lo"), "SELECT count(*) AS n, round(min(value), 4) AS lo FROM events WHERE ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-02-16'")
add("search_regex", pipe('regex event_type="^(pur|sig)" | stats count AS n by event_type'.join(["* | ", ""])), "SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(event_type, '^(pur|sig)') GROUP BY event_type")
add("search_index", lambda s, d: rounded(engine(s, d).search("_index=na*ion | stats count AS n by n_regionkey")), "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")

# ---- projections and fields ------------------------------------------------------------------------
add("where_cmd", pipe('* | where value > 50 AND event_type != "click" OR user_id < 3 | stats count AS n by event_type'), "SELECT event_type, count(*) AS n FROM events WHERE (value > 50 AND event_type <> 'click') OR user_id < 3 GROUP BY event_type")
add("where_missing", pipe("* | where nosuch > 5 | stats count AS n"), "SELECT count(*) AS n FROM events WHERE false")
add("fields_cmd", pipe("* | fields event_id, v*"), "SELECT event_id, round(value, 4) AS value FROM events")
add("fields_minus", pipe("* | fields - props, ts, v*"), "SELECT event_id, user_id, event_type FROM events")
add("rename_cmd", pipe('* | fields event_id user_id event_type | rename event_id AS id, *_type AS kind_of_* | rename user_id AS "the user"'), 'SELECT event_id AS id, user_id AS "the user", event_type AS kind_of_event FROM events')
add("eval_cmd", pipe('* | eval a=value*2+1, b=if(a>100, "high", "low"), c=b.":".event_type | fields event_id a b c'), "SELECT event_id, round(value * 2 + 1, 4) AS a, CASE WHEN value * 2 + 1 > 100 THEN 'high' ELSE 'low' END AS b, CASE WHEN value * 2 + 1 > 100 THEN 'high' ELSE 'low' END || ':' || event_type AS c FROM events")
add("rex_cmd", pipe('* | rex field=props "(?P<key>[a-z]+)\\W+(?P<num>\\d+)" | fields event_id key num'), "SELECT event_id, CASE WHEN regexp_matches(props, '[a-z]+\\W+\\d+') THEN regexp_extract(props, '([a-z]+)\\W+(\\d+)', 1) END AS key, CASE WHEN regexp_matches(props, '[a-z]+\\W+\\d+') THEN regexp_extract(props, '([a-z]+)\\W+(\\d+)', 2) END AS num FROM events")
add("fillnull_cmd", pipe('* | eval x=if(value>50, value, null()) | fillnull value=0 x | fillnull value="none" extra | fields event_id x extra'), "SELECT event_id, round(CASE WHEN value > 50 THEN value ELSE 0 END, 4) AS x, 'none' AS extra FROM events")
add("makemv_mvexpand", pipe('* | eval m=event_type.",".user_id.",,end" | makemv delim="," m | mvexpand m | stats count AS n by m'), "SELECT m, count(*) AS n FROM (SELECT unnest([event_type, CAST(user_id AS VARCHAR), 'end']) AS m FROM events) GROUP BY m")
add("makemv_tokenizer", pipe('* | makemv tokenizer="([a-z])\\w" event_type | mvexpand limit=2 event_type | stats count AS n by event_type'), "SELECT event_type, count(*) AS n FROM (SELECT unnest(regexp_extract_all(event_type, '([a-z])\\w', 1)[1:2]) AS event_type FROM events) GROUP BY event_type")
add("spath_cmd", pipe("* | spath input=props output=k path=k | stats count AS n, sum(k) AS total"), "SELECT count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS total FROM events")
add("spath_whole", pipe("* | spath input=props | stats count AS n, sum(k) AS total"), "SELECT count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS total FROM events")
add("tojson_cmd", pipe("* | fields event_id event_type user_id | tojson str(event_type) num(user_id) output_field=j | eval t=spath(j, \"event_type\"), u=spath(j, \"user_id\") | fields event_id t u | eval u=tonumber(u)"), "SELECT event_id, event_type AS t, CAST(user_id AS DOUBLE) AS u FROM events")

# ---- bin -------------------------------------------------------------------------------------------
add("bin_span", pipe("* | bin span=25 value AS b | stats count AS n by b"), "SELECT CAST(CAST(floor(value / 25) * 25 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(CASE WHEN ceil(value / 25) = floor(value / 25) THEN ceil(value / 25) * 25 + 25 ELSE ceil(value / 25) * 25 END AS BIGINT) AS VARCHAR) AS b, count(*) AS n FROM events GROUP BY 1")
add("bin_log", pipe("* | where value >= 1 | bin span=log2 value AS b | stats count AS n by b"), "SELECT CAST(CAST(pow(2, floor(log2(value) + 1e-12)) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pow(2, CASE WHEN ceil(log2(value) - 1e-12) = floor(log2(value) + 1e-12) THEN floor(log2(value) + 1e-12) + 1 ELSE ceil(log2(value) - 1e-12) END) AS BIGINT) AS VARCHAR) AS b, count(*) AS n FROM events WHERE value >= 1 GROUP BY 1")
_width = "(SELECT pow(10, ceil(log10((max(user_id) - min(user_id)) / 20.0) - 1e-9)) FROM events)"
add("bin_auto", pipe("* | bin bins=20 user_id AS b | stats count AS n by b"), f"WITH e AS (SELECT floor(user_id / {_width}) * {_width} AS lo, {_width} AS w FROM events) SELECT CAST(CAST(lo AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(lo + w AS BIGINT) AS VARCHAR) AS b, count(*) AS n FROM e GROUP BY 1")
add("bin_time_auto", pipe("* | bin bins=40 timestamp AS t | stats count AS n by t"), f"SELECT {MS} // 86400000 * 86400000 AS t, count(*) AS n FROM events GROUP BY 1")
add("bin_aligned", pipe('* | bin span=6h aligntime="01/01/2024:01:30:00" timestamp AS t | stats count AS n by t'), f"SELECT CAST(floor(({MS} - 1704072600000) / 21600000) * 21600000 + 1704072600000 AS BIGINT) AS t, count(*) AS n FROM events GROUP BY 1")
add("bin_time", pipe("* | bin span=6h timestamp AS t | stats count AS n by t"), f"SELECT {MS} // 21600000 * 21600000 AS t, count(*) AS n FROM events GROUP BY 1")
add("bin_month", pipe("* | bin span=1mon timestamp AS t | stats count AS n by t", "orders"), "SELECT CAST(epoch_ms(date_trunc('month', o_orderdate)) AS BIGINT) AS t, count(*) AS n FROM orders GROUP BY 1")

# ---- stats -----------------------------------------------------------------------------------------
add("stats_basic", pipe("* | stats count, sum(value) AS s, avg(value) AS a, min(value) AS lo, max(value) AS hi, range(value) AS r, dc(user_id) by event_type"), 'SELECT event_type, count(*) AS "count(*)", round(sum(value), 4) AS s, round(avg(value), 4) AS a, round(min(value), 4) AS lo, round(max(value), 4) AS hi, round(max(value) - min(value), 4) AS r, count(DISTINCT user_id) AS "cardinality(user_id)" FROM events GROUP BY event_type')
add("stats_two_keys", pipe("* | stats avg(l_quantity) AS a, sum(l_extendedprice) AS s by l_returnflag, l_linestatus", "lineitem"), "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS a, round(sum(l_extendedprice), 4) AS s FROM lineitem GROUP BY 1, 2")
add("stats_spread", pipe("* | stats var(value) AS v, varp(value) AS vp, stdev(value) AS s, stdevp(value) AS sp, sumsq(value) AS sq by event_type"), "SELECT event_type, round(var_samp(value), 4) AS v, round(var_pop(value), 4) AS vp, round(stddev_samp(value), 4) AS s, round(stddev_pop(value), 4) AS sp, round(sum(value * value), 4) AS sq FROM events GROUP BY event_type")
add("stats_percentiles", pipe("* | stats perc95(value) AS p95, p10(value) AS p10, median(value) AS m, exactperc99.5(value) AS p995 by event_type"), "SELECT event_type, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.1), 4) AS p10, round(median(value), 4) AS m, round(quantile_cont(value, 0.995), 4) AS p995 FROM events GROUP BY event_type")
add("stats_values", pipe("* | stats values(event_type) AS v by user_id"), "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS v FROM events GROUP BY user_id")
for _n, _k in (("stats_list_by_user", "user_id"), ("stats_list_by_type", "event_type")):
    add(_n, pipe(f"* | stats list(event_type) AS l by {_k}"), f"SELECT {_k}, array_to_string(list(event_type ORDER BY {MS}, event_type)[1:100], ',') AS l FROM events GROUP BY {_k}")
add("stats_list_values", pipe("* | stats list(value) AS l by event_type"), f"SELECT event_type, array_to_string(list(regexp_replace(CAST(value AS VARCHAR), '[.]0$', '') ORDER BY {MS}, regexp_replace(CAST(value AS VARCHAR), '[.]0$', ''))[1:100], ',') AS l FROM events GROUP BY event_type")
add("stats_time_ordered", pipe("* | stats earliest_time(value) AS t0, latest_time(value) AS t1 by event_type"), f"SELECT event_type, min({MS}) AS t0, max({MS}) AS t1 FROM events WHERE value IS NOT NULL GROUP BY event_type")
add("stats_earliest", pipe("* | stats earliest(event_id) AS e, latest(event_id) AS l by event_type"), f"SELECT event_type, min(struct_pack(t := {MS}, v := event_id)).v AS e, max(struct_pack(t := {MS}, v := event_id)).v AS l FROM events GROUP BY event_type")
add("stats_first_last", pipe("* | stats first(event_id) AS f, last(event_id) AS l, mean(value) AS m, rate(event_id) AS r, upperperc90(value) AS u by event_type"), f"SELECT event_type, max(struct_pack(t := {MS}, v := event_id)).v AS f, min(struct_pack(t := {MS}, v := event_id)).v AS l, round(avg(value), 4) AS m, round((max(struct_pack(t := {MS}, v := event_id)).v - min(struct_pack(t := {MS}, v := event_id)).v) / ((max({MS}) - min({MS})) / 1000.0), 4) AS r, round(quantile_cont(value, 0.9), 4) AS u FROM events GROUP BY event_type")
add("stats_eval", pipe("* | stats count(eval(value>50)) AS big, sum(eval(value*2)) AS twice, avg(eval(if(event_type=\"click\", value, 0))) AS ac by user_id"), "SELECT user_id, count(*) FILTER (value > 50) AS big, round(sum(value * 2), 4) AS twice, round(avg(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 4) AS ac FROM events GROUP BY user_id")
add("stats_mode", pipe("* | stats mode(event_type) AS m, estdc_error(user_id) AS e"), "SELECT (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m, CAST(0 AS DOUBLE) AS e")
add("stats_null_group", pipe("* | stats count AS n by lang", "documents"), "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
add("eventstats_cmd", pipe("* | eventstats avg(value) AS mean, count AS n by event_type | where value > mean | stats count AS above by event_type, n"), "SELECT event_type, n, count(*) AS above FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS mean, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE value > mean GROUP BY 1, 2")
add("flagship", pipe("event_type=purchase | stats count AS n, avg(value) AS mean by user_id | sort -n user_id | head 10"), "SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE event_type = 'purchase' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")

# ---- top, rare, timechart ---------------------------------------------------------------------------
_pc = "round(count(*) * 100.0 / sum(count(*)) OVER (), 4)"
add("top_cmd", pipe("* | top event_type"), f"SELECT event_type, count(*) AS count, {_pc} AS percent FROM events GROUP BY event_type")
add("top_n_by_key", pipe("* | top 2 event_type showperc=false"), "SELECT event_type, count(*) AS count FROM events GROUP BY event_type ORDER BY event_type DESC LIMIT 2")
add("top_by", pipe("* | top 1 l_linestatus by l_returnflag showperc=f countfield=n", "lineitem"), "SELECT l_returnflag, l_linestatus, n FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus DESC) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
add("top_other", pipe('* | top limit=3 event_type useother=true otherstr="rest" showperc=false'), "WITH c AS (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY event_type DESC) AS r FROM events GROUP BY 1) SELECT event_type, n AS count FROM c WHERE r <= 3 UNION ALL SELECT 'rest', sum(n)::BIGINT FROM c WHERE r > 3")
add("rare_cmd", pipe("* | rare event_type percentfield=p"), f"SELECT event_type, count(*) AS count, {_pc} AS p FROM events GROUP BY event_type")
add("timechart_cmd", pipe("* | timechart span=1d count AS n, avg(value) AS mean", start=DAY0, end=DAY30), f"SELECT {DAY0} + ({MS} - {DAY0}) // 86400000 * 86400000 AS timestamp, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1")
_types = "click error purchase signup view".split()
add("timechart_by", pipe("* | timechart span=1d sum(value) by event_type", start=DAY0, end=DAY30), f"SELECT {DAY0} + ({MS} - {DAY0}) // 86400000 * 86400000 AS timestamp, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 4) AS {t}" for t in _types) + " FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1")


def _limited(spark: SparkSession, d: str) -> DataFrame:
    """A chart with one column of its own; its name depends on the data, so it is called ``best`` here."""
    x = pipe("* | timechart span=5d count by l_returnflag limit=top 1", "lineitem")(spark, d)
    return x.select("timestamp", *[q(c).alias("best" if c != "other" else c) for c in x.columns[1:]])


add("timechart_limit", _limited, "WITH x AS (SELECT CAST(epoch_us(l_shipdate) // 1000 AS BIGINT) AS ms, l_returnflag AS f FROM lineitem), b AS (SELECT min(ms) AS lo FROM x), k AS (SELECT f AS best FROM x GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), y AS (SELECT lo + (ms - lo) // 432000000 * 432000000 AS t, f FROM x, b) SELECT t AS timestamp, nullif(count(*) FILTER (f = best), 0) AS best, nullif(count(*) FILTER (f <> best), 0) AS other FROM y, k GROUP BY t")
add("timechart_default_span", pipe("* | timechart count AS n", start=DAY0, end=DAY30), f"SELECT {DAY0} + ({MS} - {DAY0}) // 86400000 * 86400000 AS timestamp, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1")


def _filled(spark: SparkSession, d: str) -> DataFrame:
    fr = engine(spark, d).plan("event_type=signup value>95 | timechart span=1h count AS n", "events", DAY0, DAY30)
    return rounded(groups.fill_buckets(fr, 3_600_000))


add("timechart_filled", _filled, f"SELECT g.t AS timestamp, count(e.event_id) AS n FROM (SELECT unnest(generate_series({DAY0}, {DAY30} - 3600000, 3600000)) AS t) g LEFT JOIN events e ON {MS.replace('ts', 'e.ts')} // 3600000 * 3600000 = g.t AND e.event_type = 'signup' AND e.value > 95 GROUP BY g.t")

# ---- order -----------------------------------------------------------------------------------------
add("sort_limit", pipe("* | sort 20 -value, event_id | fields event_id value"), "SELECT event_id, round(value, 4) AS value FROM events ORDER BY events.value DESC, event_id LIMIT 20")
add("sort_text", pipe("* | sort 15 event_type, -num(user_id), event_id | fields event_id"), "SELECT event_id FROM events ORDER BY event_type, user_id DESC, event_id LIMIT 15")
add("head_cmd", pipe("* | head 25 | fields event_id"), f"SELECT event_id FROM events {ORD} LIMIT 25")
add("tail_cmd", pipe("* | tail 7 | fields event_id"), "SELECT event_id FROM events ORDER BY ts, event_id DESC LIMIT 7")
add("head_while", pipe("* | head value<95 keeplast=true | fields event_id"), f"WITH e AS (SELECT event_id, value, row_number() OVER ({ORD}) AS r FROM events), f AS (SELECT min(r) AS m FROM e WHERE NOT value < 95) SELECT event_id FROM e, f WHERE m IS NULL OR r <= m")
add("scroll", lambda s, d: rounded(engine(s, d).search("event_type=view | fields event_id", "events", size=10, offset=15)), f"SELECT event_id FROM events WHERE event_type = 'view' {ORD} LIMIT 10 OFFSET 15")
add("dedup_cmd", pipe("* | dedup 2 event_type, user_id | fields event_id"), f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id {ORD}) AS r FROM events) WHERE r <= 2")
add("dedup_sortby", pipe("* | dedup user_id sortby -value, event_id | fields event_id"), "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
add("dedup_consecutive", pipe("* | dedup event_type consecutive=true | fields event_id"), f"SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER ({ORD}) AS p FROM events) WHERE p IS NULL OR p <> event_type")
add("dedup_keepevents", pipe("* | dedup event_type keepevents=true | stats count(event_type) AS kept, count AS n"), "SELECT count(DISTINCT event_type) AS kept, count(*) AS n FROM events")
_ss = f"SELECT event_id, {{}} FROM events WINDOW w AS ({{}}{ORD} ROWS BETWEEN {{}} AND {{}})"
add("streamstats_running", pipe("* | streamstats count AS n, sum(value) AS s, max(value) AS hi, avg(value) AS a | eval a=round(a+0.0000137,4) | fields event_id n s hi a"), _ss.format("count(*) OVER w AS n, round(sum(value) OVER w, 4) AS s, round(max(value) OVER w, 4) AS hi, round(avg(value) OVER w + 0.0000137, 4) AS a", "", "UNBOUNDED PRECEDING", "CURRENT ROW"))
add("streamstats_by", pipe("* | streamstats count AS n, range(value) AS r by event_type | fields event_id n r"), _ss.format("count(*) OVER w AS n, round(max(value) OVER w - min(value) OVER w, 4) AS r", "PARTITION BY event_type ", "UNBOUNDED PRECEDING", "CURRENT ROW"))
add("streamstats_window", pipe("* | streamstats window=10 current=false avg(value) AS a, count AS n | eval a=round(a+0.0000137,4) | fields event_id a n"), _ss.format("round(avg(value) OVER w + 0.0000137, 4) AS a, count(*) OVER w AS n", "", "10 PRECEDING", "1 PRECEDING"))
add("streamstats_window_group", pipe("* | streamstats window=5 global=false sum(value) AS s, dc(user_id) AS u by event_type | fields event_id s u"), f"SELECT event_id, round(sum(value) OVER w, 4) AS s, CAST(len(list_distinct(list(user_id) OVER w)) AS DOUBLE) AS u FROM events WINDOW w AS (PARTITION BY event_type {ORD} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
add("streamstats_window_global", pipe("* | streamstats window=20 count AS n, min(value) AS lo by event_type | fields event_id n lo"), f"WITH e AS (SELECT *, row_number() OVER ({ORD}) AS g FROM events) SELECT event_id, count(*) OVER w AS n, round(min(value) OVER w, 4) AS lo FROM e WINDOW w AS (PARTITION BY event_type ORDER BY g RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)")
add("streamstats_time", pipe("* | streamstats time_window=6h count AS n, avg(value) AS a | eval a=round(a+0.0000137,4) | fields event_id n a"), f"SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w + 0.0000137, 4) AS a FROM events WINDOW w AS (ORDER BY -{MS} RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW)")
add("streamstats_reset", pipe("* | streamstats reset_before=(value>95) reset_after=(value<5) count AS n, sum(value) AS s | fields event_id n s"), f"WITH e AS (SELECT *, CASE WHEN value > 95 OR lag(value) OVER ({ORD}) < 5 THEN 1 ELSE 0 END AS h FROM events), g AS (SELECT *, sum(h) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS ep FROM e) SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS s FROM g WINDOW w AS (PARTITION BY ep {ORD} ROWS UNBOUNDED PRECEDING)")
add("streamstats_change", pipe("* | streamstats reset_on_change=true count AS n by event_type | fields event_id n"), f"WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER ({ORD}) <> event_type THEN 1 ELSE 0 END AS h FROM events), g AS (SELECT *, sum(h) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS ep FROM e) SELECT event_id, count(*) OVER (PARTITION BY ep, event_type {ORD} ROWS UNBOUNDED PRECEDING) AS n FROM g")
_tx = f"WITH e AS (SELECT *, {MS} AS ms, event_type = 'view' AS st, event_type = 'purchase' AS en FROM events), s AS (SELECT *, coalesce(sum(CASE WHEN en THEN 1 ELSE 0 END) OVER (PARTITION BY user_id {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e), o AS (SELECT *, max(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, seg {ORD} ROWS UNBOUNDED PRECEDING) AS op FROM s) "
add("transaction_start_end", pipe('* | transaction user_id startswith="event_type=view" endswith=eval(event_type="purchase") | fields timestamp user_id duration eventcount'), _tx + "SELECT max(ms) AS timestamp, user_id, max(ms) - min(ms) AS duration, count(*) AS eventcount FROM o WHERE op = 1 GROUP BY user_id, seg HAVING bool_or(en)")
add("transaction_start", pipe("* | transaction user_id startswith=(event_type=signup) | stats count AS n, sum(eventcount) AS events, max(eventcount) AS most"), f"WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id {ORD} ROWS UNBOUNDED PRECEDING) AS seg FROM events), g AS (SELECT user_id, seg, count(*) AS c FROM s WHERE seg > 0 GROUP BY 1, 2) SELECT count(*) AS n, CAST(sum(c) AS DOUBLE) AS events, CAST(max(c) AS DOUBLE) AS most FROM g")

# ---- generators and combinations --------------------------------------------------------------------
add("gentimes_cmd", lambda s, d: rounded(engine(s, d).search("| gentimes start=01/01/2024 end=01/08/2024 increment=6h | fields starttime endtime")), "SELECT t AS starttime, t + 21599 AS endtime FROM (SELECT unnest(generate_series(1704067200, 1704672000 - 1, 21600)) AS t)")
add("inputlookup_cmd", lambda s, d: rounded(engine(s, d).search("| inputlookup nations.csv where n_name=nation_1* | stats count AS n by n_regionkey")), "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n FROM nation WHERE regexp_matches(n_name, '^NATION_1') GROUP BY n_regionkey")
add("inputlookup_append", pipe("* | stats count AS n | inputlookup append=true regions.csv | fields n r_name"), "SELECT count(*) AS n, NULL AS r_name FROM events UNION ALL SELECT NULL, r_name FROM region")
add("lookup_cmd", lambda s, d: rounded(engine(s, d).search("* | lookup nations.csv n_nationkey AS c_nationkey OUTPUT n_name AS nation | stats count AS n by nation", "customer")), "SELECT n_name AS nation, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
add("append_cmd", lambda s, d: rounded(engine(s, d).search("event_type=click | stats count AS n by event_type | append [_index=nation | stats count AS n by n_regionkey]", "events")), "SELECT event_type, NULL AS n_regionkey, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT NULL, CAST(n_regionkey AS BIGINT), count(*) FROM nation GROUP BY n_regionkey")
add("format_cmd", lambda s, d: engine(s, d).search("* | sort r_regionkey | fields r_name | head 2 | format", "region"), "SELECT '( ' || string_agg('( r_name=\"' || r_name || '\" )', ' OR ' ORDER BY r_regionkey) || ' )' AS search FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 2)")
add("eventcount_cmd", pipe("* | eventcount"), " UNION ALL ".join(f"SELECT '{t}' AS index, count(*) AS count FROM {t}" for t in _TABLES))
add("filldown_cmd", pipe("* | eval x=if(value>80, event_id, null()) | filldown x | fields event_id x"), f"SELECT event_id, CAST(last_value(CASE WHEN value > 80 THEN event_id END IGNORE NULLS) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS x FROM events")


# ---- scalar functions --------------------------------------------------------------------------------
def scalars(name: str, exprs: dict[str, tuple[str, str]], index: str = "events", key: str = "event_id") -> None:
    """Each entry: column -> (expression of the language, the same in SQL)."""
    text = "* | " + " | ".join(f"eval {k}={a}" for k, (a, _) in exprs.items()) + f" | fields {key} " + " ".join(exprs)
    add(name, pipe(text, index), f"SELECT {key}, " + ", ".join(f"{b} AS {k}" for k, (_, b) in exprs.items()) + f" FROM {index}")


scalars("fn_numeric", {
    "a": ("abs(value-50)", "round(abs(value - 50), 4)"), "b": ("ceil(value)", "CAST(ceil(value) AS DOUBLE)"), "c": ("floor(value)", "CAST(floor(value) AS DOUBLE)"), "d": ("sqrt(value)", "round(sqrt(value), 4)"), "e": ("exp(value/100)", "round(exp(value / 100), 4)"),
    "f": ("ln(value+1)", "round(ln(value + 1), 4)"), "g": ("log(value+1)", "round(log10(value + 1), 4)"), "h": ("log(value+1,2)", "round(log2(value + 1), 4)"), "i": ("pow(value,2)", "round(pow(value, 2), 4)"), "j": ("hypot(value,3)", "round(sqrt(value * value + 9), 4)"), "k": ("round(value,1)", "round(round(value, 1), 4)"), "m": ("user_id % 7", "CAST(user_id % 7 AS DOUBLE)"), "n": ("exact(value)", "round(value, 4)"), "o": ("pi()", "round(pi(), 4)"),
})
scalars("fn_trigonometry", {
    "a": ("sin(value)", "round(sin(value), 4)"), "b": ("cos(value)", "round(cos(value), 4)"), "c": ("atan(value)", "round(atan(value), 4)"), "d": ("atan2(value,2)", "round(atan2(value, 2), 4)"), "e": ("sinh(value/50)", "round(sinh(value / 50), 4)"), "f": ("cosh(value/50)", "round(cosh(value / 50), 4)"), "g": ("tanh(value)", "round(tanh(value), 4)"), "h": ("asinh(value)", "round(asinh(value), 4)"), "i": ("asin(user_id%2)", "round(asin(user_id % 2), 4)"), "j": ("acos(user_id%2)", "round(acos(user_id % 2), 4)"), "k": ("acosh(value+2)", "round(acosh(value + 2), 4)"), "m": ("atanh(user_id%2/2)", "round(atanh((user_id % 2) / 2.0), 4)"), "n": ("tan(user_id%2)", "round(tan(user_id % 2), 4)"),
})
scalars("fn_bits", {"a": ("bit_and(user_id,12)", "CAST(user_id & 12 AS DOUBLE)"), "b": ("bit_or(user_id,3)", "CAST(user_id | 3 AS DOUBLE)"), "c": ("bit_xor(user_id,5)", "CAST(xor(user_id, 5) AS DOUBLE)"), "d": ("bit_shift_left(user_id,2)", "CAST(user_id << 2 AS DOUBLE)"), "e": ("bit_shift_right(user_id,1)", "CAST(user_id >> 1 AS DOUBLE)"), "f": ("bit_not(user_id)", "CAST(9007199254740991 - user_id AS DOUBLE)")})
scalars("fn_text", {
    "a": ("upper(event_type)", "upper(event_type)"), "b": ('trim("  x ")', "'x'"), "c": ('ltrim(event_type,"cp")', "ltrim(event_type, 'cp')"), "d": ('rtrim(event_type,"kr")', "rtrim(event_type, 'kr')"), "e": ("substr(event_type,2,3)", "substr(event_type, 2, 3)"), "f": ("substr(event_type,-3)", "substr(event_type, -3)"), "g": ('replace(event_type,"([aeiou])","<$1>")', "regexp_replace(event_type, '([aeiou])', '<\\1>', 'g')"), "h": ("len(event_type)", "CAST(strlen(event_type) AS DOUBLE)"), "i": ('urldecode("a%20b")', "'a b'"),
    "j": ('max(event_type,"m")', "greatest(event_type, 'm')"), "k": ('min(event_type,"m")', "least(event_type, 'm')"), "m": ('tostring(user_id,"hex")', "'0x' || lower(to_hex(user_id))"), "n": ('tostring(user_id*3600,"duration")', "CASE WHEN user_id < 10 THEN '0' ELSE '' END || user_id || ':00:00'"), "o": ('printf("%05d|%s|%.2f", user_id, event_type, value)', "printf('%05d|%s|%.2f', user_id, event_type, value)"), "p": ('tonumber("0A4",16)', "CAST(164 AS DOUBLE)"), "r": ('tonumber("12.5")', "CAST(0 AS DOUBLE)"), "s": ("typeof(value)", "'Number'"), "t": ('ipmask("255.255.0.0","10.20.30.40")', "'10.20.0.0'"),
})
scalars("fn_time", {"a": ('strftime(timestamp,"%Y-%m-%d %H:%M:%S")', "strftime(ts, '%Y-%m-%d %H:%M:%S')"), "b": ('strptime("2024-01-02 03:04:05","%Y-%m-%d %H:%M:%S")', "'1704164645'"), "c": ('relative_time(timestamp/1000,"@d")', "CAST(epoch(date_trunc('day', ts)) AS DOUBLE)"), "d": ('relative_time(timestamp/1000,"-1d@mon")', "CAST(epoch(date_trunc('month', ts - INTERVAL 1 DAY)) AS DOUBLE)"), "e": ("now()", "CAST(1706745600 AS DOUBLE)"), "f": ('strftime(timestamp,"%j %p %I %s")', "dayofyear(ts) || strftime(ts, ' %p %I') || ' ' || CAST(floor(epoch(ts)) AS BIGINT)"), "g": ('strftime(timestamp,"%U %W %V")', "dayofyear(ts) // 7 || ' ' || (dayofweek(ts) - 1 + dayofyear(ts)) // 7 || ' ' || week(ts)"), "h": ('strftime(timestamp,"%Q %3N %Ez %x")', "lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || ' +00:00 ' || strftime(ts, '%m/%d/%y')")})
scalars("fn_multivalue", {
    "m": ('split(event_type.",b,a,b",",")', "event_type || ',b,a,b'"), "a": ("mvcount(m)", "CAST(4 AS DOUBLE)"), "b": ("mvindex(m,0)", "event_type"), "c": ('mvjoin(mvindex(m,-3,-1),"-")', "'b-a-b'"), "d": ("mvsort(m)", "array_to_string(list_sort([event_type, 'b', 'a', 'b']), ',')"), "e": ("mvdedup(m)", "event_type || ',b,a'"), "f": ('mvappend(m,"z")', "event_type || ',b,a,b,z'"), "g": ("mvzip(m,m,\":\")", "event_type || ':' || event_type || ',b:b,a:a,b:b'"), "h": ('mvfind(m,"^a$")', "'2'"), "i": ('mvfilter(m!="b")', "event_type || ',a'"), "j": ("mv_to_json_array(m)", "'[\"' || event_type || '\",\"b\",\"a\",\"b\"]'"), "k": ("mvrange(1,6,2)", "'1,3,5'"), "n": ("mvmap(m,upper(m))", "upper(event_type) || ',B,A,B'"), "o": ('spath(props,"k")', "json_extract_string(props, '$.k')"),
})
scalars("fn_conditional", {
    "a": ('if(value>50,"y","n")', "CASE WHEN value > 50 THEN 'y' ELSE 'n' END"), "b": ('case(value>90,"top",value>50,"mid")', "CASE WHEN value > 90 THEN 'top' WHEN value > 50 THEN 'mid' ELSE '' END"), "c": ('validate(value>10,"small",value<90,"large")', "CASE WHEN NOT value > 10 THEN 'small' WHEN NOT value < 90 THEN 'large' END"), "d": ('coalesce(null(),event_type)', "event_type"), "e": ('nullif(event_type,"click")', "nullif(event_type, 'click')"), "f": ('if(in(event_type,"click","view"),1,0)', "CAST(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS DOUBLE)"), "g": ('if(like(event_type,"%ur%"),1,0)', "CAST(CASE WHEN event_type LIKE '%ur%' THEN 1 ELSE 0 END AS DOUBLE)"), "h": ('if(match(event_type,"c$|k$"),1,0)', "CAST(CASE WHEN regexp_matches(event_type, 'c$|k$') THEN 1 ELSE 0 END AS DOUBLE)"),
    "i": ('if(cidrmatch("10.0.0.0/8","10.1.2.3"),1,0)', "CAST(1 AS DOUBLE)"), "j": ('if(searchmatch("event_type=c* value>50"),1,0)', "CAST(CASE WHEN event_type LIKE 'c%' AND value > 50 THEN 1 ELSE 0 END AS DOUBLE)"), "k": ("if(isnull(nosuch) AND isnotnull(value),1,0)", "CAST(1 AS DOUBLE)"), "m": ('if(isnum(value) AND isint(user_id) AND isstr(event_type) AND NOT isbool(event_type),1,0)', "CAST(1 AS DOUBLE)"), "n": ('if(isobject(props) AND NOT ismv(props),1,0)', "CAST(1 AS DOUBLE)"), "o": ("if(NOT (value>50 AND nosuch>1),1,0)", "CAST(1 AS DOUBLE)"),
})


scalars("fn_text_more", {
    "a": ('lower(upper(event_type))', "event_type"), "b": ('tostring(event_id*1000+0.5,"commas")', "format('{:,}', event_id * 1000) || '.5'"), "c": ("sigfig(1.00*1111)", "CAST(1110 AS DOUBLE)"), "i": ("sigfig(3.2+1.234)", "CAST(4.4 AS DOUBLE)"),
    "d": ('strftime(timestamp,"%a %b %e %H")', "strftime(ts, '%a %b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H')"), "e": ('strftime(timestamp,"%w %y %T %F")', "strftime(ts, '%w %y %H:%M:%S %Y-%m-%d')"),
    "f": ('if(cidrmatch("2001:db8::/32","2001:db8::1"),1,0)', "CAST(1 AS DOUBLE)"), "g": ('spath("<a><b>x</b></a>","a.b")', "'x'"), "h": ('printf("%\'d",1234567)', "'1,234,567'"),
})


# ---- other languages -----------------------------------------------------------------------------------
add("pipeql_group", lambda s, d: rounded(engine(s, d).pipeql("event_type=purchase | min(value), max(value) groupby user_id limit 20", "events")), 'SELECT user_id, round(min(value), 4) AS "min(value)", round(max(value), 4) AS "max(value)" FROM events WHERE event_type = \'purchase\' GROUP BY user_id ORDER BY user_id LIMIT 20')
add("pipeql_columns_let", lambda s, d: rounded(engine(s, d).pipeql("value>50 | let double = value * 2 | columns event_id, double | columns id=event_id", "events")), "SELECT event_id AS id, round(value * 2, 4) AS double FROM events WHERE value > 50")
add("sql_group", lambda s, d: rounded(engine(s, d).sql("SELECT event_type, count(*) AS n, avg(value) AS a, cardinality(user_id) AS u FROM events WHERE value > 10 AND value < 90 GROUP BY event_type")), "SELECT event_type, count(*) AS n, round(avg(value), 4) AS a, count(DISTINCT user_id) AS u FROM events WHERE value > 10 AND value < 90 GROUP BY event_type")
add("sql_select", lambda s, d: rounded(engine(s, d).sql("SELECT event_id, round(value, 1) AS v, 'x' AS tag FROM events WHERE event_type = 'error' OR value > 99 ORDER BY event_id LIMIT 50")), "SELECT event_id, round(round(value, 1), 4) AS v, 'x' AS tag FROM events WHERE event_type = 'error' OR value > 99 ORDER BY event_id LIMIT 50")
add("sql_show_columns", lambda s, d: engine(s, d).sql("DESCRIBE region").select("name"), "SELECT unnest(['r_regionkey', 'r_name']) AS name")
add("sql_join_extension", lambda s, d: rounded(engine(s, d).sql("SELECT r_name, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", True), 2), "SELECT r_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


def es(body: dict, index: str = "events") -> Query:
    return lambda s, d: rounded(engine(s, d).es(body, index))


add("es_bool", es({"query": {"bool": {"must": [{"range": {"value": {"gte": 20, "lt": 80}}}], "must_not": [{"term": {"event_type": "view"}}], "should": [{"prefix": {"event_type": "p"}}, {"wildcard": {"event_type": "cl?ck"}}], "minimum_should_match": 1}}, "aggs": {"t": {"terms": {"field": "event_type"}, "aggs": {"mean": {"avg": {"field": "value"}}, "users": {"cardinality": {"field": "user_id"}}}}}}), "SELECT event_type AS t, count(*) AS doc_count, round(avg(value), 4) AS mean, count(DISTINCT user_id) AS users FROM events WHERE value >= 20 AND value < 80 AND event_type <> 'view' AND (event_type LIKE 'p%' OR event_type LIKE 'cl_ck') GROUP BY 1")
add("es_date_histogram", es({"query": {"terms": {"event_type": ["click", "error"]}}, "aggs": {"day": {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": {"s": {"sum": {"field": "value"}}}}}}), f"SELECT {MS} // 86400000 * 86400000 AS day, count(*) AS doc_count, round(sum(value), 4) AS s FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
add("es_sort_page", es({"query": {"regexp": {"event_type": "s.*p"}}, "sort": [{"value": {"order": "desc"}}], "size": 10, "from": 5}), "SELECT event_id, ts, user_id, event_type, round(value, 4) AS value, props FROM events WHERE event_type LIKE 's%p' ORDER BY events.value DESC, ts DESC, event_id LIMIT 10 OFFSET 5")
add("es_match", es({"query": {"bool": {"filter": [{"match": {"text": {"query": "gateway radiator", "operator": "and"}}}, {"exists": {"field": "lang"}}]}}, "aggs": {"l": {"terms": {"field": "lang", "size": 10}}}}, "documents"), f"SELECT lang AS l, count(*) AS doc_count FROM documents WHERE regexp_matches(text, '(?i){W.format('gateway')}') AND regexp_matches(text, '(?i){W.format('radiator')}') AND lang IS NOT NULL GROUP BY 1")
add("es_query_string", es({"query": {"query_string": {"query": "event_type:purchase AND value:>50"}}, "aggs": {"u": {"terms": {"field": "user_id", "size": 1000}}}}), "SELECT user_id AS u, count(*) AS doc_count FROM events WHERE event_type = 'purchase' AND value > 50 GROUP BY 1 ORDER BY doc_count DESC, u LIMIT 1000")

add("es_match_phrase", es({"query": {"match_phrase": {"text": "same here"}}, "aggs": {"l": {"terms": {"field": "lang", "size": 10}}}}, "documents"), f"SELECT lang AS l, count(*) AS doc_count FROM documents WHERE regexp_matches(text, '(?i){W.format('same here')}') GROUP BY 1")
add("es_range_dates", es({"query": {"bool": {"filter": [{"range": {"ts": {"gte": "2024-01-05T00:00:00Z", "lt": "2024-01-10T12:00:00Z"}}}, {"range": {"value": {"from": 10, "to": 60}}}]}}, "aggs": {"t": {"terms": {"field": "event_type"}, "aggs": {"lo": {"min": {"field": "value"}}, "hi": {"max": {"field": "value"}}, "n": {"value_count": {"field": "value"}}}}}}), "SELECT event_type AS t, count(*) AS doc_count, round(min(value), 4) AS lo, round(max(value), 4) AS hi, count(value) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10 12:00:00' AND value BETWEEN 10 AND 60 GROUP BY 1")
def _second_page(spark: SparkSession, d: str) -> DataFrame:
    c = esdsl.open_scroll(engine(spark, d), {"query": {"term": {"event_type": "error"}}, "sort": [{"value": "asc"}]}, "events")
    last = esdsl.scroll_page(c, -1, 25).agg(F.max("_scroll").alias("last")).first()["last"]
    return rounded(esdsl.scroll_page(c, last, 25).select("event_id", "value"))


add("es_scroll", _second_page, "SELECT event_id, round(value, 4) AS value FROM events WHERE event_type = 'error' ORDER BY events.value, ts DESC, event_id LIMIT 25 OFFSET 25")
add("es_match_all", es({"query": {"match_all": {}}, "aggs": {"t": {"terms": {"field": "event_type"}}}}), "SELECT event_type AS t, count(*) AS doc_count FROM events GROUP BY 1")
add("es_simple_query_string", es({"query": {"simple_query_string": {"query": "event_type:purchase AND value:>50"}}, "aggs": {"u": {"terms": {"field": "user_id", "size": 1000}}}}), "SELECT user_id AS u, count(*) AS doc_count FROM events WHERE event_type = 'purchase' AND value > 50 GROUP BY 1 ORDER BY doc_count DESC, u LIMIT 1000")

# ---- metrics -------------------------------------------------------------------------------------------
M0, M1, STEP = 1_609_632_000, 1_609_632_000 + 14 * 86_400, 3_600  # all of metrics lies between


def prom(text: str, step: int = STEP, places: int = 3) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = Evaluator(table(spark, d, "metrics"), M0, M1, step, exact=True).query(text)
        return v.select(labels_text(F.col("labels")).alias("labels"), "ts", (F.round("value", places) + 0.0).alias("value"))

    return run


_SER = "list_sort(list_transform(list_filter(map_entries(coalesce(tags, MAP {})), lambda e: coalesce(CASE WHEN e.key = 'client' THEN lower(trim(e.value)) ELSE e.value END, '') <> ''), lambda e: e.key || '=' || CASE WHEN e.key = 'client' THEN lower(trim(e.value)) ELSE e.value END))"
_TAG = "list_transform(list_filter(s, lambda x: starts_with(x, '{0}=')), lambda x: x[len('{0}=') + 1:])[1]"


def _points(name: str, step: int = STEP, back: int = 0) -> str:
    return f"p AS (SELECT {_SER} AS s, CAST(floor((\"timestamp\" - {M0}) / {step}.0) * {step} + {M0} AS BIGINT) AS ts, avg(value) AS v FROM metrics WHERE regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') = '{name}' AND value IS NOT NULL AND NOT isnan(value) AND \"timestamp\" BETWEEN {M0 - back} AND {M1} GROUP BY 1, 2)"


_grp = _TAG.format("group")
_by = f"CASE WHEN {_grp} IS NULL THEN '' ELSE 'group=' || {_grp} END"
for _f, _s in {"avg": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(v) AS DOUBLE)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)", "group": "CAST(1 AS DOUBLE)"}.items():
    add(f"promql_{_f}_by", prom(f"{_f} by (group) (fuel_level_percent)"), f"WITH {_points('fuel_level_percent')} SELECT {_by} AS labels, ts, round({_s}, 3) AS value FROM p GROUP BY 1, 2")
add("promql_quantile", prom("quantile(0.9, radio_signal_dbm)"), f"WITH {_points('radio_signal_dbm')} SELECT '' AS labels, ts, round(quantile_cont(v, 0.9), 3) AS value FROM p GROUP BY ts")
add("promql_without", prom("sum without (unit_no, model, color, fuel_type, car_type, lane) (fuel_level_percent)"), f"WITH {_points('fuel_level_percent')} SELECT {_by} AS labels, ts, round(sum(v), 3) AS value FROM p GROUP BY 1, 2")
add("promql_topk", prom("sum(topk(2, fuel_level_percent))"), f"WITH {_points('fuel_level_percent')}, r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY v DESC) AS k FROM p) SELECT '' AS labels, ts, round(sum(v), 3) AS value FROM r WHERE k <= 2 GROUP BY ts")
add("promql_bottomk", prom("sum(bottomk(2, fuel_level_percent))"), f"WITH {_points('fuel_level_percent')}, r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY v) AS k FROM p) SELECT '' AS labels, ts, round(sum(v), 3) AS value FROM r WHERE k <= 2 GROUP BY ts")
add("promql_matchers", prom('count(speed_kmh{group=~"group [01]", fuel_type!="petrol"})'), f"WITH {_points('speed_kmh')} SELECT '' AS labels, ts, CAST(count(*) AS DOUBLE) AS value FROM p WHERE {_grp} IN ('group 0', 'group 1') AND coalesce({_TAG.format('fuel_type')}, '') <> 'petrol' GROUP BY ts")
_agg_f = {"abs": "abs(v)", "sqrt": "CASE WHEN v < 0 THEN CAST('nan' AS DOUBLE) ELSE sqrt(v) END", "ceil": "ceil(v)", "floor": "floor(v)", "sgn": "CAST(sign(v) AS DOUBLE)", "deg": "degrees(v)", "rad": "radians(v)"}
for _f, _s in _agg_f.items():
    add(f"promql_{_f}", prom(f"max({_f}(battery_volts))"), f"WITH {_points('battery_volts')} SELECT '' AS labels, ts, round(max({_s}), 3) AS value FROM p GROUP BY ts")
for _f, _s in {"hour": "hour(t)", "minute": "minute(t)", "month": "month(t)", "year": "year(t)", "day_of_month": "day(t)", "day_of_week": "dayofweek(t)", "day_of_year": "dayofyear(t)", "days_in_month": "day(last_day(t))"}.items():
    add(f"promql_{_f}", prom(f"max({_f}(battery_volts))"), f"WITH {_points('battery_volts')}, q AS (SELECT ts, make_timestamp(ts * 1000000) AS t FROM p) SELECT '' AS labels, ts, CAST(max({_s}) AS DOUBLE) AS value FROM q GROUP BY ts")
add("promql_clamp", prom("sum(clamp(battery_volts, 12, 14))"), f"WITH {_points('battery_volts')} SELECT '' AS labels, ts, round(sum(least(greatest(v, 12), 14)), 3) AS value FROM p GROUP BY ts")
add("promql_round_to", prom("sum(round(battery_volts, 0.5))"), f"WITH {_points('battery_volts')} SELECT '' AS labels, ts, round(sum(floor(v / 0.5 + 0.5) * 0.5), 3) AS value FROM p GROUP BY ts")
add("promql_math_rest", prom("sum(exp(clamp_max(battery_volts / 10, 5)) + ln(clamp_min(battery_volts, 1)) + log2(clamp_min(battery_volts, 1)) + log10(clamp_min(battery_volts, 1)))", places=2), f"WITH {_points('battery_volts')} SELECT '' AS labels, ts, round(sum(exp(least(v / 10, 5)) + ln(greatest(v, 1)) + log2(greatest(v, 1)) + log10(greatest(v, 1))), 2) AS value FROM p GROUP BY ts")
add("promql_timestamp", prom("max(timestamp(battery_volts))"), f"WITH {_points('battery_volts')} SELECT '' AS labels, ts, CAST(max(ts) AS DOUBLE) AS value FROM p GROUP BY ts")
_win = "WINDOW w AS (PARTITION BY s ORDER BY ts RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)"
for _f, _s in {"delta": "v - first_value(v) OVER w", "deriv": "CASE WHEN count(v) OVER w > 1 THEN regr_slope(v, CAST(ts AS DOUBLE)) OVER w END", "stdvar_over_time": "var_pop(v) OVER w", "stddev_over_time": "stddev_pop(v) OVER w"}.items():
    add(f"promql_{_f}", prom(f"sum by (group) ({_f}(fuel_level_percent[6h]))", places=2), f"WITH {_points('fuel_level_percent', back=21600)}, q AS (SELECT s, ts, {_s} AS x FROM p {_win}) SELECT {_by} AS labels, ts, round(sum(x), 2) + 0.0 AS value FROM q WHERE x IS NOT NULL AND ts >= {M0} GROUP BY 1, 2")
for _f, _s in {"avg": "avg(v)", "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "count": "CAST(count(v) AS DOUBLE)", "last": "max_by(v, p.ts)"}.items():
    add(f"promql_{_f}_over_time", prom(f"sum({_f}_over_time(fuel_level_percent[3h]))"), f"WITH {_points('fuel_level_percent', back=10800)}, g AS (SELECT DISTINCT s, unnest(generate_series({M0}, {M1}, {STEP})) AS t FROM p), x AS (SELECT g.s, g.t, coalesce({_s}, 0) AS x FROM g LEFT JOIN p ON p.s = g.s AND p.ts > g.t - 10800 AND p.ts <= g.t GROUP BY 1, 2) SELECT '' AS labels, t AS ts, round(sum(x), 3) AS value FROM x GROUP BY t")
_lag = "LAG(v) OVER (PARTITION BY s ORDER BY ts)"
_rate = f"WITH {_points('odometer_km', back=21600)}, i AS (SELECT *, CASE WHEN {_lag} IS NULL THEN 0 WHEN v < {_lag} THEN v ELSE v - {_lag} END AS inc FROM p), g AS (SELECT i.s, t, count(*) AS n, sum(inc) - min_by(inc, ts) AS d, min(ts) AS t0, max(ts) AS t1, min_by(v, ts) AS v0 FROM i JOIN (SELECT unnest(generate_series({M0}, {M1}, {STEP})) AS t) z ON i.ts BETWEEN t - 21600 AND t GROUP BY 1, 2 HAVING count(*) >= 2), a AS (SELECT *, CAST(t1 - t0 AS DOUBLE) AS sp, (t1 - t0) / (n - 1.0) AS m, CAST(t0 - (t - 21600) AS DOUBLE) AS a0, CAST(t - t1 AS DOUBLE) AS b0 FROM g), b AS (SELECT *, CASE WHEN a0 >= 1.1 * m THEN m / 2 ELSE a0 END AS a1, CASE WHEN b0 >= 1.1 * m THEN m / 2 ELSE b0 END AS b1 FROM a), c AS (SELECT *, CASE WHEN d > 0 AND v0 >= 0 THEN least(a1, sp * v0 / d) ELSE a1 END AS a2 FROM b) SELECT '' AS labels, t AS ts, round(sum(d * (sp + a2 + b1) / sp@1), @2) AS value FROM c GROUP BY t"
add("promql_increase", prom("sum(increase(odometer_km[6h]))", places=2), _rate.replace("@1", "").replace("@2", "2"))
add("promql_rate", prom("sum(rate(odometer_km[6h]))", places=5), _rate.replace("@1", " / 21600").replace("@2", "5"))
_pair = f"SELECT s, ts, v, {_lag} AS pv, LAG(ts) OVER (PARTITION BY s ORDER BY ts) AS pt FROM p"
add("promql_idelta", prom("sum(idelta(fuel_level_percent[6h]))"), f"WITH {_points('fuel_level_percent', back=21600)}, q AS ({_pair}) SELECT '' AS labels, ts, round(sum(v - pv), 3) AS value FROM q WHERE ts - pt <= 21600 AND ts >= {M0} GROUP BY ts")
add("promql_irate", prom("sum(irate(odometer_km[6h]))", places=5), f"WITH {_points('odometer_km', back=21600)}, q AS ({_pair}) SELECT '' AS labels, ts, round(sum(CASE WHEN v < pv THEN v ELSE v - pv END / (ts - pt)), 5) AS value FROM q WHERE ts - pt <= 21600 AND ts >= {M0} GROUP BY ts")
for _f, _c in {"changes": "<>", "resets": "<"}.items():
    add(f"promql_{_f}", prom(f"sum({_f}(gear_position[6h]))"), f"WITH {_points('gear_position', back=21600)}, f AS (SELECT s, ts, coalesce(CAST(v {_c} {_lag} AS INTEGER), 0) AS f FROM p), q AS (SELECT ts, sum(f) OVER w - first_value(f) OVER w AS x FROM f {_win}) SELECT '' AS labels, ts, CAST(sum(x) AS DOUBLE) AS value FROM q WHERE ts >= {M0} GROUP BY ts")
for _f in ("predict_linear", "quantile_over_time", "mad_over_time", "present_over_time"):
    _arg = {"predict_linear": "fuel_level_percent[6h], 3600", "quantile_over_time": "0.5, fuel_level_percent[6h]"}.get(_f, "fuel_level_percent[6h]")
    add(f"promql_{_f}", prom(f"sum by (group) ({_f}({_arg}))"), {"quantile_over_time": f"WITH {_points('fuel_level_percent', back=21600)}, q AS (SELECT s, ts, quantile_cont(v, 0.5) OVER w AS x FROM p {_win}) SELECT {_by} AS labels, ts, round(sum(x), 3) AS value FROM q WHERE ts >= {M0} GROUP BY 1, 2", "predict_linear": f"WITH {_points('fuel_level_percent', back=21600)}, q AS (SELECT s, ts, CASE WHEN count(v) OVER w > 1 THEN v + 3600 * regr_slope(v, CAST(ts AS DOUBLE)) OVER w END AS x FROM p {_win}) SELECT {_by} AS labels, ts, round(sum(x), 3) AS value FROM q WHERE x IS NOT NULL AND ts >= {M0} GROUP BY 1, 2", "mad_over_time": f"WITH {_points('fuel_level_percent', back=21600)}, q AS (SELECT s, ts, list(v) OVER w AS l FROM p {_win}), d AS (SELECT s, ts, list_aggregate(list_transform(l, lambda x: abs(x - list_aggregate(l, 'median'))), 'median') AS x FROM q) SELECT {_by} AS labels, ts, round(sum(x), 3) AS value FROM d WHERE ts >= {M0} GROUP BY 1, 2", "present_over_time": f"WITH {_points('fuel_level_percent', back=21600)} SELECT {_by} AS labels, ts, CAST(count(*) AS DOUBLE) AS value FROM p WHERE ts >= {M0} GROUP BY 1, 2"}.get(_f))
_two = f"WITH a AS (WITH {_points('fuel_level_percent')} SELECT {_grp} AS g, ts, sum(v) AS v FROM p GROUP BY 1, 2), b AS (WITH {_points('battery_volts')} SELECT {_grp} AS g, ts, sum(v) AS v FROM p GROUP BY 1, 2) "
_lab = "CASE WHEN a.g IS NULL THEN '' ELSE 'group=' || a.g END"
for _n, _op, _s in (("add", "+", "a.v + b.v"), ("subtract", "-", "a.v - b.v"), ("multiply", "*", "a.v * b.v"), ("divide", "/", "CASE WHEN b.v <> 0 THEN a.v / b.v END"), ("power", "^ 0 *", "b.v")):
    add(f"promql_{_n}", prom(f"sum by (group) (fuel_level_percent) {_op} sum by (group) (battery_volts)"), _two + f"SELECT {_lab} AS labels, a.ts, round({_s}, 3) AS value FROM a JOIN b ON a.g IS NOT DISTINCT FROM b.g AND a.ts = b.ts")
for _n, _op in (("greater", ">"), ("less", "<"), ("greater_equal", ">="), ("less_equal", "<="), ("equal", "=="), ("not_equal", "!=")):
    add(f"promql_{_n}", prom(f"sum by (group) (fuel_level_percent) {_op} bool sum by (group) (battery_volts)"), _two + f"SELECT {_lab} AS labels, a.ts, CAST(CASE WHEN a.v {_op.replace('==', '=')} b.v THEN 1 ELSE 0 END AS DOUBLE) AS value FROM a JOIN b ON a.g IS NOT DISTINCT FROM b.g AND a.ts = b.ts")
_sets = "SELECT {0} AS labels, a.ts, round(a.v, 3) AS value FROM a WHERE {1} EXISTS (SELECT 1 FROM b WHERE a.g IS NOT DISTINCT FROM b.g AND b.g = 'group 0')"
_b0 = 'sum by (group) (battery_volts{group="group 0"})'
add("promql_and", prom(f"sum by (group) (fuel_level_percent) and {_b0}"), _two + _sets.format(_lab, ""))
add("promql_unless", prom(f"sum by (group) (fuel_level_percent) unless {_b0}"), _two + _sets.format(_lab, "NOT"))
add("promql_or", prom(f'sum by (group) (fuel_level_percent{{group="group 1"}}) or {_b0}'), _two + "SELECT 'group=' || g AS labels, ts, round(v, 3) AS value FROM a WHERE g = 'group 1' UNION ALL SELECT 'group=' || g, ts, round(v, 3) FROM b WHERE g = 'group 0'")
_car = _TAG.format("car_type")
_parts = f"WITH {_points('fuel_level_percent')}, a AS (SELECT {_grp} AS g, {_car} AS c, ts, sum(v) AS v FROM p GROUP BY 1, 2, 3), b AS (SELECT {_grp} AS g, ts, sum(v) AS v FROM p GROUP BY 1, 2) "
_labels2 = "concat_ws(',', 'car_type=' || a.c, 'group=' || a.g)"
for _n, _t in {"group_left": "sum by (group, car_type) (fuel_level_percent) / on (group) group_left () sum by (group) (fuel_level_percent)", "ignoring": "sum by (group, car_type) (fuel_level_percent) / ignoring (car_type) group_left () sum by (group) (fuel_level_percent)"}.items():
    add(f"promql_{_n}", prom(_t), _parts + f"SELECT {_labels2} AS labels, a.ts, round(a.v / b.v, 3) AS value FROM a JOIN b ON a.g IS NOT DISTINCT FROM b.g AND a.ts = b.ts WHERE b.v <> 0")
add("promql_group_right", prom("sum by (group) (fuel_level_percent) - on (group) group_right () sum by (group, car_type) (fuel_level_percent)"), _parts + f"SELECT {_labels2} AS labels, a.ts, round(b.v - a.v, 3) AS value FROM a JOIN b ON a.g IS NOT DISTINCT FROM b.g AND a.ts = b.ts")
add("promql_on", prom("sum by (group, fuel_type) (fuel_level_percent{fuel_type=\"diesel\"}) * on (group) sum by (group) (battery_volts)"), f"WITH a AS (WITH {_points('fuel_level_percent')} SELECT {_grp} AS g, ts, sum(v) AS v FROM p WHERE {_TAG.format('fuel_type')} = 'diesel' GROUP BY 1, 2), b AS (WITH {_points('battery_volts')} SELECT {_grp} AS g, ts, sum(v) AS v FROM p GROUP BY 1, 2) SELECT {_lab} AS labels, a.ts, round(a.v * b.v, 3) AS value FROM a JOIN b ON a.g IS NOT DISTINCT FROM b.g AND a.ts = b.ts")
add("promql_filtered", prom("sum by (group) (fuel_level_percent) > sum by (group) (battery_volts)"), _two + f"SELECT {_lab} AS labels, a.ts, round(a.v, 3) AS value FROM a JOIN b ON a.g IS NOT DISTINCT FROM b.g AND a.ts = b.ts WHERE a.v > b.v")
add("promql_sort_desc", prom("sort_desc(sum by (group) (fuel_level_percent))"), f"WITH {_points('fuel_level_percent')} SELECT {_by} AS labels, ts, round(sum(v), 3) AS value FROM p GROUP BY 1, 2")
add("promql_count_values", prom('count_values("gear", gear_position)'), f"WITH {_points('gear_position')} SELECT 'gear=' || CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(v AS VARCHAR) END AS labels, ts, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1, 2")
add("promql_trigonometry", prom("sum(sin(battery_volts) + cos(battery_volts) + tan(battery_volts / 100) + atan(battery_volts) + sinh(battery_volts / 10) + cosh(battery_volts / 10) + tanh(battery_volts) + asinh(battery_volts) + acosh(clamp_min(battery_volts, 1)) + asin(clamp(battery_volts / 100, -1, 1)) + acos(clamp(battery_volts / 100, -1, 1)) + atanh(clamp(battery_volts / 100, -0.5, 0.5)) + exp(clamp_max(battery_volts / 10, 3)))", places=2), f"WITH {_points('battery_volts')} SELECT '' AS labels, ts, round(sum(sin(v) + cos(v) + tan(v / 100) + atan(v) + sinh(v / 10) + cosh(v / 10) + tanh(v) + asinh(v) + acosh(greatest(v, 1)) + asin(least(greatest(v / 100, -1), 1)) + acos(least(greatest(v / 100, -1), 1)) + atanh(least(greatest(v / 100, -0.5), 0.5)) + exp(least(v / 10, 3))), 2) AS value FROM p GROUP BY ts")
add("promql_scalar", prom("2 * sum(fuel_level_percent) % 7 > 3"), f"WITH {_points('fuel_level_percent')}, q AS (SELECT ts, 2 * sum(v) % 7 AS x FROM p GROUP BY ts) SELECT '' AS labels, ts, round(x, 3) AS value FROM q WHERE x > 3")
add("promql_label_replace", prom('sum by (g) (label_replace(fuel_level_percent, "g", "n$1", "group", "group (.*)"))'), f"WITH {_points('fuel_level_percent')} SELECT CASE WHEN {_grp} IS NULL THEN '' ELSE 'g=n' || regexp_extract({_grp}, 'group (.*)', 1) END AS labels, ts, round(sum(v), 3) AS value FROM p GROUP BY 1, 2")
add("promql_label_join", prom('sum by (gc) (label_join(fuel_level_percent, "gc", "-", "group", "car_type"))'), f"WITH {_points('fuel_level_percent')} SELECT 'gc=' || coalesce({_grp}, '') || '-' || coalesce({_TAG.format('car_type')}, '') AS labels, ts, round(sum(v), 3) AS value FROM p GROUP BY 1, 2")
add("promql_nested", prom("max(sum by (group) (avg_over_time(fuel_level_percent[2h:1h])))"), f"WITH {_points('fuel_level_percent', back=7200)}, g AS (SELECT DISTINCT s, unnest(generate_series({M0}, {M1}, {STEP})) AS t FROM p), x AS (SELECT g.s, g.t, coalesce(avg(v), 0) AS x FROM g LEFT JOIN p ON p.s = g.s AND p.ts > g.t - 7200 AND p.ts <= g.t GROUP BY 1, 2), y AS (SELECT {_grp} AS g, t, sum(x) AS x FROM x GROUP BY 1, 2) SELECT '' AS labels, t AS ts, round(max(x), 3) AS value FROM y GROUP BY t")


def _histogram(spark: SparkSession, d: str) -> DataFrame:
    """Buckets made of the latency samples of each day; then their 0.9 quantile."""
    m = table(spark, d, "metrics").where((metric_name(F.col("metric")) == "request_latency_ms") & F.expr("value is not null and not isnan(value)"))
    day = F.call_function("div", F.col("timestamp"), F.lit(86_400)) * 86_400
    b = F.array(*[F.struct(F.lit(n).alias("le"), F.lit(x).alias("x")) for n, x in (("10", 10.0), ("100", 100.0), ("1000", 1000.0), ("+Inf", float("inf")))])
    x = m.select(day.alias("ts"), "value", F.explode(b).alias("b")).where("value <= b.x").groupBy("ts", F.col("b.le").alias("le")).agg(F.count("*").cast("double").alias("value"))
    v = x.select(F.array(F.struct(F.lit("le").alias("key"), F.col("le").alias("value"))).alias("labels"), "ts", "value")
    return Evaluator(m, M0, M1).histogram_quantile(0.9, v).select("ts", F.round("value", 3).alias("value"))


add("promql_histogram_quantile", _histogram, "WITH m AS (SELECT \"timestamp\" // 86400 * 86400 AS ts, value FROM metrics WHERE regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') = 'request_latency_ms' AND value IS NOT NULL AND NOT isnan(value)), c AS (SELECT ts, count(*) * 1.0 AS n, count(*) FILTER (value <= 10) * 1.0 AS a, count(*) FILTER (value <= 100) * 1.0 AS b, count(*) FILTER (value <= 1000) * 1.0 AS c FROM m GROUP BY ts) SELECT ts, round(CASE WHEN a >= 0.9 * n THEN 10 * (0.9 * n) / a WHEN b >= 0.9 * n THEN 10 + 90 * (0.9 * n - a) / (b - a) WHEN c >= 0.9 * n THEN 100 + 900 * (0.9 * n - b) / (c - b) ELSE 1000 END, 3) AS value FROM c")

def _otsdb(text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = otsdb.query(table(spark, d, "metrics"), text, M0, M1, exact=True)
        return v.select(labels_text(F.col("tags")).alias("tags"), "ts", F.round("value", 3).alias("value"))

    return run


add("otsdb_downsample", _otsdb("sum:1h-avg:fuel_level_percent{group=*}"), f"WITH p AS (SELECT tags['group'] AS g, list_sort(map_entries(tags)) AS s, \"timestamp\" // 3600 * 3600 AS ts, avg(value) AS v FROM metrics WHERE regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') = 'fuel_level_percent' AND value IS NOT NULL AND NOT isnan(value) AND \"timestamp\" BETWEEN {M0} AND {M1} AND tags['group'] IS NOT NULL GROUP BY 1, 2, 3) SELECT 'group=' || g AS tags, ts, round(sum(v), 3) AS value FROM p GROUP BY 1, 2")
add("otsdb_filter", _otsdb("max:6h-max:speed_kmh{fuel_type=diesel|petrol}"), f"SELECT 'fuel_type=' || tags['fuel_type'] AS tags, \"timestamp\" // 21600 * 21600 AS ts, round(max(value), 3) AS value FROM metrics WHERE regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') = 'speed_kmh' AND value IS NOT NULL AND NOT isnan(value) AND \"timestamp\" BETWEEN {M0} AND {M1} AND tags['fuel_type'] IN ('diesel', 'petrol') GROUP BY 1, 2")


for _f, _s in {"avg": "avg(v)", "max": "max(v)", "count": "CAST(count(v) AS DOUBLE)"}.items():
    add(f"promql_hot_{_f}_by", prom(f"{_f} by (group) (bus_load_percent)"), f"WITH {_points('bus_load_percent')} SELECT {_by} AS labels, ts, round({_s}, 3) AS value FROM p GROUP BY 1, 2")
_request = {"time": {"start": M0, "end": str(M1 * 1000), "aggregator": "sum", "downsampler": {"interval": "1h", "aggregator": "avg"}}, "filters": [{"id": "f", "tags": [{"type": "wildcard", "tagk": "group", "filter": "*"}]}], "metrics": [{"id": "m", "metric": "fuel_level_percent", "filter": "f"}, {"id": "n", "metric": "x", "filter": "none"}], "outputs": [{"id": "m", "alias": "fuel"}, {"id": "n"}, {"id": "nosuch"}]}
add("otsdb_expression", lambda s, d: otsdb.expressions(table(s, d, "metrics"), _request, M1, exact=True)["fuel"].select(labels_text(F.col("tags")).alias("tags"), "ts", F.round("value", 3).alias("value")), _SQL["otsdb_downsample"])
add("promql_hot_idelta", prom("sum(idelta(bus_load_percent[6h]))"), f"WITH {_points('bus_load_percent', back=21600)}, q AS ({_pair}) SELECT '' AS labels, ts, round(sum(v - pv), 3) AS value FROM q WHERE ts - pt <= 21600 AND ts >= {M0} GROUP BY ts")
add("promql_hot_stddev_over_time", prom("sum by (group) (stddev_over_time(bus_load_percent[6h]))", places=2), f"WITH {_points('bus_load_percent', back=21600)}, q AS (SELECT s, ts, stddev_pop(v) OVER w AS x FROM p {_win}) SELECT {_by} AS labels, ts, round(sum(x), 2) + 0.0 AS value FROM q WHERE x IS NOT NULL AND ts >= {M0} GROUP BY 1, 2")
_cat = lambda f: lambda s, d: f(table(s, d, "metrics"))
add("catalog_metric_names", _cat(catalog.metric_names), "SELECT DISTINCT regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') AS metric FROM metrics")
add("catalog_tag_keys", _cat(catalog.tag_keys), f"SELECT DISTINCT split_part(x, '=', 1) AS key FROM (SELECT unnest({_SER}) AS x FROM metrics)")
add("catalog_tag_values", _cat(partial(catalog.tag_values, key="group")), "SELECT DISTINCT tags['group'] AS value FROM metrics WHERE coalesce(tags['group'], '') <> ''")
add("catalog_cardinality", _cat(catalog.cardinality), f"SELECT count(*) AS series FROM (SELECT DISTINCT regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') AS m, {_SER} AS s FROM metrics)")
add("catalog_keys_most_series", _cat(catalog.tag_keys_with_most_series), f"SELECT split_part(x, '=', 1) AS key, count(*) AS series FROM (SELECT unnest(s) AS x FROM (SELECT DISTINCT regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') AS m, {_SER} AS s FROM metrics)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("catalog_pairs_most_series", _cat(catalog.tag_pairs_with_most_series), f"SELECT split_part(x, '=', 1) AS key, substr(x, strpos(x, '=') + 1) AS value, count(*) AS series FROM (SELECT unnest(s) AS x FROM (SELECT DISTINCT regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') AS m, {_SER} AS s FROM metrics)) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
add("catalog_keys_most_values", _cat(catalog.tag_keys_with_most_values), f"SELECT split_part(x, '=', 1) AS key, count(DISTINCT substr(x, strpos(x, '=') + 1)) AS values FROM (SELECT unnest({_SER}) AS x FROM metrics) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")


# ---- traces --------------------------------------------------------------------------------------------
def spans_of(spark: SparkSession, d: str) -> DataFrame:
    """Spans made of line items: an order is a trace, each line a child of the (first) line before.

    Line numbers repeat within an order, so a rank tells rows of one number apart."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    li = table(spark, d, "lineitem").withColumn("rn", F.row_number().over(w))
    start = F.col("l_linenumber").cast("bigint") * 1_000_000
    dur = F.col("l_quantity").cast("bigint") * 1_000_000
    return li.select(
        F.col("l_orderkey").cast("string").alias("trace_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "rn").alias("span_id"),
        F.when(F.col("l_linenumber") > 1, F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber") - 1, F.lit(1))).otherwise("").alias("parent_span_id"),
        F.concat(F.lit("svc"), F.col("l_suppkey") % 7).alias("service"), F.col("l_returnflag").alias("name"),
        F.when(F.col("l_discount") > 0.08, "STATUS_CODE_ERROR").otherwise("STATUS_CODE_OK").alias("status"), start.alias("start_time"), (start + dur).alias("end_time"), dur.alias("duration"),
    )


_sp = "WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_returnflag) AS rn FROM lineitem), s AS (SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, l_orderkey || '-' || l_linenumber || '-' || rn AS span_id, CASE WHEN l_linenumber > 1 THEN l_orderkey || '-' || (l_linenumber - 1) || '-1' ELSE '' END AS parent_span_id, 'svc' || (l_suppkey % 7) AS service, l_returnflag AS name, CASE WHEN l_discount > 0.08 THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_OK' END AS status, CAST(l_linenumber AS BIGINT) * 1000000 AS start_time, CAST(l_linenumber AS BIGINT) * 1000000 + CAST(l_quantity AS BIGINT) * 1000000 AS end_time, CAST(l_quantity AS BIGINT) * 1000000 AS duration FROM l) "
add("trace_summaries", lambda s, d: traces.trace_summaries(spans_of(s, d)), _sp + "SELECT trace_id, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS span_count, count(*) FILTER (status = 'STATUS_CODE_ERROR') AS span_errors_count, (min(struct_pack(s := service, n := name)) FILTER (parent_span_id = '')).s AS service_name, (min(struct_pack(s := service, n := name)) FILTER (parent_span_id = '')).n AS operation_name FROM s GROUP BY trace_id")
add("trace_total", lambda s, d: traces.total_traces(spans_of(s, d)), "SELECT count(DISTINCT l_orderkey) AS total_traces FROM lineitem")
add("trace_red", lambda s, d: rounded(traces.red(spans_of(s, d), exact=True)), _sp + ", e AS (SELECT s.* FROM s LEFT JOIN s p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id WHERE p.service IS NULL OR p.service <> s.service) SELECT service, round(count(*) / 60.0, 4) AS rate, round(count(*) FILTER (status = 'STATUS_CODE_ERROR') * 100.0 / count(*), 4) AS error_rate, round(quantile_cont(duration / 1e6, 0.5), 4) AS p50, round(quantile_cont(duration / 1e6, 0.9), 4) AS p90, round(quantile_cont(duration / 1e6, 0.95), 4) AS p95, round(quantile_cont(duration / 1e6, 0.99), 4) AS p99 FROM e GROUP BY service")
add("trace_dependencies", lambda s, d: traces.dependencies(spans_of(s, d)), _sp + 'SELECT p.service AS parent, s.service AS child, count(*) AS "callCount" FROM s JOIN s p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id WHERE p.service <> s.service GROUP BY 1, 2')
add("trace_trees", lambda s, d: traces.span_trees(spans_of(s, d)).select("trace_id", "spans", F.col("depth").cast("bigint").alias("depth")), _sp + ", t AS (SELECT s.trace_id, s.span_id, 1 AS depth FROM s LEFT JOIN s p ON s.parent_span_id = p.span_id WHERE p.span_id IS NULL UNION ALL SELECT s.trace_id, s.span_id, t.depth + 1 FROM s JOIN t ON s.parent_span_id = t.span_id) SELECT trace_id, count(*) AS spans, CAST(max(depth) AS BIGINT) AS depth FROM t GROUP BY trace_id")
add("trace_page", lambda s, d: traces.trace_page(spans_of(s, d), 2, 20).select("trace_id", "start_time", "span_count"), _sp + "SELECT trace_id, min(start_time) AS start_time, count(*) AS span_count FROM s GROUP BY trace_id ORDER BY start_time DESC, trace_id LIMIT 20 OFFSET 20")
add("trace_search", lambda s, d: traces.trace_search(spans_of(s, d), "svc3", limit=40).select(F.col("traceID").alias("trace_id"), F.size("spans").cast("bigint").alias("spans"), F.size("processes").cast("bigint").alias("services"), F.array_max("spans.duration").alias("longest")), _sp + ", h AS (SELECT trace_id, max(start_time) AS newest FROM s WHERE service = 'svc3' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40) SELECT trace_id, count(*) AS spans, count(DISTINCT service) AS services, max(duration // 1000) AS longest FROM s JOIN h USING (trace_id) GROUP BY 1")


def _service_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the periodic jobs, over the first line numbers and the rest."""
    folder, s = shared_path(spark, "services"), spans_of(spark, d)
    traces.write_service_tables(s, folder, 0, 3_000_000)
    traces.write_service_tables(s, folder, 3_000_000, 10**12)
    a = spark.read.parquet(f"{folder}/service-dependency").groupBy("timestamp").agg(F.sum("callCount").alias("calls"))
    return a.join(spark.read.parquet(f"{folder}/red-traces").groupBy("timestamp").agg(F.count("*").alias("services")), "timestamp").select("timestamp", "calls", "services")


add("trace_service_tables", _service_tables, _sp + ", r AS (SELECT *, CASE WHEN start_time < 3000000 THEN 3 ELSE 1000000 END AS timestamp FROM s) SELECT CAST(s.timestamp AS BIGINT) AS timestamp, count(*) AS calls, (SELECT count(DISTINCT e.service) FROM r e LEFT JOIN r p ON e.parent_span_id = p.span_id AND e.timestamp = p.timestamp WHERE e.timestamp = s.timestamp AND (p.service IS NULL OR p.service <> e.service)) AS services FROM r s JOIN r p ON s.parent_span_id = p.span_id AND s.timestamp = p.timestamp WHERE s.service <> p.service GROUP BY s.timestamp")
add("trace_services", lambda s, d: traces.services(spans_of(s, d)), _sp + "SELECT DISTINCT service FROM s")
add("trace_operations", lambda s, d: traces.operations(spans_of(s, d), "svc3"), _sp + "SELECT DISTINCT name FROM s WHERE service = 'svc3'")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    from tracelode.streaming.live import alert_states

    h = engine(spark, d).search("* | bin span=1d timestamp AS t | stats avg(value) AS a by event_type, t", "events")
    return alert_states(h, ">", 50.0, 3, ["event_type"], "t", "a").select("event_type", "t", "state")


add("alert_states", _alerts, f"WITH h AS (SELECT event_type, {MS} // 86400000 * 86400000 AS t, avg(value) > 50 AS hit FROM events GROUP BY 1, 2), n AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS k FROM h) SELECT event_type, t, CASE WHEN NOT hit THEN 'Normal' WHEN k = 3 THEN 'Firing' ELSE 'Pending' END AS state FROM n")


# ---- streams: drained over what is there; windows and sessions come out once the watermark passed them
def _stream(make: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        schema = table(spark, d, "events").schema
        s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
        out = make(s.withColumn("ts", F.col("ts").cast("timestamp")))
        return rounded(live.drain(out, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"))

    return run


_ntz = lambda *cs: [F.col(c).cast("timestamp_ntz").alias(c) for c in cs]
_closed = "SELECT max(ts) - INTERVAL 1 HOUR FROM events"
add("stream_tail", _stream(lambda s: live.tail(s, "event_type=purchase | where value > 50 | eval twice=value*2 | fields event_id twice")), "SELECT event_id, round(value * 2, 4) AS twice FROM events WHERE event_type = 'purchase' AND value > 50")
add("stream_windows", _stream(lambda s: live.windowed_stats(s, "ts", "6 hours", "count AS n, sum(value) AS s by event_type", "1 hour").select(*_ntz("window_start"), "event_type", "n", "s")), f"SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOURS, min(ts), TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS <= ({_closed})")
add("stream_dedup", _stream(lambda s: live.dedup(s, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")), "SELECT DISTINCT user_id, event_type FROM events")
add("stream_sessions", _stream(lambda s: live.sessions(s, "ts", ["user_id"], "4 hours", "1 hour").select(*_ntz("session_start"), "user_id", "eventcount")), f"WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b DESC ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts) AS session_start, user_id, count(*) AS eventcount FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 4 HOURS <= ({_closed})")
add("es_multi_match", es({"query": {"multi_match": {"query": "gateway", "fields": ["text", "source"]}}, "aggs": {"s": {"terms": {"field": "source"}}}}, "documents"), f"SELECT source AS s, count(*) AS doc_count FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i){W.format('gateway')}') OR regexp_matches(coalesce(source, ''), '(?i){W.format('gateway')}') GROUP BY 1")
add("es_by_id", lambda s, d: rounded(esdsl.by_id(engine(s, d), "events", ["3", "17", "none"], "event_id").select("event_id", "value")), "SELECT event_id, round(value, 4) AS value FROM events WHERE event_id IN (3, 17)")
add("promql_formula", lambda s, d: Evaluator(table(s, d, "metrics"), M0, M1, STEP).formula("a + b", {"a": "sum by (group) (fuel_level_percent)", "b": "sum by (group) (battery_volts)"}).select(labels_text(F.col("labels")).alias("labels"), "ts", F.round("value", 3).alias("value")), _two + f"SELECT {_lab} AS labels, a.ts, round(a.v + b.v, 3) AS value FROM a JOIN b ON a.g IS NOT DISTINCT FROM b.g AND a.ts = b.ts")
add("promql_instant", lambda s, d: Evaluator(table(s, d, "metrics"), M0, M1, STEP).instant("max by (group) (fuel_level_percent)").select(labels_text(F.col("labels")).alias("labels"), "ts", F.round("value", 3).alias("value")), f"WITH {_points('fuel_level_percent')}, m AS (SELECT {_by} AS labels, ts, max(v) AS v FROM p GROUP BY 1, 2) SELECT labels, max(ts) AS ts, round(max_by(v, ts), 3) AS value FROM m GROUP BY labels")


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["QueryError", "engine", "oracle_sql", "queries"]
