"""Queries of problems 1, 2, 4, 5 and 6 over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import grid, instants, intervals, logparse, segments, spikes
from tracelode.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of targets without a reading."""
    return p1_grid(spark, sf_dir).where("missing").select("target_id", "slot_sec")


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One smoothed value with standard error per target and slot."""
    return grid.regular_grid(table(spark, sf_dir, "metrics"), table(spark, sf_dir, "scrape_targets"))


def p1_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots and missing slots of each target, and whether each slot has a value with a standard error
    (a target without any reading has none)."""
    g = p1_grid(spark, sf_dir).groupBy("target_id").agg(F.count("*").alias("slots"), F.count_if("missing").alias("missing"), F.count_if(F.col("value").isNotNull() & (F.col("std") >= 0)).alias("valued"))
    return g.select("target_id", "slots", "missing", ((F.col("valued") == F.col("slots")) | (F.col("missing") == F.col("slots"))).alias("filled"))


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.covered_lists(segments.segment_spans(table(spark, sf_dir, "segmeta")), "virtual_table_name", "first_ms", "last_ms")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes between the covered milliseconds of each virtual table."""
    return intervals.gaps(_covered(spark, sf_dir)).withColumnRenamed("key", "virtual_table_name")


def p2_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of each virtual table."""
    return intervals.periods(_covered(spark, sf_dir)).withColumnRenamed("key", "virtual_table_name")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries with the fields of their headers."""
    return logparse.log_entries(table(spark, sf_dir, "loki_streams"), with_message=False)


def p4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries with their whole messages."""
    return logparse.log_entries(table(spark, sf_dir, "loki_streams"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible(*(table(spark, sf_dir, t) for t in ("metrics", "scrape_targets", "metric_defs")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of registered series with an implausible value."""
    return _flags(spark, sf_dir).select("point_id")


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the reasons."""
    return _flags(spark, sf_dir)


def p5_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that cannot exist for the unit of their metric."""
    return _flags(spark, sf_dir).where("impossible").select("point_id")


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.all_instants(*(table(spark, sf_dir, t) for t in ("epoch_inputs", "otlp_points", "segmeta")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant in milliseconds for each record that states one."""
    return _instants(spark, sf_dir).where("status = 'ok' and utc_ms is not null").select("src", "rec_id", "utc_ms")


def p6_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the pattern it matched and why it states no instant."""
    return _instants(spark, sf_dir)


def p6_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer instants of two tables."""
    x = instants.integer_instants(table(spark, sf_dir, "otlp_points"), "otlp_points", "rec_id", "time_unix_nano")
    return x.unionByName(instants.integer_instants(table(spark, sf_dir, "segmeta"), "segmeta", "seg_id", "earliest_epoch_ms")).where(F.col("utc_ms").isNotNull()).select("src", "rec_id", "utc_ms")


def queries() -> dict[str, Query]:
    names = "p1_found p1_grid p2_found p2_periods p4_found p4_entries p5_found p5_flags p6_found p6_status p6_integers p1_targets p5_impossible"
    return {n: globals()[n] for n in names.split()}


_MS = "CASE WHEN {c} >= 1577836800 AND {c} < 1893456000 THEN {c} * 1000 WHEN {c} >= 1577836800000 AND {c} < 1893456000000 THEN {c} WHEN {c} >= 1577836800000000 AND {c} < 1893456000000000 THEN {c} // 1000 WHEN {c} >= 1577836800000000000 AND {c} < 1893456000000000000 THEN {c} // 1000000 END"


def oracle_sql() -> dict[str, str]:
    spans = f"""
WITH s AS (SELECT virtual_table_name AS k, {_MS.format(c="earliest_epoch_ms")} AS f, {_MS.format(c="latest_epoch_ms")} AS l FROM segmeta WHERE virtual_table_name IS NOT NULL),
v AS (SELECT * FROM s WHERE f <= l),
r AS (SELECT k, f, l, max(l) OVER (PARTITION BY k ORDER BY f, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v)"""
    gaps = spans + " SELECT k AS virtual_table_name, reach + 1 AS gap_first_ms, f - 1 AS gap_last_ms FROM r WHERE f > reach + 1"
    periods = (
        spans
        + ", n AS (SELECT k, f, l, sum(CASE WHEN reach IS NULL OR f > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY f, l ROWS UNBOUNDED PRECEDING) AS g FROM r)"
        + " SELECT k AS virtual_table_name, min(f) AS first_ms, max(l) AS last_ms FROM n GROUP BY k, g"
    )
    series = """array_to_string(list_sort(list_transform(list_filter(map_entries(coalesce(tags, MAP {})), lambda e: coalesce(e.value, '') <> ''), lambda e: e.key || '=' || e.value)), chr(1))"""
    missing = f"""
WITH t AS (SELECT target_id, metric AS m, {series} AS tg, step_sec, start_sec, end_sec FROM scrape_targets),
r AS (SELECT DISTINCT regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') AS m, {series} AS tg, "timestamp" AS ts FROM metrics WHERE value IS NOT NULL AND NOT isnan(value)),
g AS (SELECT target_id, start_sec, step_sec, unnest(generate_series(start_sec, end_sec - step_sec, step_sec)) AS slot_sec FROM t),
h AS (SELECT DISTINCT t.target_id, t.start_sec + (r.ts - t.start_sec) // t.step_sec * t.step_sec AS slot_sec FROM t JOIN r ON t.m = r.m AND t.tg = r.tg AND r.ts >= t.start_sec AND r.ts < t.end_sec)
SELECT g.target_id, g.slot_sec FROM g LEFT JOIN h ON g.target_id = h.target_id AND g.slot_sec = h.slot_sec WHERE h.target_id IS NULL"""
    targets = missing.replace("SELECT g.target_id, g.slot_sec FROM g LEFT JOIN", "SELECT g.target_id, count(*) AS slots, count(*) FILTER (h.target_id IS NULL) AS missing, true AS filled FROM g LEFT JOIN").replace("WHERE h.target_id IS NULL", "GROUP BY g.target_id")
    bounds = " ".join(f"WHEN '{u}' THEN {a}" for u, (a, _) in spikes.UNIT_BOUNDS.items()), " ".join(f"WHEN '{u}' THEN {b}" for u, (_, b) in spikes.UNIT_BOUNDS.items() if b is not None)
    impossible = f"""
WITH t AS (SELECT DISTINCT metric AS m, {series} AS tg FROM scrape_targets),
r AS (SELECT point_id, value, regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') AS m, {series} AS tg FROM metrics WHERE value IS NOT NULL AND NOT isnan(value))
SELECT point_id FROM r JOIN t USING (m, tg) JOIN metric_defs d ON d.metric = r.m
WHERE isinf(value) OR value < CASE d.unit {bounds[0]} ELSE -1.7e308 END OR value > CASE d.unit {bounds[1]} ELSE 1.7e308 END"""
    ints = f"""
SELECT 'otlp_points' AS src, rec_id, {_MS.format(c="time_unix_nano")} AS utc_ms FROM otlp_points WHERE {_MS.format(c="time_unix_nano")} IS NOT NULL
UNION ALL SELECT 'segmeta', seg_id, {_MS.format(c="earliest_epoch_ms")} FROM segmeta WHERE {_MS.format(c="earliest_epoch_ms")} IS NOT NULL"""
    return {"p1_found": missing, "p2_found": gaps, "p2_periods": periods, "p6_integers": ints, "p1_targets": targets, "p5_impossible": impossible}
