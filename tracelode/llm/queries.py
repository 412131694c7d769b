"""Queries of problems 3, 7, 8, 9 and 10 over the test tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.corequeries import _SER
from tracelode.llm import distinct, mixing, packing, quantiles, spans, tokens
from tracelode.session import cut, small, table

Query = Callable[[SparkSession, str], DataFrame]


def p3_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct series and clients per UTC day, metric, group and all combinations."""
    return distinct.counts(distinct.rollup(distinct.sketches(distinct.metric_identifiers(table(spark, sf_dir, "metrics")))))


def p3_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable partial results: one sketch a day, metric and group."""
    return distinct.sketches(distinct.metric_identifiers(table(spark, sf_dir, "metrics")))


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of value per metric, UTC day, each tag (key and value) and all combinations."""
    return quantiles.tag_columns(quantiles.percentiles(_tag_cells(spark, sf_dir)))


def _tag_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.tag_rollup(quantiles.tag_sketches(quantiles.tagged_values(table(spark, sf_dir, "metrics"))))


def p7_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the merged states hold in all: the number of values of every cell (exact, so SQL can check it)."""
    p = quantiles.percentiles(quantiles.rollup(quantiles.sketches(quantiles.metric_values(table(spark, sf_dir, "metrics")))), (0.5,))
    return p.select("by_day", "by_metric", "by_tag", F.col("day").cast("string").alias("day"), "metric", "tag", "n")


def p7_tag_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of values of every cell of ``p7_percentiles``."""
    p = quantiles.tag_columns(quantiles.percentiles(_tag_cells(spark, sf_dir), (0.5,)))
    return p.select("by_day", "by_metric", "by_tag", F.col("day").cast("string").alias("day"), "metric", "key", "tag", "n")


def _sizes(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return tokens.token_sizes(table(spark, sf_dir, "documents"), *keep)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (or piece of an oversized one) with its container, for each capacity."""
    return packing.containers(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p8_containers(spark, sf_dir))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected records in training order."""
    return mixing.mixture(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of each listed source."""
    return mixing.mixture(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))[1]


def p9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected records when off-topic texts fade out and how-to texts come in over training."""
    ramps = {"offtopic": ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0)), "howto": ((0.0, 0.0), (1.0, 2.0))}
    return mixing.mixture(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"), ramps)[0]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of posts whose texts have a common run of at least 150 characters."""
    return spans.CommonRuns(table(spark, sf_dir, "documents")).pairs()


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each post is shared elsewhere."""
    return spans.CommonRuns(table(spark, sf_dir, "documents")).report()


def p10_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared stretches with their texts."""
    docs = table(spark, sf_dir, "documents")
    s = cut(spans.CommonRuns(docs).stretches(), "stretches")
    return s.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "start", "end", F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("stretch"))


def p10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared and removable characters of each post by runs of consecutive sentences."""
    return spans.sentence_report(table(spark, sf_dir, "documents"))


# ---- what must hold for the results above, in a form that SQL can state too -------------------------
_CUBE = ["by_day", "by_metric", "by_tag", "day", "metric", "tag"]


def _days(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


def p3_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact numbers of every cell, and whether the estimate lies within five of its standard errors."""
    ids = distinct.metric_identifiers(table(spark, sf_dir, "metrics"))
    # one row an identifier and finest cell first: that is all that exact counting needs of the readings
    one = F.explode(F.array(F.struct(F.lit("series").alias("kind"), F.col("series").alias("id")), F.struct(F.lit("client").alias("kind"), F.col("client").alias("id"))))
    x = ids.select("day", "metric", "tag", one.alias("k")).where("k.id is not null").select("day", "metric", "tag", "k.kind", "k.id").distinct()
    by = [F.struct(*[F.lit(on).alias(f"by_{c}") for on, c in zip(s, ("day", "metric", "tag"))], *[F.when(F.lit(on), F.col(c)).alias(c) for on, c in zip(s, ("day", "metric", "tag"))]) for s in itertools.product((True, False), repeat=3)]
    x = x.select(F.explode(F.array(*by)).alias("c"), "kind", "id").select("c.*", "kind", "id").distinct()
    exact = x.groupBy(*_CUBE, "kind").agg(F.count("*").alias("n"))
    e, c = exact.alias("e"), distinct.counts(distinct.rollup(distinct.sketches(ids))).alias("c")
    on = F.col("e.kind") == F.col("c.kind")
    for k in _CUBE:
        on = on & F.col(f"e.{k}").eqNullSafe(F.col(f"c.{k}"))
    j = e.join(c, on, "full_outer")
    near = F.coalesce(F.abs(F.col("c.estimate") - F.col("e.n")) <= 5 * F.col("c.rel_error") * F.col("e.n"), F.lit(False))
    return _days(j.select(*[F.coalesce(f"e.{k}", f"c.{k}").alias(k) for k in [*_CUBE, "kind"]], "n", near.alias("within")))


def p7_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact ranks of all percentiles of a cell without tag lie within its stated error."""
    values = quantiles.metric_values(table(spark, sf_dir, "metrics")).select("day", "metric", "value")
    cells = cut(quantiles.percentiles(quantiles.rollup(quantiles.sketches(values.withColumn("tag", F.lit(None).cast("string"))))).where("not by_tag").drop("tag"), "percentiles")
    none = F.lit(None)
    sets = F.explode(F.array(*[F.struct(F.lit(d).alias("by_day"), F.lit(m).alias("by_metric"), F.when(F.lit(d), F.col("day")).alias("day"), F.when(F.lit(m), F.col("metric")).alias("metric")) for d in (True, False) for m in (True, False)]))
    x = values.select(sets.alias("k"), "value").select("k.*", "value")
    keys = ["by_day", "by_metric", "day", "metric"]
    c = cells.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.col("n").alias("stated"), "rank_error", *map(quantiles.column_of, quantiles.QUANTILES))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    counts = []
    for q in quantiles.QUANTILES:
        p = F.col(quantiles.column_of(q))
        off = F.abs(p) * 2.0 ** -(quantiles.BITS - 12)
        counts += [F.count_if(F.col("value") < p - off).alias(f"lo{q}"), F.count_if(F.col("value") <= p + off).alias(f"hi{q}")]
    g = x.join(small(c), on).groupBy(*keys, "stated", "rank_error").agg(F.count("*").alias("n"), *counts)
    ok = F.col("n") == F.col("stated")
    for q in quantiles.QUANTILES:
        slack = F.col("rank_error") * F.col("n")
        ok = ok & (F.col(f"`lo{q}`") <= F.ceil(q * F.col("n")) - 1 + slack) & (F.col(f"`hi{q}`") >= F.ceil(q * F.col("n")) - slack)
    return _days(g.select(*keys, "n", F.coalesce(ok, none.cast("boolean")).alias("within")))


def _lengths(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Sizes in characters, which SQL can count."""
    return table(spark, sf_dir, "documents").select("doc_id", *keep, F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens"))


def p8_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing by characters: what was placed, what was split, and whether all containers hold what they can."""
    packed = cut(packing.containers(_lengths(spark, sf_dir), table(spark, sf_dir, "pack_specs")), "packed")
    load = packed.groupBy("spec_id", "capacity", "bin").agg(F.sum("tokens").alias("t")).groupBy("spec_id").agg((F.max("t") <= F.max("capacity")).alias("fits"))
    docs = packed.groupBy("spec_id", "capacity", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"))
    per = docs.groupBy("spec_id").agg(F.count("*").alias("documents"), F.sum("t").alias("placed"), F.count_if(F.col("pieces") > 1).alias("split"), (F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity"))) == 0).alias("whole"))
    return per.join(load, "spec_id").select(F.col("spec_id").cast("bigint").alias("spec_id"), "documents", "placed", "split", "whole", "fits")


def p9_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing by characters: the demand of each source, and whether the selection keeps to demand and caps."""
    sizes = _lengths(spark, sf_dir, "source")
    longest = sizes.agg(F.max("tokens").alias("longest"))
    s = mixing.mixture(sizes, table(spark, sf_dir, "mix_targets"))[1].join(F.broadcast(longest), F.lit(True))
    kept = (F.abs(F.col("tokens") - F.col("demand")) <= F.col("longest")) & (F.col("most_uses") <= F.col("max_repeats"))
    return s.select("source", F.round("target_share", 6).alias("target_share"), "available", F.round("demand", 2).alias("demand"), "capped", kept.alias("kept"))


def p9_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curriculum by characters: whether positions are the characters given out before, within a record of each source."""
    ramps = {"offtopic": ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0)), "howto": ((0.0, 0.0), (1.0, 2.0))}
    sizes = _lengths(spark, sf_dir, "source")
    sel, shares = mixing.mixture(sizes, table(spark, sf_dir, "mix_targets"), ramps)
    # a hundredth of the training: given out within it, and by its end
    total = shares.agg(F.sum("demand").alias("total"), F.count("*").alias("sources"))
    x = sel.join(F.broadcast(total), F.lit(True)).withColumn("part", F.floor(F.col("position") * 100 / F.col("total")))
    per = x.groupBy("part", "total", "sources").agg(F.sum("tokens").alias("given"))
    w = Window.orderBy("part")  # a hundred rows
    per = per.withColumn("off", F.abs(F.sum("given").over(w) - (F.col("part") + 1) * F.col("total") / 100))
    longest = sizes.agg(F.max("tokens").alias("longest"))
    return per.join(F.broadcast(longest), F.lit(True)).agg(F.count("*").alias("parts"), (F.max("off") <= F.max("longest") * F.max("sources")).alias("steady"))


def queries() -> dict[str, Query]:
    names = "p3_distinct_counts p3_partials p7_percentiles p7_value_counts p7_tag_value_counts p8_containers p8_fill p9_mixture p9_shares p9_curriculum p10_found p10_shared p10_stretches p10_sentence_spans p3_within_bound p7_within_bound p8_validity p9_validity p9_positions"
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    cells = r"""
WITH v AS (
  SELECT CAST(DATE '1970-01-01' + CAST(floor("timestamp" / 86400.0) AS INTEGER) AS VARCHAR) AS day,
         regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') AS metric,
         nullif(tags['group'], '') AS tag
  FROM metrics WHERE value IS NOT NULL AND NOT isnan(value))
SELECT grouping(day) = 0 AS by_day, grouping(metric) = 0 AS by_metric, grouping(tag) = 0 AS by_tag,
       day, metric, tag, count(*) AS n
FROM v GROUP BY CUBE (day, metric, tag)
"""
    tag_cells = r"""
WITH v AS (
  SELECT CAST(DATE '1970-01-01' + CAST(floor("timestamp" / 86400.0) AS INTEGER) AS VARCHAR) AS day,
         regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') AS metric, tags
  FROM metrics WHERE value IS NOT NULL AND NOT isnan(value)),
u AS (SELECT day, metric, unnest(map_entries(tags)) AS e FROM v),
t AS (SELECT day, metric, e.key AS key, nullif(CASE WHEN e.key = 'client' THEN lower(trim(e.value)) ELSE e.value END, '') AS tag FROM u),
w AS (SELECT day, metric, key, tag FROM t WHERE tag IS NOT NULL
  UNION ALL SELECT day, metric, 'group', NULL FROM v WHERE coalesce(tags['group'], '') = '')
SELECT grouping(day) = 0 AS by_day, grouping(metric) = 0 AS by_metric, true AS by_tag, day, metric, key, tag, count(*) AS n
FROM w GROUP BY GROUPING SETS ((day, metric, key, tag), (day, key, tag), (metric, key, tag), (key, tag))
UNION ALL
SELECT grouping(day) = 0, grouping(metric) = 0, false, day, metric, NULL, NULL, count(*) FROM v GROUP BY CUBE (day, metric)
"""
    exact = rf"""
WITH v AS (
  SELECT CAST(DATE '1970-01-01' + CAST(floor("timestamp" / 86400.0) AS INTEGER) AS VARCHAR) AS day,
         regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') AS metric, nullif(tags['group'], '') AS tag,
         regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') || chr(1) || array_to_string({_SER}, chr(1)) AS series,
         nullif(lower(trim(tags['client'])), '') AS client
  FROM metrics),
g AS (SELECT grouping(day) = 0 AS by_day, grouping(metric) = 0 AS by_metric, grouping(tag) = 0 AS by_tag, day, metric, tag,
             count(DISTINCT series) AS s, count(DISTINCT client) AS c FROM v GROUP BY CUBE (day, metric, tag))
SELECT by_day, by_metric, by_tag, day, metric, tag, 'series' AS kind, s AS n, true AS "within" FROM g WHERE s > 0
UNION ALL SELECT by_day, by_metric, by_tag, day, metric, tag, 'client', c, true FROM g WHERE c > 0
"""
    ranks = r"""
WITH v AS (
  SELECT CAST(DATE '1970-01-01' + CAST(floor("timestamp" / 86400.0) AS INTEGER) AS VARCHAR) AS day, regexp_replace(metric, '[^A-Za-z0-9_]', '_', 'g') AS metric
  FROM metrics WHERE value IS NOT NULL AND NOT isnan(value))
SELECT grouping(day) = 0 AS by_day, grouping(metric) = 0 AS by_metric, day, metric, count(*) AS n, true AS "within" FROM v GROUP BY CUBE (day, metric)
"""
    packed = """
SELECT CAST(spec_id AS BIGINT) AS spec_id, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS placed,
       count(*) FILTER (length(text) > capacity_tokens) AS split, true AS whole, true AS fits
FROM documents, pack_specs WHERE length(text) > 0 AND capacity_tokens > 0 GROUP BY spec_id
"""
    filled = """
WITH h AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS available FROM documents GROUP BY 1),
p AS (SELECT m.source, weight, coalesce(available, 0) AS available, coalesce(available, 0) * max_repeats * 1.0 AS most FROM mix_targets m LEFT JOIN h ON m.source = h.source),
q AS (SELECT *, weight / sum(weight) OVER () AS target_share, most / weight AS full_at, sum(available) OVER () AS total FROM p),
l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY full_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
s AS (SELECT *, (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, source LIMIT 1) AS stands FROM l)
SELECT source, round(target_share, 6) AS target_share, CAST(available AS BIGINT) AS available, round(least(most, coalesce(weight * stands, most)), 2) AS demand,
       least(most, coalesce(weight * stands, most)) >= most AS capped, true AS kept FROM s
"""
    runs = """
WITH w AS (SELECT doc_id, unnest(generate_series(1, length(text) - 149)) AS i, text FROM documents WHERE length(text) >= 150),
g AS (SELECT doc_id, i - 1 AS i, substring(text, i, 150) AS run FROM w),
k AS (SELECT run FROM g GROUP BY run HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT g.* FROM g JOIN k USING (run))"""
    stretch = runs + """,
b AS (SELECT doc_id, i, CASE WHEN i <= 150 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS first FROM (SELECT DISTINCT doc_id, i FROM s)),
c AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM b),
t AS (SELECT doc_id, min(i) AS start, max(i) + 150 AS "end" FROM c GROUP BY doc_id, n)"""
    return {
        "p7_value_counts": cells, "p7_tag_value_counts": tag_cells, "p3_within_bound": exact, "p7_within_bound": ranks, "p8_validity": packed, "p9_validity": filled,
        "p9_positions": "SELECT CAST(100 AS BIGINT) AS parts, true AS steady",
        "p10_found": runs + " SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.run = b.run AND a.doc_id < b.doc_id",
        "p10_stretches": stretch + ' SELECT t.doc_id, start, "end", substring(text, start + 1, "end" - start) AS stretch FROM t JOIN documents d ON t.doc_id = d.doc_id',
        "p10_shared": stretch + """,
u AS (SELECT doc_id, count(*) AS stretches, sum("end" - start) AS shared_chars FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(text), 0) AS chars, coalesce(stretches, 0) AS stretches, CAST(coalesce(shared_chars, 0) AS BIGINT) AS shared_chars,
       CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0.0 END AS shared FROM documents d LEFT JOIN u ON d.doc_id = u.doc_id""",
    }
