"""Mixing sources to target weights along a curriculum (problem 9).

Each source has a weight that may change over the course of training: a
piecewise linear schedule over a time t in [0, 1], normed so that its integral
W(t) rises from 0 to 1.  A source with a demand of D tokens must have delivered
D W(t) of them by t.  Records of a source are put in a pseudo-random order, a
new one for each repetition; the tokens before a record are its cumulative
demand, and inverting D W places it on the time axis.  All sources together
have delivered P(t) = sum of D W(t) tokens by then: P is the position in
training, so that at every position the weights of the sources add up to one.
Records are range-sorted by position.

Demands are filled like communicating vessels.  ``total`` tokens (by default as
many as the listed sources hold) are parted by weight; a source that would have
to be used more than ``max_repeats`` times is pinned at that cap, and what it
falls short of goes to the others by weight, until nobody is above the cap or
all are at it.  The report states target, demand, actual tokens and shortfall.

Scale: cumulative sums never gather a source.  Its records fall by a hash into
2^``BUCKET_BITS`` buckets (a third of 10^11 records: 2 M in a bucket).  One
aggregate of the buckets' tokens gives both the demands and, for each use, the
tokens before a bucket; then each bucket is summed for itself.

Defined results: source names differ neither by case nor by blanks around;
NULL and unlisted sources are not used; listed sources without tokens deliver
nothing, and their target is reported as shortfall; empty texts are never
selected; repeated rows are records of their own; NULL or negative weights
count as 0, ``max_repeats`` NULL or below 1 too (their rows are left out of the
plan); a source listed twice has the sum of its weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import cut, parallelism, small

BUCKET_BITS = 14
#: Knots (t, factor on the weight) of a source without schedule.
CONSTANT = ((0.0, 1.0), (1.0, 1.0))
MOST_SOURCES = 10_000
Knots = tuple[tuple[float, float], ...]


def _name(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def demands(sums: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """What each listed source has to deliver, from ``source, tokens, records`` (any number of rows a source).

    ``source, weight, max_repeats, available, target_share, demand, capped, total``.  All windows here
    run over one row a listed source."""
    t = targets.where("weight > 0 and max_repeats >= 1").select(_name(F.col("source")).alias("source"), "weight", "max_repeats").where("source is not null")
    t = t.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    have = sums.groupBy("source").agg(F.sum("tokens").alias("available"))
    p = t.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    everything = Window.partitionBy(F.lit(1))
    p = p.withColumns({"target_share": F.col("weight") / F.sum("weight").over(everything), "most": F.col("available") * F.col("max_repeats").cast("double")})
    p = p.withColumn("total", F.sum("available").over(everything).cast("double") if total is None else F.lit(float(total)))
    # from the source that is full first to the one that is full last: the level at which the rest would stand
    p = p.withColumn("full_at", F.col("most") / F.col("weight"))
    order = everything.orderBy("full_at", "source")
    pinned = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    p = p.withColumn("level", (F.col("total") - pinned) / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    p = p.withColumn("stands", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(everything)["level"])
    p = p.withColumn("demand", F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("stands"), F.col("most"))))
    return p.select("source", "weight", "max_repeats", "available", "target_share", "demand", (F.col("demand") >= F.col("most")).alias("capped"), "total")


def _pieces(knots: Knots) -> list[tuple[float, float, float, float, float, float]]:
    """(W before, t before, weight at it, slope, W after, t after) of each piece, normed to W(1) = 1."""
    out, w = [], 0.0
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if area <= 0 or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(k[1] < 0 for k in knots):
        raise ValueError("a schedule needs rising knots from t=0 to t=1, no negative factor and a positive integral")
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        step = (t1 - t0) * (a + b) / 2 / area
        out.append((w, t0, a / area, (b - a) / (t1 - t0) / area, w + step, t1))
        w += step
    return out


def _invert(f: Column, knots: Knots) -> Column:
    """Time at which the integral of the schedule reaches ``f`` in [0, 1]."""
    out = None
    for w0, t0, a, slope, w1, _ in _pieces(knots):
        y = F.greatest(f - w0, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * y, F.lit(0.0)))
        x = F.lit(t0) + F.when(root + a > 0, 2 * y / (root + a)).otherwise(F.lit(0.0))
        out = F.when(f <= w1, x) if out is None else out.when(f <= w1, x)
    return out.otherwise(F.lit(1.0))  # type: ignore[union-attr]


def _integral(t: Column, knots: Knots) -> Column:
    """W(t), the inverse of :func:`_invert`."""
    out = None
    for w0, t0, a, slope, _, t1 in _pieces(knots):
        x = t - t0
        y = F.lit(w0) + a * x + slope / 2 * x * x
        out = F.when(t <= t1, y) if out is None else out.when(t <= t1, y)
    return out.otherwise(F.lit(1.0))  # type: ignore[union-attr]


def mixture(
    sizes: DataFrame,
    targets: DataFrame,
    schedules: dict[str, Knots] | None = None,
    total: int | None = None,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Selection and shares from ``doc_id, source, tokens``.

    Selection: ``position`` (tokens given out before the middle of the record, in training
    order; off by at most half a record of each source), ``doc_id, source, use`` (0 = first
    use), ``tokens``, range-sorted by position.  ``total``: tokens of the mixture; reached
    but for half a record a source unless all sources are at their caps."""
    n = parallelism(sizes.sparkSession, 1)
    ramps = {k.strip().lower(): v for k, v in (schedules or {}).items()}
    bucket = F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    d = cut(sizes.where("tokens > 0").select("doc_id", _name(F.col("source")).alias("source"), "tokens").withColumn("bucket", bucket), "sizes")
    sums = cut(d.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens")), "mixsums")
    plan = cut(demands(sums, targets, total), "mixplan")
    wanted = plan.where("demand > 0").select("source", "available", "demand")
    # each use goes through the buckets, and through each bucket, in an order of its own
    uses = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("demand") / F.col("available")) - 1, F.lit(0)).cast("int"))
    b = sums.join(small(wanted, MOST_SOURCES), "source").withColumn("use", F.explode(uses))
    earlier = Window.partitionBy("source", "use").orderBy(F.xxhash64(F.lit(seed), "use", "bucket"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.col("use") * F.col("available") + F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).where("before < demand")
    b = cut(b.select("source", "bucket", "use", "before", "demand"), "mixbuckets")
    x = d.join(small(b), ["source", "bucket"]).withColumn("h", F.xxhash64(F.lit(seed), "use", "doc_id"))
    inside = Window.partitionBy("source", "use", "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    # a record belongs to the demand if its middle does
    x = x.withColumn("f", (start + F.col("tokens") / 2) / F.col("demand")).where("f < 1")
    t = None
    for source, knots in ramps.items():
        c = F.col("source") == source
        t = F.when(c, _invert(F.col("f"), knots)) if t is None else t.when(c, _invert(F.col("f"), knots))
    x = x.withColumn("t", F.col("f") if t is None else t.otherwise(F.col("f")))
    # one row for each schedule given, and one for the sources without
    by_schedule = {r["s"]: r["demand"] for r in plan.groupBy(F.when(F.col("source").isin(*ramps), F.col("source")).alias("s")).agg(F.sum("demand").alias("demand")).collect()}
    position = F.lit(by_schedule.get(None) or 0.0) * F.col("t")
    for source, knots in ramps.items():
        position = position + F.lit(by_schedule.get(source) or 0.0) * _integral(F.col("t"), knots)
    chosen = x.select(position.alias("position"), "doc_id", "source", "use", "tokens")
    chosen = cut(chosen.repartitionByRange(n, "position", "source", "doc_id", "use").sortWithinPartitions("position", "source", "doc_id", "use"), "mix")
    return chosen, shares(chosen, plan)


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, weight, target_share, actual_share, demand, tokens, shortfall, capped, records, most_uses,
    max_repeats, available`` of every listed source; ``shortfall`` is what is missing to the target's tokens
    (negative: what it gave for others)."""
    got = chosen.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"), (F.max("use") + 1).alias("most_uses"))
    j = plan.join(got, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    given = F.sum(zero("tokens")).over(Window.partitionBy(F.lit(1)))
    return j.select(
        "source", "weight", "target_share", F.when(given > 0, zero("tokens") / given).otherwise(0.0).alias("actual_share"), "demand", zero("tokens").alias("tokens"),
        (F.col("target_share") * F.col("total") - zero("tokens")).alias("shortfall"), "capped", zero("records").alias("records"), zero("most_uses").alias("most_uses"), "max_repeats", "available",
    )
