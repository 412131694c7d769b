"""Metric queries as DataFrame plans.

A vector is a DataFrame ``labels, ts, value``: labels as a sorted array of
(key, value), which can be grouped and joined; ts in seconds.  Points of a
series are first reduced to one a step (mean), then aggregated or put through
functions.  Range functions never join by range: a point is sent to those
evaluation times whose window holds it, or a window function runs over the
points of one series."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.series import metric_name, tag_entries
from tracelode.lang.lex import QueryError
from tracelode.metrics import promql as P

#: Steps in seconds, the least that gives at most 360 points is taken.
STEPS = (1, 5, 10, 20, 60, 120, 300, 600, 1200, 3600, 7200, 14400, 28800, 57600, 115200, 230400, 460800, 921600)
_LABELS = "array<struct<key:string,value:string>>"


def step_for(start: int, end: int) -> int:
    return next((s for s in STEPS if (end - start) / s <= 360), STEPS[-1])


def drop_name(labels: Column) -> Column:
    return F.filter(labels, lambda e: e["key"] != "__name__")


def keep(labels: Column, names: tuple[str, ...]) -> Column:
    return F.filter(labels, lambda e: e["key"].isin(list(names))) if names else F.array().cast(_LABELS)


def lose(labels: Column, names: tuple[str, ...]) -> Column:
    return F.filter(labels, lambda e: ~e["key"].isin([*names, "__name__"]))


def get(labels: Column, name: str) -> Column:
    return F.coalesce(F.get(F.filter(labels, lambda e: e["key"] == name), F.lit(0))["value"], F.lit(""))


def labels_text(c: Column) -> Column:
    """``k=v,k=v``: a label set as one text."""
    return F.array_join(F.transform(c, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


class Evaluator:
    """Queries over ``metric, tags, timestamp (s), value`` between start and end (both included).

    Quantiles over series keep a summary of bounded size (rank error 1e-4); ``exact`` keeps all values."""

    def __init__(self, metrics: DataFrame, start: int, end: int, step: int | None = None, exact: bool = False) -> None:
        self.metrics, self.start, self.end = metrics, start, end
        self.step = step or step_for(start, end)
        self.exact, self.loose = exact, False

    def query(self, text: str) -> DataFrame:
        """``labels, ts, value`` of a range query; a scalar gives one row a step without labels."""
        e = P.parse(text)
        v = self.eval(e)
        return _sorted(self.vector(v) if isinstance(v, float) else v, e, ["ts"])

    def instant(self, text: str) -> DataFrame:
        """The same at the last evaluation time that has a value for the series."""
        v = self.query(text)
        return _sorted(v.groupBy("labels").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value")), P.parse(text), [])

    def formula(self, text: str, queries: dict[str, str], match_labels: bool = True) -> DataFrame:
        """``a + b`` over named queries.  Without ``match_labels`` a side of one series (of all times) is
        applied to every series of the other one, whatever their labels."""
        self.loose = not match_labels
        try:
            return self.query(re.sub(r"\b([A-Za-z_]\w*)\b(?!\s*[({])", lambda m: f"({queries[m[1]]})" if m[1] in queries else m[1], text))
        finally:
            self.loose = False

    def vector(self, v: float) -> DataFrame:
        return self._grid().select(F.array().cast(_LABELS).alias("labels"), "ts", F.lit(v).alias("value"))

    def _grid(self) -> DataFrame:
        n = (self.end - self.start) // self.step + 1
        return self.metrics.sparkSession.range(n).select((F.col("id") * self.step + self.start).alias("ts"))

    # ---- selection
    def points(self, s: P.Selector, before: int = 0) -> DataFrame:
        """One point a step of each series that matches, shifted by the offset."""
        m = self.metrics.where(F.col("value").isNotNull() & ~F.isnan("value"))
        lo, hi = self.start - before - s.offset_s, self.end - s.offset_s
        m = m.where((F.col("timestamp") >= lo) & (F.col("timestamp") <= hi))
        name = metric_name(F.col("metric"))
        if s.name is not None:
            m = m.where(name == re.sub(r"[^A-Za-z0-9_]", "_", s.name))
        for label, op, v in s.matchers:
            c = name if label == "__name__" else F.coalesce(F.col("tags")[label], F.lit(""))
            hit = c == v if op in ("=", "!=") else c.rlike(f"^(?:{v})$")
            m = m.where(hit if op in ("=", "=~") else ~hit)
        e = F.sort_array(F.concat(F.array(F.struct(F.lit("__name__").alias("key"), name.alias("value"))), tag_entries(F.col("tags"))))
        bucket = F.floor((F.col("timestamp") + s.offset_s - self.start) / self.step) * self.step + self.start
        return m.select(e.alias("labels"), bucket.cast("bigint").alias("ts"), "value").groupBy("labels", "ts").agg(F.avg("value").alias("value"))

    # ---- evaluation
    def eval(self, e: object) -> DataFrame | float:
        if isinstance(e, P.Number):
            return e.value
        if isinstance(e, P.Selector):
            if e.range_s is not None:
                raise QueryError("a range needs a function")
            return self.points(e)
        if isinstance(e, P.Aggregate):
            return self.aggregate(e)
        if isinstance(e, P.Func):
            return self.function(e)
        if isinstance(e, P.Binary):
            return self.binary(e)
        raise QueryError(f"cannot evaluate {e}")

    def _scalar(self, e: object) -> float:
        v = self.eval(e)
        if not isinstance(v, float):
            raise QueryError("a number is needed")
        return v

    def aggregate(self, e: P.Aggregate) -> DataFrame:
        v = self.eval(e.expr)
        if isinstance(v, float):
            raise QueryError(f"{e.name} needs a vector")
        group = keep(F.col("labels"), e.by) if e.by is not None else lose(F.col("labels"), e.without) if e.without is not None else F.array().cast(_LABELS)
        if e.name in ("topk", "bottomk"):
            k = int(self._scalar(e.param))
            order = F.col("value").desc() if e.name == "topk" else F.col("value").asc()
            w = Window.partitionBy("ts").orderBy(order, "labels")
            return v.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
        x = v.select(group.alias("labels"), "ts", "value")
        c = F.col("value")
        if e.name == "quantile":
            phi = self._scalar(e.param)
            if phi < 0 or phi > 1:
                return x.groupBy("labels", "ts").agg(F.lit(float("-inf") if phi < 0 else float("inf")).alias("value"))
            return x.groupBy("labels", "ts").agg((F.percentile(c, phi) if self.exact else F.percentile_approx(c, phi, 10_000)).alias("value"))
        if e.name == "count_values":
            name = e.param.value if isinstance(e.param, P.Text) else "value"
            x = x.select(F.sort_array(F.concat("labels", F.array(F.struct(F.lit(name).alias("key"), c.cast("string").alias("value"))))).alias("labels"), "ts", "value")
            return x.groupBy("labels", "ts").agg(F.count("*").cast("double").alias("value"))
        f: dict[str, Callable[[], Column]] = {
            "avg": lambda: F.avg(c), "sum": lambda: F.sum(c), "min": lambda: F.min(c), "max": lambda: F.max(c), "count": lambda: F.count(c).cast("double"),
            "stddev": lambda: F.stddev_pop(c), "stdvar": lambda: F.var_pop(c), "group": lambda: F.max(F.lit(1.0)),
        }
        return x.groupBy("labels", "ts").agg(f[e.name]().alias("value"))

    # ---- functions
    def function(self, e: P.Func) -> DataFrame | float:
        n = e.name
        if n in RANGE:
            return self.range_function(n, e.args)
        if n in ("label_replace", "label_join"):
            return self.labels(n, e.args)
        if n == "histogram_quantile":
            return self.histogram_quantile(self._scalar(e.args[0]), self._frame(e.args[1]))
        if n == "vector":
            return self.vector(self._scalar(e.args[0]))
        if n in ("pi",):
            return 3.141592653589793
        if n in TIME:
            x = self._frame(e.args[0]) if e.args else self.vector(0.0)
            return x.select(drop_name(F.col("labels")).alias("labels"), "ts", TIME[n](F.timestamp_micros(F.col("ts") * 1_000_000)).cast("double").alias("value"))
        if n in MATH:
            x = self._frame(e.args[0])
            out = MATH[n](F.col("value"), *[self._scalar(a) for a in e.args[1:]])
            y = x.select(drop_name(F.col("labels")).alias("labels"), "ts", out.alias("value"))
            return y.where("false") if n == "clamp" and self._scalar(e.args[1]) > self._scalar(e.args[2]) else y
        if n == "timestamp":
            x = self._frame(e.args[0])
            return x.select(drop_name(F.col("labels")).alias("labels"), "ts", F.col("ts").cast("double").alias("value"))
        if n in ("sort", "sort_desc"):  # rows are ordered where the query ends, see _sorted
            return self._frame(e.args[0])
        raise QueryError(f"unknown function {n}")

    def _frame(self, e: object) -> DataFrame:
        v = self.eval(e)
        if isinstance(v, float):
            raise QueryError("a vector is needed")
        return v

    def _ranged(self, e: object) -> tuple[DataFrame, int]:
        if isinstance(e, P.Selector) and e.range_s is not None:
            return self.points(e, e.range_s), e.range_s
        if isinstance(e, P.Subquery):
            inner = Evaluator(self.metrics, self.start - e.range_s - e.offset_s, self.end - e.offset_s, e.step_s or self.step, self.exact)
            v = inner.eval(e.expr)
            x = inner.vector(v) if isinstance(v, float) else v
            return x.withColumn("ts", F.col("ts") + e.offset_s), e.range_s
        raise QueryError("a range vector is needed")

    def range_function(self, n: str, args: tuple) -> DataFrame:
        nums = [self._scalar(a) for a in args if isinstance(a, P.Number) or (isinstance(a, P.Binary))]
        x, w = self._ranged(next(a for a in args if isinstance(a, (P.Selector, P.Subquery))))
        x = x.withColumn("labels", drop_name(F.col("labels")))
        if n in ("rate", "increase"):
            out = self._extrapolated(x, w, n == "rate")
        elif n in OVER_TIME:
            out = self._over_time(x, w, OVER_TIME[n])
        else:
            out = self._windowed(x, w, n, nums)
        return out.where((F.col("ts") >= self.start) & (F.col("ts") <= self.end))

    def _spread(self, x: DataFrame, w: int, closed: bool) -> DataFrame:
        """Each point at the evaluation times whose window holds it: (t-w, t] or [t-w, t]."""
        first = F.ceil((F.col("ts") - self.start) / self.step) * self.step + self.start
        last = F.floor((F.col("ts") + w - (0 if closed else 1) - self.start) / self.step) * self.step + self.start
        first, last = F.greatest(first, F.lit(self.start)).cast("bigint"), F.least(last, F.lit(self.end)).cast("bigint")
        return x.withColumn("t", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(self.step).cast("bigint")))))

    def _over_time(self, x: DataFrame, w: int, f: Callable[[Column, Column], Column]) -> DataFrame:
        """An empty window of a series gives 0."""
        g = self._spread(x, w, False).groupBy("labels", "t").agg(f(F.col("value"), F.col("ts")).alias("value"))
        all_times = x.select("labels").distinct().withColumn("t", F.explode(F.sequence(F.lit(self.start).cast("bigint"), F.lit(self.end).cast("bigint"), F.lit(self.step).cast("bigint"))))
        j = all_times.join(g, ["labels", "t"], "left")
        return j.select("labels", F.col("t").alias("ts"), F.coalesce("value", F.lit(0.0)).alias("value"))

    def _extrapolated(self, x: DataFrame, w: int, per_second: bool) -> DataFrame:
        """Increase with counter resets added back, stretched to the window's bounds.

        Only sums and extremes of the window are needed: the sum of steps
        (a reset counts from 0) less the step into its first point."""
        prev = F.lag("value").over(Window.partitionBy("labels").orderBy("ts"))
        x = x.withColumn("inc", F.when(prev.isNull(), 0.0).when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev))
        g = self._spread(x, w, True).groupBy("labels", "t").agg(
            F.count("*").alias("n"), F.sum("inc").alias("all"), F.min_by("inc", "ts").alias("inc0"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min_by("value", "ts").alias("v0")
        ).where("n >= 2")
        d = F.col("all") - F.col("inc0")
        span = (F.col("t1") - F.col("t0")).cast("double")
        mean = span / (F.col("n") - 1)
        a, b = (F.col("t0") - (F.col("t") - w)).cast("double"), (F.col("t") - F.col("t1")).cast("double")
        zero = F.when((d > 0) & (F.col("v0") >= 0), span * F.col("v0") / d)
        a = F.when(a >= 1.1 * mean, mean / 2).otherwise(a)
        a = F.least(a, zero)
        b = F.when(b >= 1.1 * mean, mean / 2).otherwise(b)
        v = d * (span + a + b) / span
        return g.select("labels", F.col("t").alias("ts"), (v / w if per_second else v).alias("value"))

    def _windowed(self, x: DataFrame, w: int, n: str, nums: list[float]) -> DataFrame:
        s = Window.partitionBy("labels").orderBy("ts")
        win = s.rangeBetween(-w, 0)
        v, t = F.col("value"), F.col("ts")
        prev, prev_t = F.lag("value").over(s), F.lag("ts").over(s)
        near = t - prev_t <= w
        if n == "delta":
            c = v - F.first("value").over(win)
        elif n == "idelta":
            c = F.when(near, v - prev)
        elif n == "irate":
            c = F.when(near, F.when(v < prev, v).otherwise(v - prev) / (t - prev_t))
        elif n in ("deriv", "predict_linear"):
            slope = F.regr_slope(v, t.cast("double")).over(win)
            c = slope if n == "deriv" else v + slope * (nums[0] if nums else 0.0)
        elif n in ("changes", "resets"):
            flag = (v != prev if n == "changes" else v < prev).cast("int")
            x = x.withColumn("__f", F.coalesce(flag, F.lit(0)))
            c = (F.sum("__f").over(win) - F.first("__f").over(win)).cast("double")
        elif n == "stdvar_over_time":
            c = F.var_pop(v).over(win)
        elif n == "stddev_over_time":
            c = F.stddev_pop(v).over(win)
        elif n == "present_over_time":
            c = F.lit(1.0)
        elif n == "quantile_over_time":
            c = F.percentile(v, nums[0]).over(win)
        elif n == "mad_over_time":
            x = x.withColumn("__a", F.array_sort(F.collect_list(v).over(win)))
            mid = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
            x = x.withColumn("__m", mid(F.col("__a")))
            c = mid(F.array_sort(F.transform("__a", lambda y: F.abs(y - F.col("__m")))))
        else:
            raise QueryError(f"unknown function {n}")
        return x.select("labels", "ts", c.alias("value")).where("value is not null")

    def labels(self, n: str, args: tuple) -> DataFrame:
        x = self._frame(args[0])
        names = [a.value for a in args[1:] if isinstance(a, P.Text)]
        if n == "label_replace":
            dst, repl, src, pat = names
            old = get(F.col("labels"), src)
            full = f"^(?:{pat})$"
            new = F.when(old.rlike(full), F.regexp_replace(old, full, repl)).otherwise(get(F.col("labels"), dst))
        else:
            dst, sep, *srcs = names
            new = F.concat_ws(sep, *[get(F.col("labels"), s) for s in srcs])
        rest = F.filter("labels", lambda e: e["key"] != dst)
        put = F.sort_array(F.concat(rest, F.array(F.struct(F.lit(dst).alias("key"), F.col("__new").alias("value")))))
        return x.withColumn("__new", new).select(F.when(F.col("__new") == "", rest).otherwise(put).alias("labels"), "ts", "value")

    def histogram_quantile(self, phi: float, x: DataFrame) -> DataFrame:
        """Interpolated quantile of cumulative buckets by ``le``."""
        le = get(F.col("labels"), "le")
        bound = F.when(F.lower(le).isin("+inf", "inf"), float("inf")).otherwise(le.try_cast("double"))
        b = x.select(lose(F.col("labels"), ("le",)).alias("labels"), "ts", bound.alias("le"), "value").where("le is not null")
        b = b.groupBy("labels", "ts", "le").agg(F.sum("value").alias("value"))
        g = b.groupBy("labels", "ts").agg(F.array_sort(F.collect_list(F.struct("le", "value"))).alias("b"))
        n = F.size("b")
        total = F.element_at("b", -1)["value"]
        ok = (n >= 2) & (F.element_at("b", -1)["le"] == float("inf")) & (total > 0)
        rank = total * phi
        i = F.size(F.filter("b", lambda e: e["value"] < rank))
        g = g.withColumns({"__i": i, "__rank": rank, "__ok": ok, "__n": n})
        hi, lo = F.get("b", F.col("__i")), F.get("b", F.col("__i") - 1)
        start = F.when(F.col("__i") == 0, 0.0).otherwise(lo["le"])
        base = F.when(F.col("__i") == 0, 0.0).otherwise(lo["value"])
        inside = start + (hi["le"] - start) * F.try_divide(F.col("__rank") - base, hi["value"] - base)
        v = (
            F.when(~F.col("__ok"), float("nan"))
            .when(F.col("__i") >= F.col("__n") - 1, F.get("b", F.col("__n") - 2)["le"])
            .when((F.col("__i") == 0) & (hi["le"] <= 0), hi["le"])
            .otherwise(inside)
        )
        if phi < 0 or phi > 1:
            v = F.lit(float("-inf") if phi < 0 else float("inf"))
        return g.select("labels", "ts", v.alias("value"))

    # ---- binary operators
    def binary(self, e: P.Binary) -> DataFrame | float:
        a, b = self.eval(e.left), self.eval(e.right)
        if isinstance(a, float) and isinstance(b, float):
            return _numbers(e.op, a, b)
        if e.op in ("and", "or", "unless"):
            return self._sets(e, a, b)
        if isinstance(a, float) or isinstance(b, float):
            x = b if isinstance(a, float) else a
            left = F.lit(a) if isinstance(a, float) else F.col("value")
            right = F.lit(b) if isinstance(b, float) else F.col("value")
            y = x.withColumn("__v", _apply(e.op, left, right, e.as_bool, F.col("value"))).where("__v is not null")
            labels = F.col("labels") if e.op in COMPARE and not e.as_bool else drop_name(F.col("labels"))
            return y.select(labels.alias("labels"), "ts", F.col("__v").alias("value"))
        m = e.matching
        if self.loose and m.on is None and m.ignoring is None:
            return self._loose(e, a, b)
        many_right = m.group == "group_right"
        key = lambda c: keep(c, m.on) if m.on is not None else lose(c, m.ignoring or ())
        left = a.select(key(F.col("labels")).alias("k"), drop_name(F.col("labels")).alias("la"), "ts", F.col("value").alias("va"))
        right = b.select(key(F.col("labels")).alias("k"), drop_name(F.col("labels")).alias("lb"), "ts", F.col("value").alias("vb"))
        if m.group is None or not many_right:
            right = _unique(right, "lb")
        if m.group is None or many_right:
            left = _unique(left, "la")
        j = left.join(right, ["k", "ts"])
        out = F.col("k") if m.group is None and m.on is not None else F.col("lb") if many_right else F.col("la")
        if m.include:
            one = F.col("la") if many_right else F.col("lb")
            out = F.sort_array(F.concat(F.filter(out, lambda x: ~x["key"].isin(list(m.include))), F.filter(one, lambda x: x["key"].isin(list(m.include)))))
        j = j.withColumn("__v", _apply(e.op, F.col("va"), F.col("vb"), e.as_bool, F.col("va"))).where("__v is not null")
        return j.select(out.alias("labels"), "ts", F.col("__v").alias("value"))

    def _loose(self, e: P.Binary, a: DataFrame, b: DataFrame) -> DataFrame:
        """Operation by time only, for a side of one series; both sides of several series match by labels."""
        one = lambda x: x.select("labels").distinct().limit(2).count() <= 1
        right_one = one(b)
        if not right_one and not one(a):
            self.loose = False
            try:
                return self.binary(e)
            finally:
                self.loose = True
        left = a.select(drop_name(F.col("labels")).alias("la"), "ts", F.col("value").alias("va"))
        right = b.select(drop_name(F.col("labels")).alias("lb"), "ts", F.col("value").alias("vb"))
        j = left.join(right, "ts").withColumn("__v", _apply(e.op, F.col("va"), F.col("vb"), e.as_bool, F.col("va"))).where("__v is not null")
        return j.select(F.col("la" if right_one else "lb").alias("labels"), "ts", F.col("__v").alias("value"))

    def _sets(self, e: P.Binary, a: DataFrame | float, b: DataFrame | float) -> DataFrame:
        if isinstance(a, float) or isinstance(b, float):
            raise QueryError(f"{e.op} needs vectors")
        m = e.matching
        key = lambda c: keep(c, m.on) if m.on is not None else lose(c, m.ignoring or ())
        left, right = a.withColumn("k", key(F.col("labels"))), b.withColumn("k", key(F.col("labels")))
        if e.op == "and":
            return left.join(right.select("k").distinct(), "k", "left_semi").drop("k")
        if e.op == "unless":
            return left.join(right.select("k").distinct(), "k", "left_anti").drop("k")
        return left.unionByName(right.join(left.select("k").distinct(), "k", "left_anti")).drop("k")


def _sorted(v: DataFrame, e: object, first: list[str]) -> DataFrame:
    """Rows of an outermost ``sort`` in order; inside another expression it has no effect."""
    if isinstance(e, P.Func) and e.name in ("sort", "sort_desc"):
        return v.orderBy(*first, F.col("value").desc() if e.name == "sort_desc" else F.col("value").asc(), "labels")
    return v


def _unique(x: DataFrame, labels: str) -> DataFrame:
    """One series a key and time: several on the one side are an error, raised when the plan runs."""
    v = "va" if labels == "la" else "vb"
    g = x.groupBy("k", "ts").agg(F.count("*").alias("__n"), F.first(labels).alias(labels), F.first(v).alias(v))
    return g.withColumn(v, F.when(F.col("__n") > 1, F.raise_error(F.lit("many series match on the one side")).cast("double")).otherwise(F.col(v))).drop("__n")


COMPARE = {"==", "!=", ">", "<", ">=", "<="}


def _apply(op: str, a: Column, b: Column, as_bool: bool, kept: Column) -> Column:
    if op in COMPARE:
        c = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
        return c.cast("double") if as_bool else F.when(c, kept)
    if op in ("/", "%"):  # a division by zero drops the point
        return F.when(b != 0, a / b if op == "/" else a % b)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b)}[op]()


def _numbers(op: str, a: float, b: float) -> float:
    if op in COMPARE:
        return float({"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op])
    if op in ("/", "%") and b == 0:
        raise QueryError("division by zero")
    import math

    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "^": lambda: a**b}[op]()


_NAN = float("nan")
OVER_TIME: dict[str, Callable[[Column, Column], Column]] = {
    "avg_over_time": lambda v, t: F.avg(v), "min_over_time": lambda v, t: F.min(v), "max_over_time": lambda v, t: F.max(v), "sum_over_time": lambda v, t: F.sum(v),
    "count_over_time": lambda v, t: F.count(v).cast("double"), "last_over_time": lambda v, t: F.max_by(v, t),
}
RANGE = {*OVER_TIME, *"rate increase irate delta idelta deriv predict_linear changes resets stdvar_over_time stddev_over_time present_over_time quantile_over_time mad_over_time".split()}
MATH: dict[str, Callable[..., Column]] = {
    **{n: (lambda f: lambda v: f(v).cast("double"))(getattr(F, n)) for n in "abs ceil floor exp acos acosh asin asinh atan atanh cos cosh sin sinh tan tanh".split()},
    "sqrt": lambda v: F.when(v < 0, _NAN).otherwise(F.sqrt(v)), "ln": lambda v: F.when(v < 0, _NAN).when(v == 0, float("-inf")).otherwise(F.ln(v)),
    "log2": lambda v: F.when(v < 0, _NAN).when(v == 0, float("-inf")).otherwise(F.log2(v)), "log10": lambda v: F.when(v < 0, _NAN).when(v == 0, float("-inf")).otherwise(F.log10(v)),
    "sgn": lambda v: F.signum(v), "deg": lambda v: F.degrees(v), "rad": lambda v: F.radians(v),
    "round": lambda v, to=1.0: F.floor(v / to + 0.5) * to,
    "clamp": lambda v, lo, hi: F.least(F.greatest(v, F.lit(lo)), F.lit(hi)), "clamp_min": lambda v, lo: F.greatest(v, F.lit(lo)), "clamp_max": lambda v, hi: F.least(v, F.lit(hi)),
}
TIME: dict[str, Callable[[Column], Column]] = {
    "hour": F.hour, "minute": F.minute, "month": F.month, "year": F.year, "day_of_month": F.dayofmonth, "day_of_week": lambda t: F.dayofweek(t) - 1, "day_of_year": F.dayofyear, "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
}
