"""Sketches: unbiased within their bounds, mergeable in any order, deletions, edge cases."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelode.llm import cells, distinct, quantiles

M = "point_id bigint, metric string, tags map<string,string>, timestamp bigint, value double, ingest_ms bigint"


def regs_of(ids, m=256):
    r = np.full((1, m), np.inf)
    distinct.add(r, np.zeros(len(ids), np.int64), np.asarray(ids, np.int64))
    return r[0]


def test_distinct_is_unbiased_and_covered():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 1000, 30_000):
        rel, hits = [], 0
        for _ in range(60):
            r = regs_of(rng.integers(-(2**62), 2**62, n))
            rel.append(distinct.estimate(r) / n - 1)
            lo, hi = distinct.interval(r)
            hits += lo <= n <= hi
        assert abs(np.mean(rel)) < 4 / np.sqrt(254) / np.sqrt(60)
        assert 0.7 / np.sqrt(254) < np.std(rel) < 1.35 / np.sqrt(254)
        assert hits >= 50


def test_distinct_merges_as_union():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**62, 500), rng.integers(0, 2**62, 700)
    pack = lambda x: regs_of(x).astype(np.float32).tobytes()
    both = np.frombuffer(distinct.merge([pack(a), pack(b), pack(a)]), np.float32)
    np.testing.assert_array_equal(both, regs_of(np.concatenate([b, a, a])).astype(np.float32))


def test_distinct_cube(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        day, tag = int(rng.integers(0, 3)), ["a", "b", None][int(rng.integers(0, 3))]
        tags = {} if tag is None else {"group": tag}
        if i % 3 == 0:
            c = f"c{int(rng.integers(0, 400))}"
            tags = tags | {"client": f" {c.upper()} " if i % 2 else c}
        rows.append((i, "m.x" if i % 2 else "m_x", tags | {"e": ""}, day * 86_400 + i % 1000, None, 0))
    rows += [(9000, None, None, None, 1.0, 0), (9001, "m.x", {"client": "  "}, 5, 1.0, 0)]
    df = spark.createDataFrame(rows, M).withColumn("day", F.lit("clash")).withColumn("series", F.lit(1))
    ids = distinct.metric_identifiers(df)
    got = distinct.counts(distinct.rollup(distinct.sketches(ids))).toPandas()
    p = ids.toPandas()
    for kind in ("series", "client"):
        all_ = got[(got.kind == kind) & ~got.by_day & ~got.by_metric & ~got.by_tag].iloc[0]
        n = p[kind].dropna().nunique()
        assert all_.low * 0.95 <= n <= all_.high * 1.05, (kind, n, all_.estimate)
    per = got[(got.kind == "client") & got.by_tag & ~got.by_day & ~got.by_metric]
    assert set(per.tag.fillna("-")) == {"a", "b", "-"}
    for r in per.itertuples():
        q = p[p.tag.isna()] if r.tag is None else p[p.tag == r.tag]
        assert abs(r.estimate / q.client.dropna().nunique() - 1) < 0.15
    assert distinct.counts(distinct.rollup(distinct.sketches(distinct.metric_identifiers(spark.createDataFrame([], M))))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, width=64), st.floats(allow_nan=False, width=64))
def test_codes_keep_order(a, b):
    ca, cb = quantiles.encode(np.array([a, b]))
    assert (ca <= cb) if a <= b else (ca >= cb)
    d = quantiles.decode(np.array([ca]))[0]
    if 1e-300 < abs(a) < 1e300:
        assert abs(d - a) <= abs(a) * 2.0 ** -(quantiles.BITS - 12)


def state(v):
    c, w = np.unique(quantiles.encode(np.asarray(v)), return_counts=True)
    return quantiles.pack(c, w)


def test_quantiles_within_bounds_and_deletions():
    rng = np.random.default_rng(8)
    qs = (0.01, 0.1, 0.5, 0.9, 0.99)
    for v in (rng.normal(50, 10, 200_000), rng.lognormal(3, 2, 200_000), np.concatenate([np.full(90_000, 7.0), rng.uniform(-5, 5, 110_000)])):
        parts = [state(x) for x in np.array_split(v, 7)]
        s = quantiles.merge([quantiles.merge(parts[:3]), *parts[3:]])
        assert quantiles.is_sketch(s) and quantiles.count(s) == len(v)
        one = quantiles.merge(parts[::-1])
        assert one == s  # the order of merging does not matter
        a = np.sort(v)
        for q, x in zip(qs, quantiles.quantiles(s, qs)):
            tol = abs(x) * 2e-4
            lo, hi = np.searchsorted(a, x - tol) / len(a), np.searchsorted(a, x + tol, "right") / len(a)
            assert max(lo - q, q - hi, 0) <= max(quantiles.rank_error(s, qs), 0.002)
        c, w = np.unique(quantiles.encode(v), return_counts=True)
        gone = quantiles.merge([s, quantiles.dense_of(c, -w).tobytes()])
        assert quantiles.count(gone) == 0 and not quantiles._counters(gone).any()


def test_percentiles_query_path(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, "m.x", {"group": "g"}, 86_400 * (i % 2), float(i), 0) for i in range(101)] + [(200, "m_x", None, None, nan, 0), (201, "m_x", None, 5, None, 0), (202, "inf", {"group": ""}, 5, inf, 0), (203, None, None, None, 1.0, 0)]
    df = spark.createDataFrame(rows, M).withColumn("day", F.lit(0)).withColumn("sets", F.lit(0))
    p = quantiles.percentiles(quantiles.rollup(quantiles.sketches(quantiles.metric_values(df))), (0.5,)).toPandas()
    m = p[p.by_metric & ~p.by_day & ~p.by_tag]
    m = m.assign(k=m.metric.fillna("-")).set_index("k")
    assert m.loc["m_x"].n == 101 and abs(m.loc["m_x"].p50 - 50) < 0.02
    assert m.loc["inf"].p50 == inf and m.loc["-"].n == 1
    assert p[~p.by_metric & ~p.by_day & ~p.by_tag].iloc[0].n == 103
    gone = quantiles.metric_values(df).withColumn("weight", F.lit(-1).cast("bigint"))
    both = quantiles.metric_values(df).withColumn("weight", F.lit(1).cast("bigint")).unionByName(gone)
    assert quantiles.percentiles(quantiles.sketches(both)).toPandas().n.sum() == 0
    assert quantiles.percentiles(quantiles.rollup(quantiles.sketches(quantiles.metric_values(spark.createDataFrame([], M))))).count() == 0
    assert cells.ALL_SETS == 7


def test_form_of_a_state_does_not_depend_on_the_order_of_deletions():
    rng = np.random.default_rng(9)
    one, two = rng.normal(0, 1, 300), rng.normal(5, 1, 300)
    parts = []
    for v, sign in ((one, 1), (two, 1), (one, -1)):
        c, w = np.unique(quantiles.encode(v), return_counts=True)
        parts.append(quantiles.pack(c, sign * w, 500))
    a, b, gone = parts
    left = quantiles.merge([quantiles.merge([a, b], 500), gone], 500)
    right = quantiles.merge([quantiles.merge([a, gone], 500), b], 500)
    assert left == right and quantiles.is_sketch(left) and quantiles.count(left) == 300
    small = quantiles.merge([quantiles.merge([a, gone]), b])
    assert not quantiles.is_sketch(small) and small == quantiles.merge([a, b, gone]) and quantiles.count(small) == 300
    np.testing.assert_array_equal(quantiles.quantiles(small, (0.1, 0.5)), quantiles.quantiles(b, (0.1, 0.5)))
    heavy = quantiles.merge([quantiles.pack(np.array([5]), np.array([2**35])), quantiles.pack(np.array([5]), np.array([2**35]))])
    assert quantiles.is_sketch(heavy) and quantiles.count(heavy) == 2**36


def test_merging_many_cells_is_merging_each(spark):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        v = rng.normal(i % 7, 2, int(rng.integers(1, 60))).round(2)
        c, w = np.unique(quantiles.encode(v), return_counts=True)
        rows.append((0, 7, None, f"m{i % 3}", f"k{cells.KEYS[0]}{i % 11}", quantiles.pack(c, w, 40)))
    rows.sort(key=lambda r: (r[3], r[4]))
    t = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), cells._ARROW)], schema=cells._ARROW)
    want = {}
    for r in rows:
        want.setdefault(r[:5], []).append(r[5])
    for most in (100, 2_000, 10**9):
        out = list(cells.merge_sorted(quantiles.merge_many(40), most)(iter(t.to_batches(max_chunksize=13))))
        got = [tuple(x) for b in out for x in zip(*(c.to_pylist() for c in b.columns))]
        assert len(got) == len(want) and all(quantiles.merge(want[g[:5]], 40) == g[5] for g in got)
        by_tag = sorted(got, key=lambda g: g[4])
        s = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*by_tag), cells._ARROW)], schema=cells._ARROW)
        rolled = [tuple(x) for b in cells._tag_roller(quantiles.merge_many(40), most)(iter(s.to_batches(max_chunksize=5))) for x in zip(*(c.to_pylist() for c in b.columns))]
        coarse = {}
        for g in got:
            for k in (g[:5], (0, 5, g[2], None, g[4]), (0, 3, None, g[3], g[4]), (0, 1, None, None, g[4])):
                coarse.setdefault(k, []).append(g[5])
        assert len(rolled) == len(coarse) and all(quantiles.merge(coarse[r[:5]], 40) == r[5] for r in rolled)


def test_coarser_cells():
    assert sorted(cells.coarser_sets(7, 7)) == list(range(8)) and cells.coarser_sets(5, 0) == [5]
    assert sorted(cells.coarser_sets(7, 6)) == [1, 3, 5, 7] and sorted(cells.coarser_sets(6, 6)) == [0, 2, 4, 6] and sorted(cells.coarser_sets(3, 6)) == [1, 3]
