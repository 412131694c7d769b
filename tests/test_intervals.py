"""Intervals against a plain sweep."""

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from tracelode.operators import intervals
from tracelode.operators.segments import segment_spans

S = "key string, f bigint, l bigint"


def sweep(rows):
    gaps, periods, by = [], [], {}
    for k, f, e in rows:
        if k is not None and f is not None and e is not None and f <= e:
            by.setdefault(k, []).append((f, e))
    for k, v in by.items():
        v.sort()
        a, b = v[0]
        for f, e in v[1:]:
            if f > b + 1:
                periods.append((k, a, b))
                gaps.append((k, b + 1, f - 1))
                a, b = f, e
            else:
                b = max(b, e)
        periods.append((k, a, b))
    return sorted(gaps), sorted(periods)


def run(spark, rows, bucket):
    c = intervals.covered_lists(spark.createDataFrame(rows, S), "key", "f", "l", bucket)
    return sorted(map(tuple, intervals.gaps(c).collect())), sorted(map(tuple, intervals.periods(c).collect()))


def test_random_against_sweep(spark):
    rng = np.random.default_rng(1)
    for bucket, width in ((10, 30), (1000, 30), (7, 3), (50, 400)):
        rows = [(f"k{int(rng.integers(0, 4))}", int(f), int(f + rng.integers(-2, width))) for f in rng.integers(-500, 1500, 400)]
        assert run(spark, rows, bucket) == sweep(rows)


def test_edges(spark):
    rows = [("a", 1, 3), ("a", 4, 6), ("a", 8, 8), ("a", 8, 8), (None, 1, 9), ("b", None, 3), ("b", 5, 4), ("c", 0, 10**9), ("c", 5, 6)]
    assert run(spark, rows, 2) == sweep(rows)
    assert run(spark, [], 10) == ([], [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 60), st.integers(0, 25)), max_size=60))
def test_merge_lists(rows):
    rows = sorted((g, f, f + w) for g, f, w in rows)
    g, f, e = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    got = sorted((f"{a}", int(b), int(c)) for a, b, c in zip(*intervals.merge_lists(g, f, e)))
    assert got == sweep([(f"{a}", b, c) for a, b, c in rows])[1]


def test_segment_units(spark):
    rows = [("x", 1609632000, 1609632010123456789), ("x", 1609632000000, None), ("x", 0, 1609632000000), (None, 1609632000, 1609632001), ("x", 1609632010, 1609632000)]
    got = segment_spans(spark.createDataFrame(rows, "virtual_table_name string, earliest_epoch_ms bigint, latest_epoch_ms bigint")).collect()
    assert [tuple(r) for r in got] == [("x", 1609632000000, 1609632010123)]


def test_small_partial_lists_and_narrow_windows(spark, monkeypatch, capfd):
    rng = np.random.default_rng(4)
    rows = [("hot" if rng.random() < 0.6 else f"k{int(rng.integers(0, 4))}", int(f), int(f + rng.integers(0, 9))) for f in rng.integers(0, 30_000, 6_000)]
    df = spark.createDataFrame(rows, S).repartition(7)
    c = intervals.covered_lists(df, "key", "f", "l", 100)
    assert (sorted(map(tuple, intervals.gaps(c).collect())), sorted(map(tuple, intervals.periods(c).collect()))) == sweep(rows)
    plan = intervals._reaches(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "last_ms" not in plan.split("Window")[1].split("Project")[0]
    monkeypatch.setattr(intervals, "MOST", 50)
    import pyarrow as pa

    t = pa.Table.from_pylist([dict(zip(("key", "f", "l"), r)) for r in rows])
    lists = list(intervals._partial(100)(iter(t.to_batches(max_chunksize=40))))
    assert len(lists) > 1
    whole = sorted((k, f, e) for b in lists for k, fs, es in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()) for f, e in zip(fs, es))
    assert sweep(whole) == sweep(rows)
