"""Percentiles of every tag against brute force."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tracelode.llm import cells as C
from tracelode.llm import quantiles
from tracelode.llm.queries import p7_percentiles

M = "point_id bigint, metric string, tags map<string,string>, timestamp bigint, value double, ingest_ms bigint"


def test_every_tag_has_percentiles(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(9000):
        tags = {"group": ["g0", "g1", ""][i % 3], "color": ["red", "blue"][i % 2]} | ({"client": [" C1 ", "c1", "C2"][i % 3]} if i % 5 == 0 else {})
        rows.append((i, ["m.x", "m_x", "n"][i % 3 if i % 7 else 2], None if i % 11 == 0 else tags, 86_400 * (i % 2) + i % 60, None if i % 13 == 0 else math.nan if i % 17 == 0 else float(rng.normal(20, 9)), 0))
    spark.createDataFrame(rows, M).write.parquet(f"{tmp_path}/metrics.parquet")
    want = defaultdict(list)
    for _, m, tags, t, v, _ in rows:
        if v is None or math.isnan(v):
            continue
        clean = {k: x.strip().lower() if k == "client" else x for k, x in (tags or {}).items()}
        clean = {k: x for k, x in clean.items() if x}
        m = m.replace(".", "_")
        for d, n in itertools.product((None, t // 86_400), (None, m)):
            want[False, d, n, None, None].append(v)
            for k, x in ({"group": None} | clean).items():
                want[True, d, n, k, x].append(v)
    got = p7_percentiles(spark, str(tmp_path)).collect()
    cells = set()
    for r in got:
        day = None if r.day is None else (r.day.toordinal() - 719_163)
        key = (r.by_tag, day, r.metric, r.key, r.tag)
        cells.add(key)
        v = np.sort(want[key])
        assert r.n == len(v), key
        for q, value in ((0.5, r.p50), (0.95, r.p95)):
            x = v[math.ceil(q * len(v)) - 1]
            if r.rank_error == 0:
                assert abs(value - x) <= abs(x) * 1e-3 + 1e-9, key
            else:
                near = np.searchsorted(v, [value - abs(value) * 2e-4, value + abs(value) * 2e-4]) / len(v)
                assert max(near[0] - q, q - near[1], 0) <= max(r.rank_error, 0.002), key
    assert cells == set(want) and len(got) == len(want)
    assert any(r.rank_error > 0 for r in got)


def test_many_states_read_as_one_by_one():
    rng = np.random.default_rng(1)
    qs = (0.01, 0.5, 0.99)
    states = []
    for n in (1, 2, 7, 300):
        c, w = np.unique(quantiles.encode(rng.normal(0, 5, n).round(1)), return_counts=True)
        states.append(quantiles.pack(c, w))
    states.insert(2, b"")
    ns, vals = quantiles._kept(*cells_of(states), qs)
    for s, n, v in zip(states, ns, vals):
        assert n == quantiles.count(s)
        np.testing.assert_array_equal(v, quantiles.quantiles(s, qs) if n else np.full(3, np.nan))


def cells_of(states):
    return C.payload(pa.array(states, pa.binary()))
