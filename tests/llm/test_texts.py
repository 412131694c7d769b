"""Packing, mixing and shared spans."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import mixing, packing, spans, tokens

SIZES, SPECS = "doc_id bigint, tokens bigint", "spec_id int, capacity_tokens int"


def test_token_sizes(spark):
    d = spark.createDataFrame([(1, "hello world", "x"), (2, None, None), (3, "", "y"), (4, "<|endoftext|> ünïcode 日本語", "z")], "doc_id bigint, text string, tokens string")
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        got = {r.doc_id: r.tokens for r in tokens.token_sizes(d, name=name).collect()}
        assert got[1] in (2, 3) and got[2] == got[3] == 0 and got[4] > 5
    a, b = ({r.doc_id: r.tokens for r in tokens.token_sizes(d, name=n).collect()} for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    assert a == b  # the same vocabulary in two libraries


def test_packing(spark):
    rng = np.random.default_rng(1)
    sizes = [(i, int(s)) for i, s in enumerate(rng.lognormal(4, 1.3, 4000))] + [(9001, 0), (9002, 5000), (9003, 7), (9003, 7), (9004, None)]
    df = spark.createDataFrame(sizes, SIZES).repartition(5).withColumn("bin", F.lit(1)).withColumn("capacity", F.lit(3))
    specs = spark.createDataFrame([(1, 100), (2, 1024), (3, None), (4, 0)], SPECS)
    rows = packing.containers(df, specs).collect()
    for spec, cap in ((1, 100), (2, 1024)):
        mine = [r for r in rows if r.spec_id == spec]
        load, got = Counter(), defaultdict(list)
        for r in mine:
            assert r.bin is not None
            load[r.bin] += r.tokens
            got[r.doc_id].append((r.piece, r.tokens))
        assert max(load.values()) <= cap
        want = Counter()
        for i, s in sizes:
            want[i] += s or 0
        assert {i: sum(t for _, t in p) for i, p in got.items()} == {i: s for i, s in want.items() if s}
        for i, s in sizes:
            if s and s <= cap and i != 9003:
                assert len(got[i]) == 1  # never split below the capacity
        full = sum(load.values()) / (len(load) * cap)
        assert full > 0.75
        # containers of a class hold exactly k items, or are among the few of the last round
        per = Counter(r.bin for r in mine)
        klass = {r.bin: cap // r.tokens for r in mine}
        odd = [b for b in per if b[0] not in "ch" and per[b] != klass[b]]
        assert not odd
        # with guests: k items of class k <= HOSTS and as many of one further class
        for b in {b for b in per if b[0] == "h"}:
            c = Counter(cap // r.tokens for r in mine if r.bin == b)
            assert len(c) == 2 and c[min(c)] == min(c) <= packing.HOSTS
    rep = {r.spec_id: r for r in packing.fill_report(packing.containers(df, specs)).collect()}
    assert set(rep) == {1, 2} and rep[2].filled > 0.75
    assert packing.containers(spark.createDataFrame([], SIZES), specs).count() == 0
    assert packing.containers(df, spark.createDataFrame([], SPECS)).count() == 0


def test_guests_always_fit():
    rng = np.random.default_rng(2)
    for cap in (1, 2, 7, 100, 997):
        tok = np.minimum(np.maximum(rng.lognormal(np.log(cap / 3 + 1), 1.2, 3_000).astype(int), 1), cap)
        b = packing.hosted(cap, tok)
        load = np.bincount(b[b >= 0], tok[b >= 0])
        assert (load <= cap).all() and (load > 0).all()
    assert packing.hosted(10, np.zeros(0, int)).tolist() == [] and packing.hosted(10, np.array([10, 10])).tolist() == [-1, -1]
    assert packing.hosted(10, np.array([6, 3])).tolist() == [0, 0] and packing.hosted(10, np.array([6, 2, 2])).tolist().count(0) == 2


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["Big", " big ", "mid", "tiny", None, "other"][int(rng.choice(6, p=[0.4, 0.1, 0.3, 0.02, 0.08, 0.1]))], int(rng.integers(0, 200))) for i in range(20_000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").withColumn("use", F.lit("clash")).withColumn("bucket", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 5), (None, 0.5, 1), ("zero", None, 1)], "source string, weight double, max_repeats int")
    have = Counter()
    for _, s, t in rows:
        have[(s or "none").strip().lower()] += t
    # the most at which nobody is above the cap: every share is met
    sel, shares = mixing.mixture(sizes, targets, total=int(have["tiny"] * 5 * 9))
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"big", "mid", "tiny"}
    for name, w in (("big", 5 / 9), ("mid", 3 / 9), ("tiny", 1 / 9)):
        assert s[name].target_share == pytest.approx(w) and s[name].actual_share == pytest.approx(w, abs=0.004)
        assert s[name].most_uses <= s[name].max_repeats
    uses = Counter(r.doc_id for r in sel.where("source = 'tiny'").collect())
    assert max(uses.values()) == 5 and min(uses.values()) >= 4
    pos = [(r.position, r.tokens) for r in sel.orderBy("position").collect()]
    done = np.cumsum([t for _, t in pos])
    assert np.max(np.abs(done - [p for p, _ in pos])) < 0.02 * done[-1]  # positions follow the tokens given out
    # half a curriculum: big comes only in the first half of its time
    sel, shares = mixing.mixture(sizes, targets, {"BIG ": ((0.0, 2.0), (0.5, 2.0), (0.5001, 0.0), (1.0, 0.0))})
    r = {r.source: r for r in shares.collect()}
    rest = sum(x.demand for k, x in r.items() if k != "big") / 2
    assert sel.where("source = 'big'").agg(F.max("position")).first()[0] <= (r["big"].demand + rest) * 1.001
    small = mixing.mixture(sizes, targets, total=10_000)[1]
    assert abs(sum(r.tokens for r in small.collect()) - 10_000) < 400
    empty = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")
    a, b = mixing.mixture(empty, targets)
    assert a.count() == 0 and all(r.tokens == 0 for r in b.collect())
    for wrong in (((0.0, 1.0), (0.9, 1.0)), ((0.0, -1.0), (1.0, 3.0))):
        with pytest.raises(ValueError):
            mixing.mixture(sizes, targets, {"big": wrong})


def fill(have: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Water-filling by bisection on the level."""
    most = {s: have.get(s, 0) * m for s, (_, m) in targets.items()}
    if sum(most.values()) <= total:
        return {s: float(x) for s, x in most.items()}
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most[s], w * mid) for s, (w, _) in targets.items()) < total else (lo, mid)
    return {s: min(most[s], w * hi) for s, (w, _) in targets.items()}


@pytest.mark.parametrize("total", [0, 1_000, 50_000, 300_000, 10_000_000, None])
def test_mixing_fills_up_to_the_caps(spark, total):
    rng = np.random.default_rng(5)
    rows = [(i, ["a", "b", "c", "d"][int(rng.choice(4, p=[0.7, 0.2, 0.08, 0.02]))], int(rng.integers(1, 90))) for i in range(6_000)]
    listed = {"a": (0.2, 1), "b": (0.3, 2), "c": (0.2, 3), "d": (0.2, 4), "ghost": (0.1, 9)}
    have = Counter()
    for _, s, t in rows:
        have[s] += t
    targets = spark.createDataFrame([(s, w, m) for s, (w, m) in listed.items()], "source string, weight double, max_repeats int")
    sel, shares = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint"), targets, total=total)
    want = fill(have, listed, sum(have.values()) if total is None else total)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == set(listed)
    for s, r in got.items():
        assert r.demand == pytest.approx(want[s], abs=1e-3) and abs(r.tokens - want[s]) <= 45
        assert r.target_share == pytest.approx(listed[s][0]) and r.capped == (want[s] >= have[s] * listed[s][1] - 1e-3)
        assert r.shortfall == pytest.approx(r.target_share * (sum(have.values()) if total is None else total) - r.tokens)
    uses = Counter((r.doc_id, r.source) for r in sel.collect())
    assert all(n <= listed[s][1] for (_, s), n in uses.items())


def test_curriculum_positions_are_running_tokens(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "abc"[int(rng.choice(3, p=[0.6, 0.3, 0.1]))], int(rng.integers(1, 50))) for i in range(5_000)]
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.2, 2)], "source string, weight double, max_repeats int")
    ramps = {"a": ((0.0, 2.0), (0.4, 1.0), (1.0, 0.0)), "b": ((0.0, 0.0), (1.0, 3.0))}
    sel, shares = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint"), targets, ramps)
    x = sorted((r.position, r.tokens) for r in sel.collect())
    before = np.concatenate([[0], np.cumsum([t for _, t in x])[:-1]])
    middle = before + np.array([t for _, t in x]) / 2
    assert np.max(np.abs(middle - [p for p, _ in x])) <= 3 * 50
    first = [r.source for r in sel.orderBy("position").limit(400).collect()]
    assert first.count("a") > 250 and first.count("b") < 60


def brute(texts, run=150):
    g = defaultdict(set)
    for i, t in texts.items():
        for a in range(len(t or "") - run + 1):
            g[t[a : a + run]].add(i)
    pairs, cover = set(), {}
    for v in g.values():
        pairs |= {(a, b) for a in v for b in v if a < b}
    for i, t in texts.items():
        c = np.zeros(len(t or "") + 1, int)
        for a in range(len(t or "") - run + 1):
            if len(g[t[a : a + run]]) > 1:
                c[a] += 1
                c[a + run] -= 1
        cover[i] = int((np.cumsum(c)[:-1] > 0).sum())
    return pairs, cover


def check(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("fp", F.lit(1)).withColumn("chars", F.lit("x"))
    r = spans.CommonRuns(df)
    pairs = [tuple(x) for x in r.pairs().collect()]
    want, cover = brute(texts)
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert {x.doc_id: x.shared_chars for x in r.report().collect()} == cover


def test_common_runs_random(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh ij.é日🎉"), n))
    pool = [word(int(n)) for n in rng.integers(140, 400, 12)]
    texts = {}
    for i in range(80):
        parts = []
        for _ in range(int(rng.integers(0, 4))):
            p = pool[int(rng.integers(0, len(pool)))]
            a = int(rng.integers(0, 60))
            parts += [word(int(rng.integers(0, 90))), p[a : a + int(rng.integers(100, 300))]]
        texts[i] = "".join(parts)
    texts |= {100: None, 101: "", 102: pool[0] * 3, 103: pool[0] * 3, 104: pool[0] * 2, 105: "=" * 400, 106: "x" + "=" * 200 + "y", 107: "ab" * 200, 108: "q" + "ab" * 90, 109: "=" * 149, 110: pool[1][:150], 111: pool[1][:150], 112: pool[1][1:151]}
    check(spark, texts)


def test_hot_spans_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 0)
    test_common_runs_random(spark)
    test_common_runs_exact_bound(spark)


def test_larger_classes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(spans, "FEW", 0)
    test_common_runs_random(spark)
    test_common_runs_exact_bound(spark)


def test_paragraph_in_many_posts(spark, monkeypatch):
    rng = np.random.default_rng(12)
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    paragraph = "".join(rng.choice(alphabet, 220))
    own = lambda: "".join(rng.choice(alphabet, 90))
    posts = [(i, own() + paragraph + own()) for i in range(3_000)]
    df = spark.createDataFrame(posts, "doc_id bigint, text string")
    for hot in (10**9, 500):  # gathered as one class, and grouped without being gathered
        monkeypatch.setattr(spans, "HOT", hot)
        r = spans.CommonRuns(df)
        assert r.hot == (hot == 500)
        got = r.report().agg(F.min("shared_chars"), F.count(F.when(F.col("shared_chars") >= 220, 1))).first()
        assert got[0] >= 220 and got[1] == 3_000
        assert r.pairs().count() == 3_000 * 2_999 // 2
    # members leave a task, not their pairs
    monkeypatch.setattr(spans, "HOT", 10**9)
    assert spans.CommonRuns(df)._by_span().mapInArrow(spans._links, spans._LINKS).count() < 3_000 * 300


def test_common_runs_exact_bound(spark):
    rng = np.random.default_rng(9)
    core = "".join(rng.choice(list("abcdefghijklmnop"), 150))
    pad = lambda k: "".join(rng.choice(list("ABCDEFGHIJ"), k))
    texts = {2 * i: pad(i) + core[:n] + pad(7) for i, n in enumerate([150, 149, 150, 150, 149] * 8)}
    check(spark, texts)


def test_very_long_text(spark):
    rng = np.random.default_rng(10)
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300_000))
    df = spark.createDataFrame([(1, long), (2, long[150_000:150_151]), (3, long[-150:])], "doc_id bigint, text string")
    assert sorted(map(tuple, spans.CommonRuns(df).pairs().collect())) == [(1, 2), (1, 3)]
    old, spans._PIECE = spans._PIECE, 1000
    try:  # pieces of a text lose nothing
        ids, pos, h = spans.kept_spans([long[:5000]])
        got = set()
        for b in spans._spans(iter([__import__("pyarrow").RecordBatch.from_pydict({"d": [1], "t": [long[:5000]]})])):
            got |= set(zip(b.column("pos").to_pylist(), b.column("fp").to_pylist()))
        assert set(zip(pos.tolist(), h.tolist())) <= got
    finally:
        spans._PIECE = old


def test_sentence_spans(spark):
    a = "First sentence is here to stay for long. " * 1 + "Second sentence follows with many more words in it. Third one closes the paragraph at last, being rather long too."
    docs = [(1, "Intro. " + a), (2, "Other start! " + a + " Different end."), (3, "Nothing shared."), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("start", F.lit(0))
    got = spans.sentence_spans(df).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.doc_id for r in got if r.first} == {1}
    rep = {r.doc_id: r for r in spans.sentence_report(df).collect()}
    assert rep[2].removable_chars == len(a) and rep[1].removable_chars == 0 and rep[3].shared_chars == 0 and set(rep) == {1, 2, 3, 4, 5}
    assert spans.sentence_report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id bigint, text string")
    r = spans.CommonRuns(e)
    assert r.pairs().count() == 0 and r.report().count() == 0
