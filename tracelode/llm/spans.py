"""Long exact spans shared between records (problem 10).

Two operators.  :func:`sentence_spans` is the sliding-sentence method: every
run of several consecutive sentences is hashed, hashes are joined globally, and
sentences covered by a repeated span that is not its first occurrence are
removed.  It cannot give every shared run of ``RUN`` characters: a run may
begin and end inside sentences and hold no whole one.

:func:`common_runs` therefore slides over character spans instead of sentence
spans: every span of ``GRAM`` characters is hashed, and of each ``WINDOW``
consecutive ones the least hash is kept (the rightmost among equals).  Since
GRAM + WINDOW - 1 = RUN, any common run of RUN characters lets both texts keep
the same span at the same place within it.  Kept spans are joined globally;
those in two different texts are looked at with their surroundings, which
decides exactly - hashes only propose.

Within the places that share a span, surroundings are sorted into a prefix
tree to the left, and below each branch grouped by what follows to the right.
A group is a class of places around one run; two of its places in different
branches first meet there.  Classes are what leaves a task: a small one as its
pairs, a larger one as its members, which are only paired by a distributed
join where somebody asks for pairs.  How much of a record is shared needs no
pairs: each place reaches as far as its neighbours in sorted order.

A span in more than ``HOT`` places (boilerplate, ruled lines) is not gathered at
all.  A run of RUN characters that holds it begins 0 to RUN - GRAM characters
before it; for each of these beginnings a place has a 128-bit hash of its run,
and places are grouped by that in compiled code with partial aggregation.  Equal
texts are reduced to one representative beforehand and come back at the end.

The pairs themselves are as many as there are: a paragraph in a million posts
makes 5 x 10^11 of them, whether the posts are equal or not.  ``pairs`` is asked
for them all; ``report`` and ``stretches`` stay linear.

Defined results: NULL texts and texts below RUN characters have no runs; equal
texts of RUN or more characters form pairs; characters are code points, nothing
is normalised; very long texts are cut in overlapping pieces without loss.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.lanes import runs, whole_groups
from tracelode.llm.distinct import _mix
from tracelode.operators.intervals import merge_lists
from tracelode.session import cut, parallelism, small

RUN, GRAM = 150, 64
WINDOW = RUN - GRAM + 1
_LEFT = RUN - GRAM + 1  # one more than a run needs: tells whether an earlier span exists
_PIECE = 4_000_000
#: Places of one span that a single task may gather.
HOT = 20_000
_POS_BITS = 24
_MASK = np.uint64((1 << _POS_BITS) - 1)


def _gram_hash(x: np.ndarray) -> np.ndarray:
    """Hash of the GRAM characters from each position on (GRAM is a power of two)."""
    h, width, base = _mix(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, np.uint64(0xD1342543DE82EF95)
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * base + h[width:]
            width, base = width * 2, base * base
    return _mix(h)


def _window_min(k: np.ndarray) -> np.ndarray:
    width = 1
    while width * 2 <= WINDOW:
        k = np.minimum(k[:-width], k[width:])
        width *= 2
    rest = WINDOW - width
    return np.minimum(k[:-rest], k[rest:]) if rest else k


def kept_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the kept spans of several texts of RUN or more characters."""
    sizes = np.array([len(t) for t in texts])
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _gram_hash(x)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(h), dtype=np.uint64)
    key = (h & ~_MASK) | (_MASK - (place & _MASK))
    least = _window_min(key)
    last = begin[1:] - RUN  # the last window of each text
    ok = np.zeros(len(least) + 1, np.int64)
    np.add.at(ok, begin[:-1], 1)
    np.add.at(ok, last + 1, -1)
    inside = np.cumsum(ok[:-1]) > 0
    pos = np.unique((_MASK - (least[inside] & _MASK)).astype(np.int64))
    owner = np.searchsorted(begin, pos, "right") - 1
    return owner, pos - begin[owner], h[pos].view(np.int64)


_SPAN = "fp bigint, doc_id bigint, pos bigint"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(ids: list[int], offsets: list[int], texts: list[str]) -> pa.RecordBatch:
        owner, pos, h = kept_spans(texts)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.array(ids)[owner]), pa.array(np.array(offsets)[owner] + pos)], names=["fp", "doc_id", "pos"])

    ids, offsets, texts, n = [], [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for a in range(0, max(len(t) - RUN + 1, 1), _PIECE):
                piece = t[a : a + _PIECE + RUN - 1]
                ids.append(i)
                offsets.append(a)
                texts.append(piece)
                n += len(piece)
                if n >= 1_000_000:
                    yield work(ids, offsets, texts)
                    ids, offsets, texts, n = [], [], [], 0
    if texts:
        yield work(ids, offsets, texts)


_AROUND = "fp bigint, doc_id bigint, pos bigint, before string, after string, hot boolean"


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared spans with their surroundings; ``before`` runs backwards from the span."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc, text, spans in zip(*(c.to_pylist() for c in b.columns)):
            for s in spans:
                p = s["pos"]
                for c, v in zip(out, (s["fp"], doc, p, text[max(0, p - _LEFT) : p][::-1], text[p : p + RUN], s["hot"])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))], names=["fp", "doc_id", "pos", "before", "after", "hot"])


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


Row = tuple[int, int, str, str]  # doc, pos, before, after
#: Members up to which a class leaves its task as pairs.
FEW = 8


def _branches(rows: list[Row]) -> Iterator[tuple[int, list[Row], list[list[Row]]]]:
    """The prefix tree to the left of the places of one span: (characters agreed, places, their branches)."""
    todo = [sorted(rows, key=lambda r: r[2])]
    while todo:
        part = todo.pop()
        if len(part) < 2 or all(r[0] == part[0][0] for r in part):
            continue
        left = _common(part[0][2], part[-1][2])  # sorted: what the ends share, all share
        kids: list[list[Row]] = []
        if left < _LEFT:
            by: dict[str, list[Row]] = defaultdict(list)
            for r in part:
                if len(r[2]) == left:
                    kids.append([r])
                else:
                    by[r[2][left]].append(r)
            kids += by.values()
            todo += [k for k in by.values() if len(k) > 1]
        yield left, part, kids


def classes(rows: list[Row]) -> list[list[tuple[int, int]]]:
    """Classes of (branch, doc) among the places of one span; members of different branches and docs have a run."""
    out = []
    for left, _, kids in _branches(rows):
        need = max(GRAM, RUN - left)
        groups: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, kid in enumerate(kids):
            for r in kid:
                if len(r[3]) >= need:
                    groups[r[3][:need]].append((k, r[0]))
        for g in groups.values():
            g = list(dict.fromkeys(g))
            if any(x[0] != g[0][0] for x in g) and any(x[1] != g[0][1] for x in g):
                out.append(g)
    return out


def stretches(rows: list[Row]) -> list[tuple[int, int, int]]:
    """(doc, start, end) of what the places of one span share with other texts."""
    out = []
    for left, part, _ in _branches(rows):
        # how far each text is shared with some other one that agrees ``left`` to the left
        order = sorted(part, key=lambda r: r[3])
        reach = [0] * len(order)
        for step in (1, -1):
            seq = range(len(order)) if step == 1 else range(len(order) - 1, -1, -1)
            prev: tuple[int, int] | None = None  # index, and reach to the last row of another text
            for i in seq:
                if prev is not None:
                    j, known = prev
                    c = _common(order[i][3], order[i - step][3])
                    if order[i - step][0] != order[i][0]:
                        prev = (i - step, c)
                    else:
                        prev = (j, min(known, c))
                    reach[i] = max(reach[i], prev[1] if order[prev[0]][0] != order[i][0] else 0)
                else:
                    prev = (i, 0)
        for r, right in zip(order, reach):
            if right >= GRAM and left + right >= RUN:
                out.append((r[0], r[1] - left, r[1] + right))
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, list[Row]]]]:
    """Places in runs of one span."""
    for t in whole_groups(batches, ["fp"], 20_000):
        fp = t.column("fp").to_numpy()
        cols = [t.column(c).to_pylist() for c in ("doc_id", "pos", "before", "after")]
        first = runs(fp)
        yield [(int(fp[a]), list(zip(*(c[a:b] for c in cols)))) for a, b in zip(first, np.append(first[1:], len(fp)))]


_LINKS = "k1 bigint, k2 bigint, branch string, a bigint, b bigint"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of small classes, members (a) of the others."""
    seen: set[tuple[int, int]] = set()
    for groups in _groups(batches):
        out: list[tuple] = []
        for fp, rows in groups:
            for n, g in enumerate(classes(rows)):
                if len(g) > FEW:
                    out += [(fp, n, str(k), d, None) for k, d in g]
                    continue
                pairs = {(min(a, b), max(a, b)) for i, (k, a) in enumerate(g) for j, b in g[i + 1 :] if j != k and a != b} - seen
                out += [(None, None, None, a, b) for a, b in pairs]
                seen |= pairs
        if len(seen) > 2_000_000:
            seen = set()
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string() if i == 2 else pa.int64()) for i in range(5)], names=["k1", "k2", "branch", "a", "b"])


_STRETCH = "doc_id bigint, start bigint, end bigint"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for groups in _groups(batches):
        out = [s for _, rows in groups for s in stretches(rows)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["doc_id", "start", "end"])


def _hot_runs(around: DataFrame) -> DataFrame:
    """Of hot places, every run of RUN characters that holds the span and stands in another text too:
    ``k1, k2, doc_id, start, branch, branches``."""
    x = around.where("hot").withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(_LEFT - 1))))
    before, need = F.col("before"), F.lit(RUN) - F.col("l")
    x = x.where((F.length("before") >= F.col("l")) & (F.length("after") >= need))
    run = [F.substring(before, F.lit(1), F.col("l")), F.substring(F.col("after"), F.lit(1), need)]
    # what stands left of the run; a text's beginning differs from everything
    branch = F.when(F.length("before") > F.col("l"), F.substring(before, F.col("l") + 1, F.lit(1))).otherwise(F.concat_ws(":", F.lit("start"), "doc_id"))
    x = x.select(F.xxhash64("fp", "l", *run).alias("k1"), F.xxhash64(F.lit(7), "l", *reversed(run)).alias("k2"), "doc_id", (F.col("pos") - F.col("l")).alias("start"), branch.alias("branch"))
    g = x.groupBy("k1", "k2").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), (F.min("branch") != F.max("branch")).alias("branches")).where("x <> y").drop("x", "y")
    return x.join(g, ["k1", "k2"])


class CommonRuns:
    """The shared runs of ``documents(doc_id, text)``: pairs, and stretches per record."""

    def __init__(self, documents: DataFrame) -> None:
        self.documents = documents.select("doc_id", "text", F.length("text").alias("chars"))
        long = self.documents.where(F.col("chars") >= RUN)
        h = cut(long.select("doc_id", "chars", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")), "texthash")
        classes = h.groupBy("h1", "h2", "chars").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
        #: members of classes of equal texts
        self.copies = cut(h.join(small(classes), ["h1", "h2", "chars"]).select("doc_id", "rep", "chars"), "copies")
        extra = small(self.copies.where("doc_id <> rep").select("doc_id"))
        texts = long.select("doc_id", "text").join(extra, "doc_id", "left_anti")
        spans = cut(texts.mapInArrow(_spans, _SPAN), "spans")
        shared = cut(spans.groupBy("fp").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("n")).where("x <> y").select("fp", (F.col("n") > HOT).alias("hot")), "sharedspans")
        held = spans.join(small(shared), "fp").groupBy("doc_id").agg(F.collect_list(F.struct("fp", "pos", "hot")).alias("spans"))
        # where the places are few enough to be sent to the texts, no text is shuffled
        self.around = texts.join(small(cut(held, "places")), "doc_id").select("doc_id", "text", "spans").mapInArrow(_around, _AROUND)
        self.hot = bool(shared.where("hot").limit(1).count())
        if self.hot:
            self.around = cut(self.around, "around")

    def _by_span(self) -> DataFrame:
        n = parallelism(self.documents.sparkSession, 1)
        return self.around.where("not hot").select("fp", "doc_id", "pos", "before", "after").repartition(n, "fp").sortWithinPartitions("fp")

    def pairs(self) -> DataFrame:
        """``doc_id_a, doc_id_b``: every pair of records, smaller id first, with a common run."""
        c = self.copies.select("rep", "doc_id")
        links = self._by_span().mapInArrow(_links, _LINKS)
        if self.hot:
            links = links.unionByName(_hot_runs(self.around).where("branches").select("k1", "k2", "branch", F.col("doc_id").alias("a"), F.lit(None).cast("bigint").alias("b")).distinct())
        links = cut(links, "links")
        members = links.where("b is null").select("k1", "k2", "branch", "a")
        other = members.select("k1", "k2", F.col("branch").alias("other"), F.col("a").alias("b"))
        p = members.join(other, ["k1", "k2"]).where("a < b and branch <> other").select("a", "b").unionByName(links.where("b is not null").select("a", "b")).distinct()
        for side in ("a", "b"):
            m = small(c.select(F.col("rep").alias(side), F.col("doc_id").alias("m")))
            p = p.join(m, side, "left").withColumn(side, F.coalesce("m", side)).drop("m")
        p = p.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
        x, y = c.select("rep", F.col("doc_id").alias("doc_id_a")), c.select("rep", F.col("doc_id").alias("doc_id_b"))
        return p.unionByName(x.join(y, "rep").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b"))

    def stretches(self) -> DataFrame:
        """``doc_id, start, end``: the maximal stretches of a record that lie in shared runs."""
        s = self._by_span().mapInArrow(_stretches, _STRETCH)
        if self.hot:
            s = s.unionByName(_hot_runs(self.around).select("doc_id", "start", (F.col("start") + RUN).alias("end")))
        whole = self.copies.select("doc_id", F.lit(0).cast("bigint").alias("start"), F.col("chars").cast("bigint").alias("end"))
        n = parallelism(self.documents.sparkSession, 1)
        return s.distinct().unionByName(whole).repartition(n, "doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(_union, _STRETCH)

    def report(self) -> DataFrame:
        """``doc_id, chars, stretches, shared_chars, shared``: how much of each record is shared elsewhere."""
        s = self.stretches().groupBy("doc_id").agg(F.count("*").alias("stretches"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
        r = self.documents.select("doc_id", F.coalesce("chars", F.lit(0)).cast("bigint").alias("chars")).join(s, "doc_id", "left")
        r = r.withColumns({"stretches": F.coalesce("stretches", F.lit(0)), "shared_chars": F.coalesce("shared_chars", F.lit(0))})
        return r.withColumn("shared", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0))


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, ["doc_id"]):
        doc, start, end = (t.column(c).to_numpy() for c in ("doc_id", "start", "end"))
        d, s, e = merge_lists(doc, start, end - 1)  # closed bounds there, half-open ones here
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e + 1)], names=["doc_id", "start", "end"])


# ---- the sliding-sentence method -------------------------------------------------------------------
_END = re.compile(r"[^.!?。！？\n]*(?:[.!?。！？]+[\"'»”)\]]*\s*|\n+|$)", re.S)
SENTENCES = 3


def sentences(text: str) -> list[tuple[int, int]]:
    """Where sentences lie; ends marks, line breaks and the text's end close one."""
    return [m.span() for m in _END.finditer(text) if m.end() > m.start()]


def _sentence_spans(n: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = sentences(text)
                for i in range(len(at) - n + 1):
                    j = i + n - 1
                    while j < len(at) - 1 and at[j][1] - at[i][0] < least:
                        j += 1
                    a, e = at[i][0], at[j][1]
                    body = text[a:e].strip()
                    if len(body) < least:
                        continue
                    h = xxhash.xxh3_128_intdigest(body.encode("utf-8", "surrogatepass"))
                    for c, v in zip(out, ((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, doc, a, a + len(text[a:e].rstrip()))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["h1", "h2", "doc_id", "start", "end"])

    return run


def sentence_spans(documents: DataFrame, n: int = SENTENCES, least: int = RUN) -> DataFrame:
    """``doc_id, start, end, first``: runs of ``n`` or more consecutive sentences
    (``least`` characters at least) that stand in more than one record; ``first``
    marks the occurrence that stays when repeats are removed."""
    s = documents.where(F.length("text") >= least).select("doc_id", "text").mapInArrow(_sentence_spans(n, least), "h1 bigint, h2 bigint, doc_id bigint, start bigint, end bigint")
    s = cut(s, "sentences")
    again = s.groupBy("h1", "h2").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.min(F.struct("doc_id", "start")).alias("f")).where("x <> y").select("h1", "h2", "f")
    return s.join(small(again), ["h1", "h2"]).select("doc_id", "start", "end", ((F.col("f.doc_id") == F.col("doc_id")) & (F.col("f.start") == F.col("start"))).alias("first"))


def sentence_report(documents: DataFrame, n: int = SENTENCES, least: int = RUN) -> DataFrame:
    """``doc_id, shared_chars, removable_chars`` by the sliding-sentence method."""
    sp = cut(sentence_spans(documents, n, least), "sentencespans")
    k = parallelism(documents.sparkSession, 1)

    def total(x: DataFrame, name: str) -> DataFrame:
        u = x.select("doc_id", "start", "end").repartition(k, "doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(_union, _STRETCH)
        return u.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias(name))

    r = documents.select("doc_id").join(total(sp, "shared_chars"), "doc_id", "left").join(total(sp.where("not first"), "removable_chars"), "doc_id", "left")
    return r.select("doc_id", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("removable_chars", F.lit(0)).alias("removable_chars"))
