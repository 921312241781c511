"""Bin packing against the plain algorithm, and the laws of the shards."""

import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tidestep.llm.queries import queries
from tidestep.llm.sharding import BinTree, best_fit_decreasing, equal_shards, shard_documents


def plain(sizes, capacity):
    """Best fit, group by group: the bin of each, ties to the first bin."""
    left, out = [], []
    for s in sorted(sizes, reverse=True):
        fit = [(r, b) for b, r in enumerate(left) if r >= s]
        if not fit:
            left.append(max(capacity, s))
            fit = [(left[-1], len(left) - 1)]
        r, b = min(fit)
        left[b] -= s
        out.append((s, b))
    return out, left


def unrolled(intervals, classes):
    sizes = [s for s, c in classes for _ in range(c)]
    out, bins = [], dict(intervals)
    for i, s in enumerate(sizes):
        at = max(k for k in bins if k <= i)
        out.append((s, bins[at]))
    return out


@given(st.lists(st.integers(1, 30), max_size=60), st.integers(10, 60))
@settings(max_examples=200, deadline=None)
def test_classes_pack_as_single_groups(sizes, capacity):
    classes = sorted(Counter(sizes).items(), reverse=True)
    intervals, bins = best_fit_decreasing(classes, capacity)
    want, left = plain(sizes, capacity)
    got = unrolled(intervals, classes)
    assert Counter(got) == Counter(want) and bins == len(left)
    load = defaultdict(int)
    for s, b in got:
        load[b] += s
    assert all(v <= max(capacity, max(sizes)) for v in load.values())


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), unique=True, max_size=40), st.lists(st.integers(0, 55), max_size=20))
@settings(max_examples=100, deadline=None)
def test_tree_takes_the_tightest(bins, asked):
    tree, held = BinTree(), set(bins)
    for r, b in bins:
        tree.insert(r, b)
    for size in asked:
        want = min((x for x in held if x[0] >= size), default=None)
        assert tree.take(size) == want
        held.discard(want)


def test_equal_shards_with_a_giant():
    classes = [(1000, 1), (10, 50), (1, 100)]
    got = unrolled(equal_shards(classes, 4), classes)
    load = defaultdict(int)
    for s, b in got:
        load[b] += s
    assert load.pop(got[0][1]) == 1000 and max(load.values()) - min(load.values()) <= 1 and len(load) == 3
    assert equal_shards([], 16) == []


def test_query_keeps_the_law(spark, sf, doc_rows):
    got = queries()["op7_sharding"](spark, sf).collect()
    texts = dict(doc_rows)
    assert len(got) == len(texts)
    shard_of, load, slots = {}, defaultdict(int), defaultdict(list)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert shard_of.setdefault(texts[r.doc_id], r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) == set(range(16))
    largest = max(sum(len(t.encode()) + 1 for t in texts.values() if t == u) for u in set(texts.values()))
    assert max(load.values()) - min(load.values()) <= largest


def test_odd_rows_and_fixed_capacity(odd, odd_rows, none):
    got = shard_documents(odd, 3).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t.encode()) + 1) for i, t in odd_rows)
    fixed = shard_documents(odd, None, capacity=300_000).collect()
    load = defaultdict(int)
    for r in fixed:
        load[r.shard] += r.size
    assert len(load) == len(plain([n for n in _groups(odd_rows)], 300_000)[1])
    slots = defaultdict(list)
    for r in fixed:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(none, 16).count() == 0


def _groups(rows):
    held = defaultdict(int)
    for _, t in rows:
        held[t] += len(t.encode()) + 1
    return held.values()


def test_a_third_of_the_rows_is_one_text(spark):
    frame = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same' ELSE concat('text ', id) END AS text").repartition(8)
    got = shard_documents(frame, 16).cache()
    assert got.count() == got.select("doc_id").distinct().count() == 30_000
    same = got.join(frame.filter("doc_id % 3 = 0"), "doc_id").select("shard").distinct().count()
    slots = got.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert same == 1 and all(r["max(slot)"] + 1 == r["count(1)"] for r in slots)
    assert got.select("shard", "slot").distinct().count() == 30_000
    fixed = shard_documents(frame, None, capacity=1_000)
    assert fixed.count() == 30_000 and fixed.select("shard", "slot").distinct().count() == 30_000
