"""Prefix scans, as-of joins, interval search, delta loops, measured loops, overlays and exchange: against plain Python, and their spread and plans."""

import json
import random
from enum import Enum

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidestep.operators import registry
from tidestep.operators.overlay import folded
from tidestep.operators.reduce import exchanged
from tidestep.operators.scan import as_of, in_intervals, prefix_scan
from tidestep.plans import conditions as when
from tidestep.plans.delta import DeltaLoop
from tidestep.plans.schedule import NotConverged, OnMax, Scheduler, loop_until
from tidestep.plans.system import System
from tidestep.plans.world import World
from tidestep.sources.config import deep_merge, leaves


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- prefix scan ---


def scanned(frame, bits=2):
    return prefix_scan(frame, "k", ["t"], count="n", sums={"s": F.col("v")}, lasts={"last": F.col("w")}, before={"prev": F.col("w")}, piece_bits=bits)


def plain(rows):
    out, state = [], {}
    for k, t, v, w in sorted(rows, key=lambda r: r[1]):
        n, s, last, prev = state.get(k, (0, None, None, None))
        n, s, last = n + 1, (s if v is None else v if s is None else s + v), w if w is not None else last
        out.append((k, t, n, s, last, prev))
        state[k] = (n, s, last, w)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_prefix_scan_against_a_walk(spark, seed):
    """Few and many keys, null keys and values; pieces of four rows cut keys anywhere."""
    rng = random.Random(seed)
    keys = [None, "a", "b", *[f"k{i}" for i in range(20 * seed)]]
    rows = [(rng.choice(keys) if rng.random() < 0.5 else "hot", t, rng.choice([None, 1, 2, -5]), rng.choice([None, None, "x", "y"])) for t in range(400)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, t int, v int, w string")
    got = scanned(frame).select("k", "t", "n", "s", "last", "prev").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_prefix_scan_of_nothing_and_of_taken_names(spark):
    assert scanned(spark.createDataFrame([], "k string, t int, v int, w string")).count() == 0
    frame = spark.createDataFrame([("a", 1, 2, "x", 0, 0, 0)], "k string, t int, v int, w string, pos int, piece int, rows int")
    assert [tuple(r) for r in scanned(frame).collect()] == [("a", 1, 2, "x", 0, 0, 0, 1, 2, "x", None)]


def test_a_key_of_all_rows_is_many_tasks(spark):
    frame = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # what is small here is large there
    try:
        result = scanned(frame, 10)
        sizes = sorted(r["count"] for r in result.groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    row = result.filter("t = 199999").first()
    assert (row.n, row.s, row["last"]) == (200_000, sum(i % 7 for i in range(200_000)), 199_000)


# --- as-of and intervals ---


def test_as_of_sees_the_last_row_before(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(60)])) for i in range(200)]
    right = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(60)])) for i in range(60)]
    a, b = spark.createDataFrame(left, "i int, k string, at int"), spark.createDataFrame(right, "j int, k string, t int")
    for by, delay in ((["k"], 0), ([], 5)):
        got = {r.i: r.seen and r.seen.j for r in as_of(a, b, "at", "t", by, F.lit(delay) if delay else None, piece_bits=3).collect()}
        for i, k, at in left:
            known = [(t, j) for j, own, t in right if t is not None and at is not None and t + delay <= at and (not by or own == k is not None)]
            want = max(known)[0] if known else None
            assert (got[i] is None) == (want is None)
            assert want is None or right[got[i]][2] == want


@pytest.mark.parametrize("most", [1 << 17, 10])
def test_intervals_by_bisection_and_in_order(spark, most):
    rng = random.Random(2)
    edges = sorted(rng.sample(range(1000), 80))
    spans = [(f"s{n}", lo, hi) for n, (lo, hi) in enumerate(zip(edges[::2], edges[1::2], strict=True))] + [("empty", 500, 500)]
    points = [(i, rng.choice([None, *range(-5, 1005)])) for i in range(500)]
    df, stages = spark.createDataFrame(points, "i int, at long"), spark.createDataFrame(spans, "name string, lo long, hi long")
    found = in_intervals(df, stages, "at", most=most)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert sorted((r.i, r.name) for r in found.collect()) == sorted((i, n) for i, p in points if p is not None for n, lo, hi in spans if lo <= p < hi)
    assert in_intervals(df, stages.limit(0), "at", most=most).count() == 0


def test_a_hundred_thousand_stages(spark):
    stages = spark.range(100_000).select((F.col("id") * 3).alias("lo"), (F.col("id") * 3 + 2).alias("hi"), F.col("id").alias("stage"))
    points = spark.range(0, 300_000, 1).select(F.col("id").alias("step"))
    found = in_intervals(points, stages, "step")
    assert "NestedLoop" not in plan(found)
    assert found.filter(F.col("step").between(F.col("lo"), F.col("hi") - 1)).count() == 200_000


# --- loops ---


def test_delta_loop_reads_what_is_open(spark):
    loop = DeltaLoop(lambda f: f.withColumn("x", F.floor(F.col("x") / 2)), F.col("x") < 1, 20)
    frame = spark.range(1, 1025).withColumn("x", F.col("id"))
    got = {r.id: (r.x, r.iterations, r.converged) for r in loop.run(frame).collect()}
    assert got == {i: (0, i.bit_length(), True) for i in range(1, 1025)}
    assert loop.extent == [1024, 1023, 1021, 1017, 1009, 993, 961, 897, 769, 513, 1]


@pytest.mark.parametrize("most", [0, 3])
def test_delta_loop_at_its_limit(spark, most):
    frame = spark.range(1, 17).withColumn("x", F.col("id"))
    halved = lambda n: DeltaLoop(lambda f: f.withColumn("x", F.floor(F.col("x") / 2)), F.col("x") < 1, most, n)
    open_ = {i for i in range(1, 17) if i.bit_length() > most}
    kept = {r.id: r for r in halved(OnMax.ACCEPT).run(frame).collect()}
    assert {i for i, r in kept.items() if not r.converged} == open_ and all(kept[i].x == i >> most for i in open_)
    back = {r.id: r for r in halved(OnMax.ROLLBACK).run(frame, ["id"]).collect()}
    assert len(back) == 16 and all(back[i].x == i for i in open_)
    with pytest.raises(NotConverged):
        halved(OnMax.RAISE).run(frame)
    with pytest.raises(ValueError):
        halved(OnMax.ROLLBACK).run(frame)
    assert halved(OnMax.ACCEPT).run(frame.limit(0)).count() == 0


def test_a_recursive_plan_is_the_same_loop(spark):
    from tidestep.plans.delta import recursive

    frame = spark.range(1, 300).select("id", F.col("id").alias("x"), F.lit("s").alias("odd name"))
    for most in (4, 20):
        loop = DeltaLoop(lambda f: f.withColumn("x", F.floor(F.col("x") / 2)), F.col("x") < 1, most)
        assert sorted(map(tuple, recursive(frame, {"x": "floor(x / 2)"}, "x < 1", most).collect())) == sorted(map(tuple, loop.run(frame).collect()))


class Step(Enum):
    A = 0


def test_a_measured_round_is_one_job(spark):
    w = World(spark).put("frame", spark.range(1000).withColumn("x", F.col("id") + 1.0))
    s = Scheduler(w).add(System("halve", lambda frame: frame.withColumn("x", F.col("x") / 2), Step.A, ("frame",), (), ("frame",)))
    loop = loop_until(Step.A, when.measured("frame", lambda seen: seen["most"] < 1, most=F.max("x")), 20)
    s.set_schedule(loop)
    s.organise()
    spark.sparkContext.setJobGroup("measured", "rounds")
    try:
        s.run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert s.iterations[id(loop)] == 10
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("measured")) == 10
    assert w.get("frame").agg(F.max("x")).first()[0] == 1000 / 2**10


# --- overlays ---

NAMES = st.sampled_from(["a", "b", "c"])
TREES = st.recursive(st.integers(0, 9), lambda inner: st.dictionaries(NAMES, inner, min_size=1, max_size=3), max_leaves=6)
DOCS = st.lists(st.dictionaries(NAMES, TREES, min_size=1, max_size=3), min_size=1, max_size=5)


@settings(max_examples=8, deadline=None)
@given(st.lists(DOCS, min_size=1, max_size=4))
def test_folding_is_merging_one_after_another(spark, owners):
    rows = [(k, n, json.dumps(doc)) for k, docs in enumerate(owners) for n, doc in enumerate(docs)]
    got = {}
    for r in folded(spark.createDataFrame(rows, "k int, n int, doc string"), "k", ["n"], "doc").collect():
        got.setdefault(r.k, {})[r.path] = json.loads(r.value)
    for k, docs in enumerate(owners):
        merged = {}
        for doc in docs:
            merged = deep_merge(merged, doc)
        assert got.get(k, {}) == leaves(merged)


def test_tombstones_and_texts_that_say_nothing(spark):
    rows = [
        (1, 1, '{"a": {"b": 1, "c": [1, {"x": null}]}, "d": "s"}'), (1, 2, '{"a": {"b": null}}'), (1, 3, '{"d": {"e": null}}'), (1, 4, "not json"), (1, 5, None), (1, 6, "3"), (1, 7, '{"a": {}}'),
        (2, 1, '{"a": {"b": 1}}'), (2, 2, '{"a": null}'), (2, 3, '{"a": {"z": true}}'), (None, 1, '{"a": 1}'), (3, 1, '{"a.b": 1}'),
    ]
    got = {(r.k, r.path): r.value for r in folded(spark.createDataFrame(rows, "k int, n int, doc string"), "k", ["n"], "doc").collect()}
    assert got == {(1, "a.c"): '[1,{"x":null}]', (1, "d"): '"s"', (2, "a.z"): "true", (3, "a.b"): "1"}
    deep = [(1, 1, '{"a":' * 40 + "1" + "}" * 40)]
    with pytest.raises(ValueError):
        folded(spark.createDataFrame(deep, "k int, n int, doc string"), "k", ["n"], "doc")


def test_numbers_keep_their_fraction(spark):
    rows = [(1, 1, '{"a": 2.0, "b": {"c": 10.50, "d": -0.0, "e": 0.0, "h": 1.00000000000000000001}, "f": [3.0, "x 1.0", "\\\\" , {"y": 4.10}], "g": "7.0"}'), (2, 1, '{"a": 2.5}'), (2, 2, '{"a": 120}'), (3, 1, '{"it\'s [0]": 1234567890123456}')]
    got = {(r.k, r.path): r.value for r in folded(spark.createDataFrame(rows, "k int, n int, doc string"), "k", ["n"], "doc").collect()}
    own = {"a": "2.0", "b.c": "10.5", "b.d": "-0.0", "b.e": "0.0", "b.h": "1.00000000000000000001", "f": '[3.0,"x 1.0","\\\\",{"y":4.1}]', "g": '"7.0"'}
    assert got == {(1, p): v for p, v in own.items()} | {(2, "a"): "120", (3, "it's [0]"): "1234567890123456"}


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(NAMES, TREES, max_size=3), st.dictionaries(NAMES, TREES, max_size=3))
def test_overlaid_paths_are_the_merged_tree(spark, base, over):
    frame = lambda tree: spark.createDataFrame([(p, str(v)) for p, v in leaves(tree).items()], "path string, v string")
    got = {r.path: r.v for r in registry.overlaid(frame(base), frame(over)).collect()}
    assert got == {p: str(v) for p, v in leaves(deep_merge(base, over)).items()}


# --- exchange ---


def test_exchange_with_disabled_halves_and_unequal_lengths(spark):
    edges = [
        (0, 0, 1, -1, [1.0, 2.0, 3.0], 5),  # sends only
        (1, 0, 2, 0, [4.0], 2),  # receives two of three
        (2, 0, -1, 1, [9.0], 4),  # receives one number, though it has room for four
        (3, 1, 3, 3, [7.0, 8.0], 1),  # itself
        (4, 0, 5, 5, [1.0], 3),  # its partner sends on another slot
        (5, 9, 4, -1, [2.0], 0),
        (6, 0, -1, 7, None, 2),
        (7, 0, 6, -1, None, 2),  # nothing sent
        (8, 0, 9, -1, [], 2),
        (9, 0, -1, 8, [1.0], None),  # no room
        (None, 0, 1, 1, [1.0], 1),
    ]
    df = spark.createDataFrame(edges, "rank int, slot int, to_rank int, from_rank int, sent array<double>, room int")
    result = exchanged(df, "sent", "room")
    assert {r["rank"]: r.received for r in result.collect()} == {1: [1.0, 2.0], 2: [4.0], 3: [7.0], 4: None, 6: None, 9: None}


def test_exchange_is_one_scan_and_one_shuffle(spark, sf):
    from tidestep import queries as engine

    p = plan(engine.QUERIES["edge_exchange"](spark, sf))
    assert p.count("FileScan") == 1 and p.count("Exchange hashpartitioning") == 1


def test_staged_queries_have_no_nested_loop(spark, sf):
    from tidestep import queries as engine

    for name in ("run_stages", "in_stage", "stages_of_orders"):
        assert "NestedLoop" not in plan(engine.QUERIES[name](spark, sf))


# --- topology, arrays of texts ---


def test_levels_of_a_graph_and_a_cycle(spark):
    from tidestep.operators.topology import Cycle, levels

    nodes = spark.createDataFrame([(i,) for i in range(7)], "n int")
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (0, 2), (3, 2), (2, 4), (9, 5), (5, 9), (None, 6)], "before int, after int")
    assert {r.n: r.level for r in levels(nodes, edges, "n").collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 3, 5: 0, 6: 0}
    assert levels(nodes.limit(0), edges, "n").count() == 0
    with pytest.raises(Cycle):
        levels(nodes, spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "before int, after int"), "n")


def test_arrays_of_tables_in_texts(spark):
    from tidestep.sources.config import parsed_arrays

    texts = spark.createDataFrame([(1, "[[f]]\nx = 2\n[[f]]\ny = 's'\n"), (2, None), (3, "z = 1")], "k int, t string")
    assert [tuple(r) for r in parsed_arrays(texts, "k", "t", "f", "x long, y string").orderBy("i").collect()] == [(1, 0, 2, None), (1, 1, None, "s")]


def test_timing_table_weighs_every_line(spark, sf):
    from tidestep import queries as engine

    told = engine.QUERIES["timing_table"](spark, sf).collect()
    assert sum(r.t for r in told) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert abs(sum(r.pct for r in told) - 1) < 1e-9


@pytest.mark.parametrize("bits", [2, 17])
def test_levels_of_a_long_path_are_few_rounds(spark, bits):
    """Two thousand levels within one block are one round; in small blocks a random graph has the same levels."""
    from tidestep.operators.topology import levels

    n = 2000 if bits == 17 else 30
    draw = random.Random(bits)
    edges = {(i, i + 1) for i in range(n - 1)} if bits == 17 else {tuple(sorted(draw.sample(range(n), 2))) for _ in range(60)}
    want = [0] * n
    for a, b in sorted(edges):
        want[b] = max(want[b], want[a] + 1)
    spark.sparkContext.setJobGroup(f"levels{bits}", "")
    nodes = spark.range(n).withColumn("near", (F.col("id") / 1000).cast("int") * 0)
    got = {r.id: r.level for r in levels(nodes, spark.createDataFrame(sorted(edges), "before long, after long"), "id", near="near", block_bits=bits).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"levels{bits}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict(enumerate(want))
    assert bits != 17 or jobs < 200
    assert {r.n: r.level for r in levels(spark.createDataFrame([(None,), (1,), (2,)], "n int"), spark.createDataFrame([(1, 2), (None, 1)], "before int, after int"), "n").collect()} == {None: 0, 1: 0, 2: 1}


def test_stages_are_dealt_by_their_number(spark, sf, monkeypatch):
    """stage_overrides: a task takes so many lines, though a few bytes are shuffled for each; the rows stay."""
    from tidestep import queries as module

    run = module.QUERIES["stage_overrides"]
    want = sorted(map(tuple, run(spark, sf).collect()))
    monkeypatch.setattr(module, "STAGES_A_TASK", 1000, raising=False)
    got = run(spark, sf)
    assert sorted(map(tuple, got.collect())) == want
    assert got.rdd.getNumPartitions() == spark.read.parquet(f"{sf}/lineitem.parquet").count() // 1000 + 1 > 5


def test_stages_of_equal_documents_are_folded_once(spark, sf, monkeypatch):
    """stage_overrides: the run's config and three documents of stages, however many the lines."""
    from tidestep import queries as module
    from tidestep.operators import overlay

    seen, leaves_of = [], overlay.leaves_of
    monkeypatch.setattr(overlay, "leaves_of", lambda docs, *more: seen.append(docs.count()) or leaves_of(docs, *more))
    assert module.QUERIES["stage_overrides"](spark, sf).count() > 5000
    assert seen and max(seen) <= 6


def test_each_document_under_a_base_is_folded_like_its_rows(spark):
    from tidestep.operators.overlay import under_each

    base, docs = '{"a": {"b": 1, "c": [1.0]}, "d": "s"}', ['{"a": 2}', '{"a": 2}', '{ "a": 2}', '{"a": {"b": null}}', '{"d": {"e": 3.0}, "a": {"x": {}}}', "{}", "not json", "", None]
    each = folded(spark.createDataFrame([row for k, doc in enumerate(docs) for row in ((k, 0, base), (k, 1, doc))], "k int, n int, doc string"), "k", ["n"], "doc")
    rows = spark.createDataFrame(list(enumerate(docs)), "k int, doc string")
    got = rows.join(under_each(base, rows, "doc"), "doc").select("k", "path", "value")
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in each.collect() if docs[r.k] is not None)


def test_documents_are_read_once(spark):
    """Their leaves are kept, however deep the tables and however often the leaves are used; deeper ones than four are read once more for each doubling."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(k, n, json.dumps({"a": {"b": {"c": n}, f"d{n}": k}, "e": k})) for k in range(20) for n in range(5)]
    docs = lambda rows: spark.createDataFrame(rows, "k int, n int, doc string").mapInArrow(counted, "k int, n int, doc string")
    got = {(r.k, r.path): r.value for r in folded(docs(rows), "k", ["n"], "doc").collect()}
    assert got == {(k, p): v for k in range(20) for p, v in [("a.b.c", "4"), ("e", str(k))] + [(f"a.d{n}", str(k)) for n in range(5)]}
    assert read.value == len(rows)
    nested = lambda depth: '{"a":' * depth + "1" + "}" * depth
    deep = [(1, 1, nested(9)), (2, 1, nested(3)), (2, 2, '{"b":{}}')]
    assert sorted(map(tuple, folded(docs(deep), "k", ["n"], "doc").collect())) == [(k, ".".join("a" * depth), "1") for k, depth in ((1, 9), (2, 3))]
    assert read.value == len(rows) + 3 * len(deep)
