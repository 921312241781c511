"""Hard negatives against brute force, and what the tree's ranges eliminate."""

import math

import duckdb
import numpy as np
import pytest

from tidestep.llm.negatives import Search, Tree, hard_negatives, relabelled, whole
from tidestep.llm.queries import oracle_sql, queries

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(values, divisor=100):
    rows = {}
    for i, v, label in values:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        rows.setdefault(i, []).append((label, [math.floor(256 * float(np.float32(x))) for x in v]))
    every = [(i, label, v) for i, own in rows.items() for label, v in own]
    out = []
    for a in sorted(rows):
        if a % divisor:
            continue
        label, own = min(rows[a], key=lambda r: (r[1], r[0]))
        scored = sorted((-sum(x * y for x, y in zip(own, v, strict=False)), i, lab) for i, lab, v in every if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            hard = [(s, i) for s, i, lab in scored if lab != label and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i) in enumerate(hard)]
    return out


def mined(frame, divisor=100):
    return sorted(tuple(r[c] for c in COLUMNS) for r in hard_negatives(relabelled(frame), anchor_divisor=divisor).collect())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query_against_sql_and_brute_force(spark, size):
    d = f"/root/testdata/{size}"
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries()["op13_hard_negatives"](spark, d).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert got == sorted(c.sql(f"SELECT {', '.join(COLUMNS)} FROM ({oracle_sql()['op13_hard_negatives']})").fetchall())
    if size == "sf0.001":
        assert got == sorted(brute([(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]))


def test_groups_of_copies_and_odd_rows(spark):
    """A third of the rows are one vector under several labels; nulls, repeated ids, short and empty vectors."""
    rng = np.random.default_rng(4)
    common = (0.3 * rng.standard_normal(8)).tolist()
    values = [(i, common if i % 3 == 0 else (0.3 * rng.standard_normal(8)).tolist(), int(rng.integers(0, 4))) for i in range(900)]
    nan = float("nan")
    values += [(900, None, 1), (901, [nan] * 8, 1), (902, [None, 1.0], 1), (None, common, 1), (903, common, None), (100, common, 2), (200, [0.5], 3), (904, [], 1), (905, [0.9, 0.1], 3)]
    frame = spark.createDataFrame(values, SCHEMA)
    assert mined(frame) == sorted(brute(values))
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 1)], SCHEMA)) == []


def test_large_components_stay_exact(spark):
    values = [(i, [float(i) * 1e5, 3e5 + i, -1e5], i % 2) for i in range(0, 60, 2)] + [(i, [float(i) * 1e5, 3e5 - i, 2.5], 1) for i in range(1, 60, 2)]
    assert mined(spark.createDataFrame(values, SCHEMA), 10) == sorted(brute(values, 10))


def test_ranges_eliminate_cells_of_structured_vectors():
    """Groups far apart: a search visits a small part of the rows, and finds what a scan finds."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 16))
    x = whole(np.repeat(centres, 50, axis=0) + 0.02 * rng.standard_normal((3000, 16)))
    labels, ids = np.tile(np.arange(5), 600), np.arange(3000)
    tree = Tree(ids, x, labels, float((x * x).sum(axis=1).max()))
    who = np.arange(0, 3000, 100)
    for same in (True, False):
        score = (x[who] @ x.T).astype(np.int64)
        hi = np.sort(score, axis=1)[:, -2]
        lo = np.ceil(0.8 * hi).astype(np.int64)
        search, seen = Search(ids[who], x[who], labels[who], same, lo, hi, 5), 0
        offer = search.offer

        def counted(asked, own, *more):
            nonlocal seen
            seen += len(asked) * len(own)
            offer(asked, own, *more)

        search.offer = counted
        tree.walk(search, np.arange(len(who)))
        q, row, found = search.found()
        for k, w in enumerate(who):
            ok = ((labels == labels[w]) == same) & (ids != w) & (score[k] >= lo[k]) & (score[k] <= hi[k])
            want = sorted((-s, i) for s, i in zip(score[k][ok], ids[ok], strict=True))[:5]
            assert [(-s, i) for s, i in zip(found[q == k], row[q == k], strict=True)] == want
        assert seen < len(who) * 3000 / 4
