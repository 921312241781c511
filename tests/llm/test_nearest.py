"""Nearest neighbours against brute force: recall, exact scores, and what takes no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidestep.llm.nearest import TABLES, WIDTH, Tables, codes, learned, nearest
from tidestep.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def cosines(rows):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return ids, x @ x.T


def truth(rows, divisor, most):
    ids, score = cosines(rows)
    out = {}
    for i, own in zip(ids, score, strict=True):
        if i % divisor == 0:
            out[i] = sorted(((-s, j) for j, s in zip(ids, own, strict=True) if j != i))[:most]
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_and_scores(spark, size):
    d = f"/root/testdata/{size}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, got = truth(rows, 50, 5), {}
    for r in queries()["op11_nearest"](spark, d).collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    ids, score = cosines(rows)
    place = {i: k for k, i in enumerate(ids)}
    hits = 0
    for q, own in got.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[place[q], place[r.vec_id]]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & {j for _, j in want[q]})
    assert hits >= 0.95 * 5 * len(want)


def test_every_code_within_the_radius_is_found():
    """Probing tables of substrings against the distances of all codes; a third of the rows are equal."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 24))
    x[:300] = x[0]
    model = learned(x)
    tables, own = Tables(np.arange(900), x, model), codes(x[[0, 299, 300, 500]], model)
    distance = np.bitwise_count(own[:, None] ^ tables.codes[None]).sum(axis=2)
    for need in (1, 40, 300, 301, 900):
        asked, row = tables.within(own, need)
        nth = np.sort(distance, axis=1)[:, need - 1]
        assert set(zip(asked.tolist(), row.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(distance <= nth[:, None])), strict=True))
        assert len(asked) == len(set(zip(asked.tolist(), row.tolist(), strict=True)))
    assert own.shape == (4, TABLES) and own.dtype.itemsize * 8 == WIDTH


def test_structured_vectors_are_probed_sparsely():
    """Near groups far from each other: the first levels of probing are enough, and touch few rows."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((200, 32))
    x = np.repeat(centres, 10, axis=0) + 0.01 * rng.standard_normal((2000, 32))
    tables, touched = Tables(np.arange(2000), x, learned(x)), 0
    probe = tables.probed

    def counted(*a):
        nonlocal touched
        found = probe(*a)
        touched += len(found[0])
        return found

    tables.probed = counted
    asked, row = tables.within(codes(x[::100], tables.model), 10)
    assert all((row[asked == k] // 10 == 10 * k).sum() == 10 for k in range(20))
    assert touched < 20 * 2000 / 4


def test_what_takes_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    values = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0], None), (2, [1.0, 1.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
        (7, [None, 1.0], 1), (8, [], 1), (None, [1.0, 0.0], 1), (9, [3.0], 1), (50, [0.0, 1.0, 0.0], 1), (50, [5.0, 1.0], 1), (12, [2.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(values, SCHEMA).withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    got = [tuple(r) for r in nearest(frame).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 9), (0, 3, 12), (0, 4, 50), (0, 5, 2)]
    assert [g[:3] for g in got if g[0] == 50] == [(50, 1, 2), (50, 2, 0), (50, 3, 1), (50, 4, 9), (50, 5, 12)]
    few = spark.createDataFrame(values[:3], SCHEMA)
    assert [tuple(r)[:3] for r in nearest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    huge = spark.createDataFrame([(0, [1e30, 1e-30], 1), (1, [1e-30, 0.0], 1), (2, [-1e38, 1e38], 1)], SCHEMA)
    assert [(r.vec_id, round(r.score, 6)) for r in nearest(huge).orderBy("rank").collect()] == [(1, 1.0), (2, round(-(0.5**0.5), 6))]
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_vectors_tie_by_id(spark):
    """A third of all rows are one vector: they spread over the blocks, and ties go by id."""
    rng = np.random.default_rng(3)
    common = rng.standard_normal(16)
    values = [(i, (common if i % 3 == 0 else rng.standard_normal(16)).tolist(), 1) for i in range(1500)]
    got = nearest(spark.createDataFrame(values, SCHEMA), divisor=300).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 300] == [0, 3, 6, 9, 12]
    assert [r.vec_id for r in got if r.query_id == 0] == [3, 6, 9, 12, 15]
