"""Fingerprints: the contract's columns by brute force, and likeness against the generalised Jaccard similarity."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidestep.llm.fingerprints import edited_likeness, fingerprints, likeness
from tidestep.llm.queries import queries


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + n[:half], n


def test_query_edits_and_likeness(spark, sf, doc_rows):
    got = {r.doc_id: r for r in queries()["op3_fingerprints"](spark, sf).collect()}
    assert len(got) == len(doc_rows)
    by_text = {}
    for i, t, e, n in edits(doc_rows):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == n:
            assert r.near_next == 1
    assert sum(r.near_edited for r in got.values()) > 1.5 * sum(r.near_next for r in got.values())
    errors = [(abs(got[i].near_edited - jaccard(t, e)), abs(got[i].near_next - jaccard(t, n))) for i, t, e, n in edits(doc_rows)]
    for own in zip(*errors, strict=True):
        assert sum(own) / len(own) < 0.05 and max(own) < 0.25


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def test_collisions_estimate_generalised_jaccard(spark):
    base = " ".join(f"w{i}" for i in range(60)) + " the" * 20
    pairs = [(base, base), (base, base.replace("w1", "v1")), (base, base + " the" * 30), (base, " ".join(f"x{i}" for i in range(60)))]
    rows = [(k, t) for k, p in enumerate(pairs) for t in p]
    n = 128
    frame = spark.createDataFrame([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    got = {r.doc_id: r.signature for r in fingerprints(frame, n).collect()}
    assert len(got) == len(rows)
    for k, (a, b) in enumerate(pairs):
        share = sum(x == y for x, y in zip(got[2 * k], got[2 * k + 1], strict=True)) / n
        assert share == pytest.approx(jaccard(a, b), abs=0.14)


def test_error_of_the_likeness_at_the_production_size(spark):
    pairs = [(" ".join(f"{k}w{i}" for i in range(60)) + " the" * (k % 5), " ".join(f"{k}{'w' if i % 5 else 'v'}{i}" for i in range(60)) + " the" * (k % 3)) for k in range(60)]
    frame = spark.createDataFrame([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    got = {r.doc_id: r.signature for r in fingerprints(frame).collect()}
    errors = [sum(x == y for x, y in zip(got[2 * k], got[2 * k + 1], strict=True)) / len(got[2 * k]) - jaccard(*p) for k, p in enumerate(pairs)]
    assert abs(sum(errors)) / 60 < 0.03 and (sum(e * e for e in errors) / 60) ** 0.5 < 0.08


def test_odd_rows(odd, odd_rows):
    got = edited_likeness(odd).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edits(odd_rows))
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {""}


def test_empty_table(none):
    assert edited_likeness(none).count() == 0 and fingerprints(none).count() == 0


def test_texts_without_words_are_alike(spark):
    f = spark.range(1).select(F.lit(None).cast("array<long>").alias("a"), F.array(F.lit(1)).cast("array<long>").alias("b"))
    assert tuple(f.select(likeness(F.col("a"), F.col("a"), 1), likeness(F.col("a"), F.col("b"), 1), likeness(F.col("b"), F.col("b"), 1)).first()) == (1.0, 0.0, 1.0)


def test_main_path_is_native(spark, sf):
    plan = queries()["op3_fingerprints"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ranges(spark):
    from tidestep.llm.fingerprints import range_of

    cuts = [3 * i for i in range(200)]
    got = spark.range(-5, 700).select("id", range_of(F.col("id"), cuts).alias("r"), range_of(F.col("id"), []).alias("none")).collect()
    assert all(r.r == sum(c <= r.id for c in cuts) and r.none == 0 for r in got)


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_keys_hash_apart(spark, parts):
    from tidestep.llm.fingerprints import keys_apart

    keys = keys_apart(spark, parts)
    frame = spark.createDataFrame([(k,) for k in keys], "k int").repartition(parts, "k").select("k", F.spark_partition_id().alias("p"))
    assert {r.k: r.p for r in frame.collect()} == {k: p for p, k in enumerate(keys)}
