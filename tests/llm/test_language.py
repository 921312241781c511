"""Language ID on held-out documents, mixtures and odd rows."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidestep.llm import language_id as module
from tidestep.llm.language_id import HASH_BITS, UNKNOWN, Model, fold, identify, kept_by_language, pieces, thresholds, train, trigrams
from tidestep.llm.queries import queries


def test_held_out_accuracy(spark, sf, docs):
    got = queries()["op4_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_mixtures_have_a_leader(docs):
    model = train(docs)
    texts = {r.lang: r.text for r in docs.filter("length(text) between 2000 and 6000").collect() if r.lang in ("en", "de")}
    best, score = model.predict([texts["en"][:2000], texts["en"][:1800] + " " + texts["de"][:700]])
    assert [model.languages[i] for i in best] == ["en", "en"] and score[0] > 0.95 and 0.5 < score[1] < 0.9


def test_odd_rows(docs, odd, odd_rows):
    got = identify(odd, train(docs)).collect()
    assert len(got) == len(odd_rows)
    letters = {i: bool(re.search(r"[^\W\d_]", t)) for i, t in odd_rows}
    assert all((r.lang_pred == UNKNOWN) == (not letters[r.doc_id]) and 0 <= r.score <= 1 for r in got)


def test_nothing_learned(docs, odd, none):
    model = train(none)
    assert model.languages == () and {r.lang_pred for r in identify(odd, model).collect()} == {UNKNOWN}
    assert identify(none, train(docs)).count() == 0 and isinstance(model, Model)


def test_filter_keeps_columns_and_clean_rows(docs, odd):
    kept = kept_by_language(odd, train(docs), 0.3)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 4 in ids and not {1, 2, 3, 8} & set(ids)


def plain_mixture(model, text):
    """(language, proportion) by expectation-maximisation word by word, over each of the leading sets, with the penalty for its size."""
    bucket, begins, _ = trigrams([text])
    words = [bucket[a:b] for a, b in itertools.pairwise([*begins, len(bucket)])]
    like = []
    for w in words:
        logs = [sum(float(model.log_p[g][k]) for g in w) for k in range(len(model.languages))]
        like.append([math.exp(x - max(logs)) for x in logs])

    def rounds(pi, n):
        for _ in range(n):
            parts = [[p * x / sum(q * y for q, y in zip(pi, own, strict=True)) for p, x in zip(pi, own, strict=True)] for own in like]
            pi = [sum(c) / len(like) for c in zip(*parts, strict=True)]
        return pi

    m = len(model.languages)
    pi, best = rounds([1 / m] * m, 8), None
    for k in range(1, m + 1):
        chosen = sorted(range(m), key=lambda i: (-pi[i], i))[:k]
        own = [(pi[i] + 1e-9) if i in chosen else 0.0 for i in range(m)]
        own = [x / sum(own) for x in own]
        own = rounds(own, 2) if k > 1 else own
        value = sum(math.log(sum(p * x for p, x in zip(own, w, strict=True)) + 1e-30) for w in like) - (k - 1) * math.log1p(len(like))
        if best is None or value > best[0]:
            best = value, own
    lead = max(range(m), key=lambda i: (best[1][i], -i))
    return lead, best[1][lead]


def test_predictions_against_plain_mixtures(docs):
    model, rng = train(docs), random.Random(1)
    texts = [r.text[:600] for r in docs.filter("length(text) > 600").limit(24).collect()]
    texts += [" ".join(rng.sample(texts[i].split(), 20) + rng.sample(texts[-i - 1].split(), 12)) for i in range(10)]
    best, score = model.predict(texts)
    for t, b, s in zip(texts, best, score, strict=True):
        lead, share = plain_mixture(model, t)
        assert b == lead and s == pytest.approx(share, abs=0.02)


def test_long_texts_are_read_in_pieces(docs, monkeypatch):
    model = train(docs)
    text = " ".join(r.text for r in docs.filter("length(text) > 600").limit(30).collect())
    whole = model.predict([text])
    monkeypatch.setattr(module, "CHUNK_BYTES", 500)
    assert "".join(pieces(text)) == text and all(len(p) <= 500 for p in pieces("x" * 1200 + text))
    parts = model.predict([text])
    assert whole[0] == parts[0] and whole[1] == pytest.approx(parts[1], abs=1e-3)
    assert model.predict(["... " * 400])[0] == [-1]


def test_sample_of_huge_tables():
    of = thresholds({"en": 6 * 10**10, "de": 3 * 10**11, "fr": 40}, 50_000)
    assert of["fr"] == 1 << HASH_BITS and all(20_000 < of[x] / 2**HASH_BITS * n < 30_000 for x, n in (("en", 6 * 10**10), ("de", 3 * 10**11)))
    assert thresholds({"a": 5}, 10) == {"a": 1 << HASH_BITS} and all(x > 0 for x in thresholds({str(i): 10**9 for i in range(100)}, 50).values())


def test_clashing_names(spark, docs):
    frame = spark.createDataFrame([(1, "some words of a text", "x", "y")], "doc_id long, text string, letters string, __letters string")
    assert [tuple(r) for r in kept_by_language(frame, train(docs), 0.3).collect()] == [(1, "some words of a text", "x", "y")]


def test_folds(spark):
    import zlib

    got = [r[0] for r in spark.range(50).select(fold(F.col("id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 for i in range(50)]


def test_sample_bound(docs):
    whole, part = train(docs), train(docs, max_rows=60)
    assert part.languages == whole.languages and part.log_p.shape == whole.log_p.shape
