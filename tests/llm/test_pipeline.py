"""The pipeline against its stages done plainly."""

import re

import pytest
import sentencepiece
import public_tokenizers

import corpus_pipeline
from tidestep.llm.decontaminate import Matcher
from tidestep.llm.language_id import fold, train
from tests.llm.test_ngram_join import brute
from tests.llm.test_secrets import spans


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "sentencepiece"]


def test_run_against_plain_stages(spark, sf, docs):
    model = train(docs.filter(fold(docs["doc_id"]) != 2))
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if re.search(r"[^\W\d_]", r.text or ""))
    best, score = model.predict([t for _, t in rows])
    rows = [r for r, b, s in zip(rows, best, score, strict=True) if b >= 0 and s >= corpus_pipeline.LEAST_SHARE]
    own, comp = brute([t for _, t in rows], 5, 80, 100)
    rows = [r for i, r in enumerate(rows) if comp[i] == i]
    matcher = Matcher([(b.item_id, b.text) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 0.1)
    rows = [r for r in rows if not matcher.match(r[1])]
    clean = {i: t for i, t in rows if not spans(t)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {i for i, _ in rows}
    assert all(got[i].token_ids == pieces.encode(t) for i, t in clean.items()) and all(r.round_trip for r in got.values())
    for i in set(got) - set(clean):
        text = pieces.decode(got[i].token_ids)
        assert not [s for s in spans(text) if s.split(":")[0] != "assign"] and re.search(r"\[(assign|access|hex)\]", text)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_rows(spark, sf, odd, docs, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    mixed = docs.unionByName(odd.select(docs.columns)) if name == "language_id" else odd
    got = stage(spark, mixed, sf)
    if name != "sentencepiece":
        assert got.columns == mixed.columns
    n = got.count()
    assert 0 < n <= mixed.count() and (name not in ("secrets", "sentencepiece") or n == mixed.count())
    assert stage(spark, none, sf).count() == 0


def test_near_duplicates_leave_one(spark, sf, odd):
    got = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_duplicates(spark, odd, sf).collect()]
    assert len(got) == len(set(got)) == 11
