"""Token counts and SentencePiece ids against the libraries."""

from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidestep.llm.queries import queries
from tidestep.llm.sentencepieces import PieceModel, decode_texts, encode_texts, model_of
from tidestep.llm.token_counts import batches_of, counter, lengths, token_counts


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_counts_are_the_library_s(spark, odd, odd_rows, bpe):
    want = Counter((i, len(t.encode()), len(bpe.encode(t, add_special_tokens=False))) for i, t in odd_rows)
    assert Counter(tuple(r) for r in token_counts(odd).collect()) == want


def test_query_counts_every_document(spark, sf, doc_rows, bpe):
    got = {r.doc_id: r for r in queries()["op2_token_counts"](spark, sf).collect()}
    assert len(got) == len(doc_rows)
    for i, t in doc_rows:
        n = len(bpe.encode(t, add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 512)


def test_splits_change_nothing(doc_rows, bpe):
    texts = [t for _, t in doc_rows] + ["x  y\n\nz \n w's it's\t q  　 a " * 50, " lead", "trail ", "a\x1c b", "don 't 's"]
    sizes = [len(t.encode()) for t in texts]
    count = counter("byte_bpe_50k.json")
    assert lengths(texts, sizes, count, True, 1 << 12, {}) == count(texts)


def test_batches_are_balanced():
    assert list(batches_of([5, 5, 20, 1, 1], 10)) == [slice(0, 2), slice(2, 3), slice(3, 5)] and not list(batches_of([], 10))


def test_empty_tables(none):
    assert token_counts(none).count() == 0 and encode_texts(none).count() == 0


def test_ids_are_the_library_s(odd, odd_rows, doc_rows, pieces):
    got = Counter((r.doc_id, tuple(r.token_ids), r.n_tokens, r.round_trip) for r in encode_texts(odd).collect())
    assert got == Counter((i, tuple(x := pieces.encode(t)), len(x), "▁" not in t) for i, t in odd_rows)
    texts = [t for _, t in doc_rows] + ["  a   b", " ", "\n \n", "▁▁x ▁", "aaaa" * 100, "can't…—“q” 3.14 e-mail @x #y", "²²2² x²."]
    assert [x.tolist() for x in model_of("piece_bpe_32k.model").encode(texts)] == pieces.encode(texts)


def test_prefixes_are_shared_rightly(pieces):
    words = ["▁a", "▁an", "▁and", "▁ands", "▁b", "and", "ands", "▁▁and", "zz", "▁the", "▁there", "▁therefore"]
    model = PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    assert model.encode_words(words) == {w: model.id_bytes(model.merged(w)) for w in words}


def test_unigram_states_are_viterbi_scores():
    """On a small unigram model the pass finds the best sum of scores, as trying all splits does."""
    model = PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    model.unigram, model.ids = True, {"a": 3, "b": 4, "ab": 5, "abc": 6, "c": 7, "bc": 8}
    model.scores, model.unknown_score = [0, 0, 0, -2.0, -2.5, -3.0, -7.0, -2.0, -3.2], -20.0
    model.byte_ids, model.tails = {}, {p[k:]: p[k:] in model.ids for p in model.ids for k in range(len(p))}

    def splits(w):
        return [[]] if not w else [[w[:k], *r] for k in range(1, len(w) + 1) if w[:k] in model.ids for r in splits(w[k:])]

    worth = lambda s: sum(model.scores[model.ids[p]] for p in s)
    for w in ("a", "ab", "abc", "abcabc", "bcab", "cabab"):
        got = model.encode_words([w, "ab", "abca"])[w]
        import numpy as np

        names = {v: k for k, v in model.ids.items()}
        assert worth([names[i] for i in np.frombuffer(got, np.int32)]) == max(map(worth, splits(w)))


def test_decoding_returns_the_texts(docs, doc_rows):
    assert {r.doc_id: r.text for r in decode_texts(encode_texts(docs)).collect()} == dict(doc_rows)


def test_query_encodes_every_document(spark, sf, doc_rows, pieces):
    got = {r.doc_id: r for r in queries()["op1_sentencepiece"](spark, sf).collect()}
    assert {i: got[i].token_ids for i in got} == {i: pieces.encode(t) for i, t in doc_rows} and all(r.round_trip for r in got.values())
