"""Language ID by multilingual mixture inference.

A model holds, for every language, the log-probabilities of hashed byte trigrams of lower-case words. A document's words
are draws from a mixture of languages: expectation-maximisation estimates the proportions from the words' trigram
likelihoods, and the set of languages is the one of the greatest likelihood less a penalty for each further language. The
prediction is the language with the largest proportion in that set, and its score that proportion.

The model is fitted on a sample of at most about `max_rows` labelled rows (a documented bound; below it all labelled rows
count): an equal share for each language, so that a rare one keeps its rows, chosen by a hash of id and text. Its size is languages x BUCKETS whatever the input, so it is broadcast. The
counts of the sample are summed by Spark as (language, bucket) rows; predicting is one narrow pass. A text of more than
CHUNK_BYTES is read in pieces, and its equal words are one row with a weight from then on: memory grows with its different
words, not with its length.

Defined cases: a very long text is judged whole, but a word of more than CHUNK_BYTES in parts; a text that is null or has no letter is `und` with score 0, as is every text if nothing was learned;
repeated rows each give a row; ties go to the language that sorts first; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import fresh, sliced, texts_of

BUCKETS = 1 << 15
SMOOTHING = 0.05
CHUNK_BYTES = 1 << 19
HASH_BITS = 62
UNKNOWN = "und"

#: Bytes of words: ASCII letters and all bytes of other characters; the rest is a blank.
_KEPT = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each byte of a word, where each word begins among them, the document of each word)."""
    raw = [t.lower().encode() for t in texts]
    joined = _KEPT[np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)]
    inside = joined != 32
    at = np.flatnonzero(inside)
    code = (joined[at - 1] << 16) | (joined[at] << 8) | joined[at + 1]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
    begins = np.flatnonzero(~inside[at - 1]) if len(at) else at
    ends = np.cumsum([len(x) + 1 for x in raw])
    return bucket, begins, np.searchsorted(ends, at[begins] - 1, side="right")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: BUCKETS x languages
    log_p: np.ndarray

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(likelihoods of each word over the greatest of them, how often it occurs, its document)."""
        bucket, begins, doc = trigrams(texts)
        if not len(begins):
            return np.zeros((0, len(self.languages)), dtype=np.float32), doc, doc
        words = np.add.reduceat(self.log_p[bucket], begins, axis=0, dtype=np.float32)
        return np.exp(words - words.max(axis=1, keepdims=True)), np.ones(len(doc), dtype=np.int64), doc

    def _distinct_words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one long text, read in pieces; words of equal likelihoods are one row."""
        held, weight = np.zeros((0, len(self.languages)), dtype=np.float32), np.zeros(0, dtype=np.int64)
        for piece in pieces(text):
            like, n, _ = self._words([piece])
            rows = np.ascontiguousarray(np.concatenate([held, like]))
            _, first, place = np.unique(rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
            held, weight = rows[first], np.bincount(place, np.concatenate([weight, n]), len(first)).astype(np.int64)
        return held, weight, np.zeros(len(held), dtype=np.int64)

    def predict(self, texts: list[str], iterations: int = 8, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(the number of the leading language, its proportion) of each text; -1 and 0 for a text without words."""
        n, m = len(texts), len(self.languages)
        best, score = np.full(n, -1), np.zeros(n)
        if not m:
            return best, score
        like, weight, doc = self._distinct_words(texts[0]) if n == 1 and len(texts[0]) > CHUNK_BYTES else self._words(texts)
        if not len(like):
            return best, score
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        own = doc[first]
        rows = np.diff(np.r_[first, len(doc)])
        count = np.add.reduceat(weight, first)
        index = np.repeat(np.arange(len(first)), rows)
        weighed = weight.astype(np.float32)[:, None] if (weight > 1).any() else None

        def fit(pi: np.ndarray, rounds: int) -> np.ndarray:
            for _ in range(rounds):
                part = like * pi[index]
                part /= part.sum(axis=1, keepdims=True) + np.float32(1e-30)
                if weighed is not None:
                    part *= weighed
                pi = np.add.reduceat(part, first, axis=0) / count[:, None]
            return pi

        pi = fit(np.full((len(first), m), 1 / m, dtype=np.float32), iterations)
        order = np.argsort(-pi, axis=1, kind="stable")
        chosen, worth = None, None
        for k in range(1, m + 1):
            mask = np.zeros_like(pi)
            np.put_along_axis(mask, order[:, :k], 1, axis=1)
            own_pi = pi * mask + np.float32(1e-9) * mask
            own_pi = own_pi / own_pi.sum(axis=1, keepdims=True)
            if k > 1:
                own_pi = fit(own_pi, 2)
            logs = np.log((like * own_pi[index]).sum(axis=1) + np.float32(1e-30))
            value = np.add.reduceat(logs if weighed is None else logs * weight, first) - penalty * (k - 1) * np.log1p(count)
            if chosen is None:
                chosen, worth = own_pi, value
            else:
                better = value > worth
                chosen[better], worth[better] = own_pi[better], value[better]
        best[own] = chosen.argmax(axis=1)
        score[own] = chosen.max(axis=1)
        return best, np.clip(score, 0, 1)


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about CHUNK_BYTES characters, cut at white space where there is some."""
    begin = 0
    while begin < len(text):
        end = begin + CHUNK_BYTES
        if end < len(text):
            end = max(text.rfind(c, begin + 1, end) for c in " \n\t") + 1 or end
        yield text[begin:end]
        begin = end


def chunks(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about CHUNK_BYTES; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and len(t) > CHUNK_BYTES:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
        if size >= CHUNK_BYTES:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def thresholds(sizes: dict[str, int], max_rows: int) -> dict[str, int]:
    """Of each language the hashes of HASH_BITS bits that take a row into the sample: all of them up to its share of max_rows, else as many as give that share."""
    left, of = max_rows, {}
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        quota = max(left // (len(sizes) - k), 1)
        of[lang] = (1 << HASH_BITS) * min(quota, n) // n
        left = max(left - min(quota, n), 0)
    return of


def train(docs: DataFrame, max_rows: int = 50_000) -> Model:
    """Fits a model on the rows of (doc_id, text, lang) that have both; the held-out fold must have been taken away."""
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    sample = labelled.select("text", "lang")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) > max_rows:
        of = thresholds(sizes, max_rows)
        limit = F.create_map(*(F.lit(x) for pair in of.items() for x in pair))[F.col("lang")]
        sample = labelled.filter(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - HASH_BITS) < limit).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in sliced(batches):
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for c in chunks(own):
                    held = found.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    held += np.bincount(trigrams(own[c])[0], minlength=BUCKETS)
        for lang, held in found.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], ["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(set(counts.column("lang").to_pylist())))
    table = np.full((BUCKETS, len(languages)), SMOOTHING, dtype=np.float64)
    number = {x: i for i, x in enumerate(languages)}
    np.add.at(table, (counts.column("bucket").to_numpy(), np.array([number[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)), counts.column("n").to_numpy())
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32) if languages else table.astype(np.float32))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for b in sliced(batches):
            best, score = predicted(model, b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    texts = texts_of(docs, id_col, text_col)
    return texts.select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def predicted(model: Model, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    for c in chunks(texts):
        best[c], score[c] = model.predict(texts[c])
    return np.where(letters, best, -1), np.where(letters, score, 0.0)


def kept_by_language(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows, of any columns and names, whose text has a language that takes up at least least_score of its words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            best, score = predicted(shared.value, b.column(at).to_pylist(), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array((best >= 0) & (score >= least_score))).select(list(range(b.num_columns - 1)))

    at = docs.columns.index("text")
    text = F.coalesce(docs["text"], F.lit(""))
    (letters,) = fresh(docs, "letters")
    whole = docs.withColumns({"text": text, letters: text.rlike(r"\p{L}")})
    return whole.mapInArrow(run, docs.schema)
