"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes (``batch_bytes``), and texts are split at safe boundaries, so a very long text is not encoded
in one piece. A boundary is safe where every pre-token ends whatever follows: before a single blank between two characters
that are not white space. A batch encodes every part that is new to it once, and a worker remembers the lengths of short
parts, up to a fixed number. A text without such a place is encoded whole.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated or null ids each give a row of
their own; an empty table gives an empty result; columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import sliced, texts_of

#: Before a blank alone between characters that are not white space.
SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Parts that a worker remembers, and the characters of the longest that it does.
MOST_CACHED, LONGEST_CACHED = 1 << 19, 48
SCHEMA = "doc_id long, n_bytes long, n_tokens long"

_loaded: dict[str, object] = {}
_lengths: dict[str, dict[str, int]] = {}


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is, or the place of a public vocabulary of that name."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def counter(vocabulary: str):
    """texts -> list of lengths, by the library that the file is for; loaded once a worker."""
    if vocabulary not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = vocabulary_path(vocabulary)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[vocabulary] = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[vocabulary] = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    return _loaded[vocabulary]


def pieces(text: str) -> list[str]:
    """The text in parts whose tokens together are the text's tokens."""
    return SAFE.split(text)


def batches_of(sizes: list[int], batch_bytes: int) -> Iterator[slice]:
    """Runs of texts of about batch_bytes; a longer text stands alone."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > batch_bytes:
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def lengths(texts: list[str], sizes: list[int], count, splits: bool, batch_bytes: int, cache: dict[str, int]) -> list[int]:
    """Token counts of the texts, whose bytes are sizes. Each batch of about batch_bytes encodes every part that is new to it once; cache holds lengths of short parts."""
    totals: list[int] = []
    for own in batches_of(sizes, batch_bytes):
        if not splits:
            totals += count(texts[own])
            continue
        parts = [pieces(t) for t in texts[own]]
        if len(cache) > MOST_CACHED:
            cache.clear()
        new = list({p for x in parts for p in x if p not in cache})
        cache.update(zip(new, count(new), strict=True))
        totals += [sum(map(cache.__getitem__, x)) for x in parts]
        for p in new:
            if len(p) > LONGEST_CACHED:
                del cache[p]
    return totals


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row; one narrow pass, no shuffle.

    Byte-level vocabularies (.json) are split at safe boundaries; for .model files a split would add a word mark, so texts stay whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cache = counter(vocabulary), _lengths.setdefault(vocabulary, {})
        for b in sliced(batches):
            sizes = pc.binary_length(b.column(1)).cast(pa.int64())
            n_tokens = lengths(b.column(1).to_pylist(), sizes.to_pylist(), count, vocabulary.endswith(".json"), batch_bytes, cache)
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def with_limit(counts: DataFrame, limit: int = 512) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
