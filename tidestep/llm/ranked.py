"""Ranked lexical search by accumulator-limited term-at-a-time.

Terms are the maximal runs of letters, digits and characters beyond ASCII in the whole text, A-Z lower-cased. One pass over the documents
counts each one's terms and keeps the postings that some item may ask for: a table of fixed size (2 ** MARK_BITS marks) of the items' terms
passes over the others, and a join by the term itself decides. From the postings come the number of documents N, all their terms L, and each
asked term's number of documents df; all are over the whole table. A term's contribution to a document's score is whole-numbered, as the
query's contract states it, so sums have no rounding and no order.

Postings are dealt over blocks of documents, each with lists by term, and the items stream by. For each item a block adds up one term's list
after another, rarest first. Each new document gets an accumulator, until the most that the terms to come can add (the greatest contributions of
their lists) is below the kth greatest sum so far: from there on no new document can enter the block's first k, and only those that have
an accumulator are followed, exactly, to the last term. A block hands on at most k documents of an item, so the common words of many
documents are added up in arrays and never joined.

Defined cases: a null text or one without a term has no score, and counts neither in N nor L; of an item the terms of all rows of its id count, once each
(a null id is one too); very long texts are read in pieces cut between terms; repeated documents are ranked each for itself;
equal scores go by doc_id, null after all others; scores of 0 aren't returned; empty tables give no row; other columns aren't read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.blocks import block_count, dealt, first, for_all, searched
from tidestep.llm.common import session_of, sliced, texts_of
from tidestep.storage import shared_dir

MARK_BITS = 20
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20
#: Documents and postings of a block.
BLOCK, POSTINGS = 1 << 15, 1 << 22
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_TERMS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def counted(text: bytes, marks: bytes | None = None) -> tuple[int, dict[bytes, int]]:
    """(number of terms, how often each occurs); with marks, only of terms whose place is marked."""
    total, found, at = 0, Counter(), 0
    while at < len(text):
        cut = _GAP.search(text, at + PIECE)  # past the end of the term that the piece ends in
        end = cut.start() if cut else len(text)
        words = text[at:end].translate(_TERMS).split()
        total += len(words)
        for word, n in Counter(words).items():
            if marks is None or marks[mark(word)]:
                found[word] += n
        at = end
    return total, found


def mark(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) & ((1 << MARK_BITS) - 1)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, mark), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = list(counted(text.as_buffer().to_pybytes())[1])
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array([w.decode() for w in own], pa.string()), pa.array([mark(w) for w in own], pa.int32())], ["item_id", "term", "mark"])

    return texts_of(items, id_col, text_col).mapInArrow(run, "item_id long, term string, mark int").distinct()


def postings_of(docs: DataFrame, marks: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of each document that has a term."""
    shared = session_of(docs).sparkContext.broadcast(marks.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sizes, terms, counts = [], [], []
            for text in b.column(1):
                n, own = counted(text.as_buffer().to_pybytes(), shared.value)
                sizes.append(n)
                terms.append([w.decode() for w in own])
                counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, terms array<string>, counts array<long>").filter("n > 0")


class Lists:
    """A block's postings by term: documents, and the part of a contribution that doesn't depend on the term's weight."""

    def __init__(self, own: pa.RecordBatch, docs: int, words: int) -> None:
        ids, self.null = own.column("doc_id").fill_null(0).to_numpy(), own.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        self.ids = ids
        m = 10 + (90 * own.column("n").to_numpy() * docs) // words
        sizes = own.column("terms").value_lengths().to_numpy()
        coded = own.column("terms").flatten().dictionary_encode()
        tf, code = own.column("counts").flatten().to_numpy(), coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        doc = np.repeat(np.arange(len(ids)), sizes)[order]
        tf = tf[order]
        self.doc, self.part = doc, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        self.ends = np.r_[0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]
        self.code = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        self.most = np.maximum.reduceat(self.part, self.ends[:-1]) if len(code) else self.part
        self.sums = np.zeros(len(ids), dtype=np.int64)
        self.held = np.zeros(len(ids), dtype=bool)

    def ranked(self, terms: list[str], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document's row, score) of the first k, the terms being given rarest first."""
        own = [(c, w) for t, w in zip(terms, weights, strict=True) if w > 0 and (c := self.code.get(t)) is not None]
        rest = np.cumsum([0, *(w * int(self.most[c]) for c, w in reversed(own))])[::-1]
        known, open_ = np.zeros(0, dtype=np.int64), True
        for (c, w), most in zip(own, rest[:-1], strict=True):
            if open_ and len(known) >= k and most < np.partition(self.sums[known], len(known) - k)[len(known) - k]:
                open_ = False
            span = slice(self.ends[c], self.ends[c + 1])
            doc, part = self.doc[span], self.part[span]
            if open_:
                new = doc[~self.held[doc]]
                self.held[new] = True
                known = np.concatenate([known, new])
            else:
                keep = self.held[doc]
                doc, part = doc[keep], part[keep]
            self.sums[doc] += w * part
        score = self.sums[known].copy()
        self.sums[known], self.held[known] = 0, False
        order = np.lexsort((self.ids[known], self.null[known], -score))[:k]
        order = order[score[order] > 0]
        return known[order], score[order]


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0."""
    spark = session_of(docs)
    asked = item_terms(items, item_col, item_text)
    marks = np.zeros(1 << MARK_BITS, dtype=np.uint8)
    marks[asked.select("mark").distinct().toArrow().column(0).to_numpy().astype(np.int64)] = 1  # at most 2 ** MARK_BITS numbers
    at = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    postings_of(docs, marks, id_col, text_col).write.parquet(at)
    held = spark.read.schema("doc_id long, n long, terms array<string>, counts array<long>").parquet(at)
    n_docs, n_words, n_postings = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(block_count(spark, n_docs, BLOCK), -(-n_postings // POSTINGS))
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = asked.select("item_id", "term").join(df, "term").withColumn("w", weight)
    lists = weighed.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("df", "term", "w"))).alias("own"))
    queries = lists.select("item_id", F.col("own.term").alias("terms"), F.col("own.w").alias("weights"))

    def prepare(own: pa.RecordBatch) -> Lists:
        return Lists(own, n_docs, n_words)

    def search(lists: Lists, own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for begin in range(0, own.num_rows, 1024):
            item, *lists_of = (c.to_pylist() for c in own.slice(begin, 1024).columns)
            found = [lists.ranked(terms, weights, k) for terms, weights in zip(*lists_of, strict=True)]
            row, score = (np.concatenate(x) for x in zip(*found, strict=True))
            items_of = pa.array(item, pa.int64()).take(pa.array(np.repeat(np.arange(len(item)), [len(r) for r, _ in found])))
            yield pa.RecordBatch.from_arrays([items_of, pa.array(lists.ids[row], mask=lists.null[row]), pa.array(score)], ["item_id", "doc_id", "score"])

    met = searched(dealt(held, blocks), for_all(queries, blocks), blocks, prepare, search, "item_id long, doc_id long, score long")
    return first(met, ["item_id"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k).select("item_id", "rank", "doc_id", "score")
