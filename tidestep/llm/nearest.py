"""Approximate nearest neighbours by multi-index hashing.

Vectors become codes of BITS bits: scaled to length 1, centred, put on principal axes and turned by learned rotations (iterative
quantisation), of which as many as the code needs are made from different starts. A code is split into TABLES substrings of WIDTH bits,
each with a table of its own. Of two codes at a Hamming distance under TABLES * (a + 1) some substring differs by at most a bits, so once
every table has been probed up to a bits, all codes within that distance are known. Probing goes bit by bit until so many codes are
within the known distance as the search is to rerank; then every code within the least such radius is reranked by the cosine of the
original vectors, in double precision.

Axes and rotations are learned on SAMPLE rows at most (those of the least hash of their id); every row is indexed. Rows are dealt over
blocks of at most about BLOCK rows, each with tables of its own, so no value of a substring gathers its rows in one task, be a third of
all vectors equal. A block reranks the codes of the radius that holds a SHARE of its rows, LEAST at least, and hands on the nearest few of
each query; the nearest of these are the result. A level is probed by flipping bits, or by walking the table's list of values that occur
if that is shorter. Broadcast is the model alone: dimension * BITS numbers.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components takes no part, nor does a row without an id; vectors of unequal
length count as filled up with zeros; of rows of one id the one with the least vector asks, and none of them is an answer to it, while to
others each is; equal scores go by id; fewer candidates than asked for give as many ranks; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.blocks import block_count, dealt, finite, first, for_all, numbers, searched
from tidestep.llm.common import session_of

BITS, WIDTH = 128, 16
TABLES = BITS // WIDTH
#: Rows that the model is learned on, at most, and the steps of its learning.
SAMPLE, ROUNDS = 4096, 20
#: Rows of a block, and how many of them are reranked: a share, and so many at least.
BLOCK, SHARE, LEAST = 32768, 1 / 24, 64
#: Queries and pairs that are held at once.
ASKED, PAIRS = 32, 1 << 15
FAR = 255


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row by a power of two that brings it near 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def learned(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): a unit vector's code is the signs of (vector - mean) @ projection."""
    x = unit(sample)
    mean = x.mean(axis=0)
    axes = np.linalg.svd(x - mean, full_matrices=True)[2][:bits].T
    placed, rng, turned = (x - mean) @ axes, np.random.default_rng(seed), []
    for _ in range(-(-bits // axes.shape[1])):
        turn = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(placed @ turn > 0, 1.0, -1.0).T @ placed)
            turn = (u @ v).T
        turned.append(axes @ turn)
    return mean, np.concatenate(turned, axis=1)[:, :bits]


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows of TABLES substrings."""
    return np.packbits((unit(x) - model[0]) @ model[1] > 0, axis=1).view(np.uint16)


@functools.cache
def flips(level: int) -> np.ndarray:
    """All substrings of so many set bits."""
    every = np.arange(1 << WIDTH, dtype=np.uint16)
    return every[np.bitwise_count(every) == level]


class Tables:
    """A block's rows: their vectors, codes, and for each substring the rows by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> None:
        self.ids, self.model = ids, model
        self.vectors = scaled(vectors)
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.codes = codes(vectors, model)
        self.order = [np.argsort(self.codes[:, t], kind="stable") for t in range(TABLES)]
        self.ends = [np.r_[0, np.cumsum(np.bincount(self.codes[:, t], minlength=1 << WIDTH))] for t in range(TABLES)]
        self.values = [np.unique(self.codes[:, t]) for t in range(TABLES)]

    def probed(self, own: np.ndarray, t: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows whose substring t differs from the query's (own) by exactly so many bits."""
        masks = flips(level)
        if len(masks) <= len(self.values[t]):
            asked, value = np.repeat(np.arange(len(own)), len(masks)), (own[:, None] ^ masks).ravel()
        else:
            asked, place = np.nonzero(np.bitwise_count(own[:, None] ^ self.values[t]) == level)
            value = self.values[t][place]
        begin, count = self.ends[t][value], self.ends[t][value.astype(np.int64) + 1] - self.ends[t][value]
        asked, begin, count = asked[count > 0], begin[count > 0], count[count > 0]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(asked, count), self.order[t][np.repeat(begin, count) + inside]

    def within(self, own: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row): for each query's code every row within the least radius that holds so many rows."""
        distance = np.full((len(own), len(self.ids)), FAR, dtype=np.uint8)
        left, found = np.arange(len(own)), []
        for level in range(WIDTH + 1):
            for t in range(TABLES):
                asked, row = self.probed(own[left, t], t, level)
                asked = left[asked]
                distance[asked, row] = np.bitwise_count(self.codes[row] ^ own[asked]).sum(axis=1, dtype=np.uint8)
            nth = np.partition(distance[left], need - 1, axis=1)[:, need - 1]
            done = nth < TABLES * (level + 1)
            asked, row = np.nonzero(distance[left[done]] <= nth[done][:, None])
            found.append((left[done][asked], row))
            left = left[~done]
            if not len(left):
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def nearest(self, ids: np.ndarray, vectors: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query's id, row's id, cosine): the nearest rows of other ids among those reranked, at most so many a query."""
        need = min(len(self.ids), max(LEAST, int(len(self.ids) * SHARE)) + 1)
        for begin in range(0, len(ids), ASKED):
            own, name = scaled(vectors[begin : begin + ASKED]), ids[begin : begin + ASKED]
            norm = np.sqrt((own**2).sum(axis=1))
            asked, row = self.within(codes(own, self.model), need)
            asked, row = (x[name[asked] != self.ids[row]] for x in (asked, row))
            score = np.empty(len(row))
            for at in range(0, len(row), PAIRS):
                q, r = asked[at : at + PAIRS], row[at : at + PAIRS]
                score[at : at + PAIRS] = (own[q] * self.vectors[r]).sum(axis=1) / (norm[q] * self.norms[r])
            order = np.lexsort((self.ids[row], -score, asked))
            asked, row, score = asked[order], row[order], score[order]
            place = np.arange(len(asked)) - np.searchsorted(asked, asked)
            asked, row, score = asked[place < most], row[place < most], score[place < most]
            yield name[asked], self.ids[row], np.clip(score, -1.0, 1.0)


def nearest(vectors: DataFrame, divisor: int = 50, most: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of every row whose id the divisor divides, the most similar other rows by cosine."""
    spark = session_of(vectors)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & finite(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    learn = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    model = spark.sparkContext.broadcast(learned(numbers(learn, width)) if n else None)
    blocks = block_count(spark, n, BLOCK)
    asked = rows.filter(F.col("id") % divisor == 0).groupBy("id").agg(F.min("v").alias("v"))

    def prepare(own: pa.RecordBatch) -> Tables:
        return Tables(own.column(0).to_numpy(), numbers(own.column(1), width), model.value)

    def search(tables: Tables, own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for found in tables.nearest(own.column(0).to_numpy(), numbers(own.column(1), width), most):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    met = searched(dealt(rows, blocks), for_all(asked, blocks), blocks, prepare, search, "query_id long, vec_id long, score double")
    return first(met, ["query_id"], [F.col("score").desc(), F.col("vec_id")], most).select("query_id", "rank", "vec_id", "score")
