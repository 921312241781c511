"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts form an indivisible group. Groups, by size from large to small, enter the bin with the tightest
remaining capacity that holds them, found through a balanced tree of the bins; a bin is opened when none holds the group.

Groups of one size are alike, so the driver packs a histogram (size, how many groups) instead of groups: k different
sizes take at least k*k/2 bytes of input, so 10 TB have fewer than five million of them, and mostly far fewer. A class of
c groups enters the tightest bin as often as it fits, then the next: the same packing as group by group. The result is a
list of position intervals over all groups sorted by (size descending, key), and each task turns positions into shards. It
has at most one interval for each size and bin, and is broadcast. The rows of a group, which may be very many, meet their shard dealt over SALTS parts.
Slots are numbered within a task and moved by the counts of the tasks before it, which Spark sums.

Defined cases: a null text is an empty one (size 1); a very long text is measured whole; groups that tie by size are ordered by the hash of their text; repeated rows are members of one group; a group larger than the
capacity gets a bin of its own; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidestep.llm.common import session_of, shuffle_parts, texts_of
from tidestep.storage import cut


#: Parts in which the rows of one group are dealt.
SALTS = 8


class BinTree:
    """A treap of (remaining capacity, bin): insert, and take out the tightest bin of at least some capacity."""

    def __init__(self) -> None:
        self.root = None

    def insert(self, remaining: int, number: int) -> None:
        left, right = self._split(self.root, (remaining, number))
        self.root = self._merge(self._merge(left, [(remaining, number), hash((number * 2654435761) % 4294967291), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest bin that holds size leaves the tree."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best:
            left, rest = self._split(self.root, best)
            _, right = self._split(rest, (best[0], best[1] + 1))
            self.root = self._merge(left, right)
        return best

    def _split(self, node, key):
        """Trees of the keys below key, and of the others."""
        if not node:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            return [node[0], node[1], node[2], left], right
        left, right = self._split(node[2], key)
        return left, [node[0], node[1], right, node[3]]

    def _merge(self, a, b):
        if not a or not b:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> tuple[list[tuple[int, int]], int] | None:
    """Packs (size, count) classes, sizes descending: intervals (first position, bin) and the number of bins; None if more than most_bins are needed."""
    tree, intervals, bins, at = BinTree(), [], 0, 0
    for size, count in classes:
        while count:
            found = tree.take(size)
            if not found:
                if bins == most_bins:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            remaining, number = found
            n = min(count, remaining // size)
            if not intervals or intervals[-1][1] != number:
                intervals.append((at, number))
            at, count = at + n, count - n
            tree.insert(remaining - n * size, number)
    return intervals, bins


def equal_shards(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """The least capacity at which best fit needs no more than so many bins. A group that is larger than an equal share gets a shard of its own, and the others are equal among themselves."""
    total, alone = sum(s * c for s, c in classes), 0
    flat = iter([(s, i) for s, c in classes for i in range(min(c, shards))])
    while alone < shards - 1 and (big := next(flat, None)) and big[0] * (shards - alone) > total:
        total, alone = total - big[0], alone + 1
    rest, skip = [], alone
    for s, c in classes:
        used = min(skip, c)
        skip -= used
        if c > used:
            rest.append((s, c - used))
    n, low = shards - alone, max(-(-total // (shards - alone)), rest[0][0] if rest else 0)
    step, packed = 0, best_fit_decreasing(rest, low, n)
    while packed is None:
        step = 2 * step or 1
        packed = best_fit_decreasing(rest, low + step, n)
    below, above = step // 2, step
    while above - below > 1:
        if (found := best_fit_decreasing(rest, low + (mid := (below + above) // 2), n)) is None:
            below = mid
        else:
            above, packed = mid, found
    return [(i, i) for i in range(alone)] + [(at + alone, b + alone) for at, b in packed[0]]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of every row."""
    return texts_of(docs).select("doc_id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("key"))


def shard_documents(docs: DataFrame, shards: int | None = 16, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): into so many shards of near equal bytes, or (shards None) into as few shards of a fixed capacity as best fit needs."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = session_of(docs)
    rows = measured(docs)
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    ordered = cut(groups.repartitionByRange(shuffle_parts(spark), F.desc("bytes"), F.asc("key")).sortWithinPartitions(F.desc("bytes"), F.asc("key")))
    histogram = ordered.groupBy("bytes").count().toArrow()
    classes = sorted(zip(*(histogram.column(c).to_pylist() for c in ("bytes", "count")), strict=True), reverse=True)
    intervals = equal_shards(classes, shards) if shards else best_fit_decreasing(classes, capacity)[0]
    starts = np.array([x[0] for x in intervals], dtype=np.int64)
    bins = np.array([x[1] for x in intervals], dtype=np.int32)
    per_task = dict(ordered.groupBy(F.spark_partition_id().alias("p")).count().collect())
    offsets, before = {}, 0
    for p in sorted(per_task):
        offsets[p], before = before, before + per_task[p]
    table = spark.sparkContext.broadcast((starts, bins, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, bins, offsets = table.value
        at = None
        for b in batches:
            if b.num_rows:
                at = offsets[b.column(1)[0].as_py()] if at is None else at
                found = np.searchsorted(starts, np.arange(at, at + b.num_rows), side="right") - 1
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins[found])], ["key", "shard"])

    placed = ordered.select("key", F.spark_partition_id().alias("p")).mapInArrow(place, "key binary, shard int")
    spread = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    dealt = cut(salted.join(spread, ["key", "salt"]).select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("p")))
    tasks = dealt.groupBy("shard", "p").agg(F.count("*").alias("n"))
    # a shard has a row for each task here
    before = tasks.select("shard", "p", (F.sum("n").over(Window.partitionBy("shard").orderBy("p")) - F.col("n")).alias("before"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for b in batches:
            slots = np.empty(b.num_rows, dtype=np.int64)
            if b.num_rows:
                shard = b.column(3).to_numpy()
                for s in np.unique(shard).tolist():
                    own = np.flatnonzero(shard == s)
                    first = at.get(s, 0)
                    slots[own] = np.arange(first, first + len(own))
                    at[s] = first + len(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slots)], ["doc_id", "size", "text_crc32", "shard", "p", "at"])

    own = dealt.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, p int, at long")
    return own.join(before, ["shard", "p"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).alias("slot"))
