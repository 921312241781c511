"""N-gram Jaccard join: near duplicates by a blocked sparse product of the document by n-gram incidence.

Documents link when limit_den * |A and B| >= limit_num * |A or B| of their sets of word shingles. The join returns every
document's class and component, which lose no link between different texts:

1. One pass hashes each text's set (64 bits a shingle). Documents of equal sets are one class from here on, so copies, be
   they a third of all rows, never meet in pairs. The same pass counts shingles in a fixed number of buckets, a table of
   fixed size that is summed in a streaming reduction and broadcast: the global order of shingles, rare ones first.
2. A group of near copies is thinned first: a class belongs to the groups of at most LEADS leaders (the most central
   of the classes that share several of a few min-hashes with it). A group of at most STAR classes is multiplied with itself, a larger one
   with HEADS of its rows, so a group of m classes makes about HEADS * m products and not m*m. Classes that link are one component from here on.
   The u classes of a large group that stay outside its largest component are multiplied once more, with about HEADS * m / u of its rows.
3. The product makes the result whole between components. Of each class only the first shingles by the global order are kept,
   so many that a linked pair must share one. The incidence is dealt in blocks by shingle; a block multiplies each column
   with itself, between classes of different components. It discards pairs by the sizes of their sets, by the positions of
   the shared shingle, and, between classes of large groups, by MARKS parities of their sets: as many as differ, so many shingles at least
   are in one set only. A column of more than COLUMN classes is streamed out in runs of sizes, and each pair of runs whose sizes may
   link is a block of its own. The overlap counts of a pair from all blocks are added up, and the pair is discarded if they
   and what may follow stay below the overlap that the sizes ask for.
4. What is left is decided by the product of whole rows, in tiles of at most 2 * TILE classes whose overlap counts add up over
   blocks of shingles: few-membered columns pair by pair, the others as a matrix. Texts that no tile asks for are left out by a broadcast
   table of fixed size before they are shuffled. A tile reads a text once however many pairs it is in, discards pairs below the overlap that their sizes ask for, and gives at most an edge for each class.
5. Components are found by star contraction.

What grows faster than the input is the number of pairs of different components that share a first shingle and that sizes, positions and parities
don't discard, i.e. of the closest near misses: k of them in one group come to k*k/2 rows of numbers in step 3 and k*k/TILE texts in step 4.

Defined cases: a text that is null, empty or of white space has no shingle and links with nothing, not even with copies
of itself; a very long text is one set, held by one task at a time; repeated rows are linked copies; a null doc_id is passed over when the least doc_id of a
component is sought, unless there is no other; of documents that tie by doc_id the one of the least text hash stands for them; an
empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import filed, row_of, sliced
from tidestep.llm.components import components
from tidestep.llm.shingles import mix, shingle_set
from tidestep.storage import cut

BUCKET_BITS, PARTS = 18, 16
#: The bits of the table by which texts that no tile asks for are left out before a shuffle.
SIEVE_BITS = 25
#: Min-hashes, and how many of them must agree with a leader's.
MINS, AGREE = 8, 3
#: Parts in which the classes of one min-hash value are dealt, as one value may be that of very many.
SALTS = 8
#: The leaders that a class has at most, the rows that a large group is multiplied with, and how many classes one tile reads against these.
LEADS, HEADS, STAR = 2, 64, 128
#: The classes in one block of a column, the side of a tile, the shingles that a tile multiplies at once, and the members of a column that is done pair by pair.
COLUMN, TILE, COLUMNS, FEW = 1024, 128, 1 << 13, 8
#: The parities that stand for a set of a large group, and the pairs for which they are compared at once.
MARKS, COMPARED = 1024, 1 << 14
#: The pairs whose overlap counts a task adds up before it hands them on.
MOST_SUMS = 1 << 19
_MIN_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, MINS, dtype=np.uint64) | np.uint64(1)


def least_overlap(a, b, num: int, den: int):
    """The least |A and B| with which sets of these sizes link."""
    return -(-num * (a + b) // (num + den))


def prefix_size(n: int, num: int, den: int) -> int:
    """A set that links shares at least ceil(num * n / den) of its shingles, so one of its first so many in any order."""
    return n - -(-num * n // den) + 1


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, text_hash, row, n, set_key, mins) of documents and (part, counts) of the shingle counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        names = ["doc_id", "text_hash", "row", "n", "set_key", "mins", "part", "counts"]
        none = lambda m, t: pa.nulls(m, t)
        for b in sliced(batches):
            sizes, keys, mins, held = [], [], [], []
            for text in b.column(3):
                s = shingle_set(text.as_buffer().to_pybytes(), words)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s))
                mins.append([int(mix(s * x).min().view(np.int64)) for x in _MIN_SEEDS] if len(s) else None)
                held.append(s)
            if held:
                counts += np.bincount((np.concatenate(held) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(mins, pa.list_(pa.int64())), none(m, pa.int32()), none(m, pa.binary())], names)
        parts = [x.tobytes() for x in np.split(counts, PARTS)]
        yield pa.RecordBatch.from_arrays([none(PARTS, pa.int64()), none(PARTS, pa.int64()), none(PARTS, pa.int64()), none(PARTS, pa.int64()), none(PARTS, pa.binary()), none(PARTS, pa.list_(pa.int64())), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, text_hash long, row long, n long, set_key binary, mins array<long>, part int, counts binary")


def summed_counts(profile: DataFrame) -> np.ndarray:
    """The bucket counts of all tasks, added up in a stream; of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in sliced(batches):
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(counts, dtype=np.int64)
                held[part] = held[part] + x if part in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "counts"])

    parts = profile.filter("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(add, "part int, counts binary").collect()
    total = {r[0]: np.frombuffer(r[1], dtype=np.int64) for r in parts}
    empty = np.zeros((1 << BUCKET_BITS) // PARTS, dtype=np.int64)
    return np.concatenate([total.get(p, empty) for p in range(PARTS)])


def leaders_of(classes: DataFrame) -> DataFrame:
    """(lead, cid, place) of the classes that agree in AGREE min-hashes with a leader: of the classes with one value of a min-hash, the one whose values most others share. place: 0 for the leader that a class agrees with most, up to LEADS - 1."""
    bands = classes.select("cid", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int").alias("salt"), F.posexplode("mins").alias("k", "value"))
    spread = lambda small: small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    common = bands.groupBy("k", "value").agg(F.count("*").alias("size")).filter("size > 1")
    shared = cut(bands.join(spread(common), ["k", "value", "salt"]))
    central = shared.groupBy("cid").agg(F.sum("size").alias("weight"))
    weighed = shared.join(central, "cid")
    leads = weighed.groupBy("k", "value").agg(F.max(F.struct("weight", (-F.col("cid")).alias("cid"))).alias("best")).select("k", "value", (-F.col("best.cid")).alias("lead"))
    met = shared.join(spread(leads), ["k", "value", "salt"]).filter("lead <> cid").groupBy("cid", "lead").agg(F.count("*").alias("agree")).filter(F.col("agree") >= AGREE)
    ranked = met.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("agree", (-F.col("lead")).alias("lead"))), False), 1, LEADS).alias("best"))  # at most MINS
    return cut(ranked.select("cid", F.posexplode("best").alias("place", "best")).select((-F.col("best.lead")).alias("lead"), "cid", "place"))


Rows = tuple[np.ndarray, ...]  # class, component, size of its set, position of the token in its order; if at hand, the parities of the set (none: zeros)


class Forest:
    """Union-find over a tile's rows."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def overlaps(token: np.ndarray, row: np.ndarray, n: int, m: int) -> np.ndarray:
    """How many tokens each of the rows 0 to n - 1 shares with each of n to n + m - 1, or (m = 0) with each other; added up over blocks of tokens."""
    _, column, count = np.unique(token, return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row, count_of = row[order], count[column[order]]
    begin = np.cumsum(count) - count
    total = np.zeros((n, m or n), dtype=np.int32)
    for c in range(2, FEW + 1):  # the sparse columns; those of one member add to no overlap
        members = row[begin[count == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i + 1, c):
                x, y = np.minimum(members[:, i], members[:, j]), np.maximum(members[:, i], members[:, j])
                keep = (x < n) & (y >= n) if m else slice(None)
                total += np.bincount(x[keep] * np.int64(m or n) + y[keep] - (n if m else 0), minlength=total.size).reshape(total.shape)
    dense = np.flatnonzero(count > FEW)
    number = np.full(len(count), -1)
    number[dense] = np.arange(len(dense))
    place = number[column[order]]
    row, place = row[count_of > FEW], place[count_of > FEW]
    for at in range(0, len(dense), COLUMNS):
        own = slice(*np.searchsorted(place, [at, at + COLUMNS]))
        block = np.zeros((n + m, min(COLUMNS, len(dense) - at)), dtype=np.float32)
        block[row[own], place[own] - at] = 1
        total += (block[:n] @ (block[n:] if m else block).T).astype(np.int32)
    return total


def tile_edges(x: list[np.ndarray], y: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Edges (i, j) that connect the linked sets of a tile: of x with itself, or of x (numbered first) with y."""
    sets, n = x + (y or []), len(x)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    found = overlaps(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), n, len(y or ()))
    ok = found >= least_overlap(size[:n][:, None], (size[n:] if y else size)[None, :], num, den)
    if not y:
        ok &= np.triu(np.ones_like(ok), 1)
    forest = Forest(len(sets))
    p, q = np.nonzero(ok)
    return [(i, j) for i, j in zip(p.tolist(), (q + n if y else q).tolist(), strict=True) if forest.join(i, j)]


def stars_of(leaders: DataFrame) -> DataFrame:
    """(x, y, second, cid): a group of at most STAR classes as a tile with itself (x = y), a larger one as tiles of its heads (the leader, and about HEADS classes picked by hash) and STAR or so of its classes."""
    groups = leaders.groupBy("lead").agg(F.count("*").alias("m"), F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    sized = leaders.join(groups, "lead")
    members = sized.select("lead", "parts", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), (F.col("parts") > 1).alias("second"), "cid")
    picked = sized.filter((F.col("parts") > 1) & (F.pmod(F.xxhash64("cid", F.lit(1)), F.col("m")) < HEADS)).select("lead", "parts", "cid")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    heads = picked.unionByName(groups.select("lead", "parts", F.col("lead").alias("cid"))).select("lead", "parts", every, F.lit(False).alias("second"), "cid")
    return members.unionByName(heads).select(F.col("lead").alias("x"), F.when(F.col("parts") > 1, F.xxhash64("lead", "part")).otherwise(F.col("lead")).alias("y"), "second", "cid")


def crowds_of(leaders: DataFrame) -> DataFrame:
    """(lead, m): the groups of more than STAR classes."""
    return leaders.groupBy("lead").agg(F.count("*").alias("m")).filter(F.col("m") > STAR)


def rest_of(leaders: DataFrame, known: DataFrame) -> DataFrame:
    """(x, y, second, cid): of each large group the u classes outside its largest component, in tiles with about HEADS * m / u of its m classes, all if u is at most HEADS."""
    of = known.withColumnRenamed("node", "cid")
    placed = leaders.join(crowds_of(leaders), "lead").join(of, "cid", "left").select("lead", "cid", F.coalesce("component", "cid").alias("component"))
    sizes = placed.groupBy("lead", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("lead").agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("m"))
    parts = lambda n: F.ceil(n / STAR).cast("int")
    left = main.select("lead", F.col("main.component").alias("main"), (F.col("m") - F.col("main.k")).alias("u"), "m").filter("u > 0").withColumns({"left_parts": parts(F.col("u")), "head_parts": parts(F.col("m") * F.least(F.lit(1), HEADS / F.col("u")))})
    own = placed.join(left, "lead")
    part = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = own.filter("component <> main").select("lead", part("left_parts").alias("i"), every("head_parts").alias("j"), F.lit(True).alias("second"), "cid")
    heads = own.filter(F.pmod(F.xxhash64("cid", F.lit(2)), F.col("u")) < HEADS).select("lead", every("left_parts").alias("i"), part("head_parts").alias("j"), F.lit(False).alias("second"), "cid")
    return outside.unionByName(heads).select(F.col("lead").alias("x"), F.xxhash64("lead", "i", "j").alias("y"), "second", "cid")


def tiles_of(pairs: DataFrame, leaders: DataFrame) -> DataFrame:
    """(x, y, second, cid): the classes of the pairs in tiles. A block holds about TILE classes of one group (of those that agree most with one leader), and a tile the classes of two blocks that some pair asks for."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    groups = asked.join(leaders.filter("place = 0").select("cid", "lead"), "cid", "left").select("cid", F.coalesce("lead", "cid").alias("lead"))
    parts = groups.groupBy("lead").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    blocks = groups.join(parts, "lead").select("cid", F.xxhash64("lead", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("block"))
    of = lambda c: blocks.select(F.col("cid").alias(c), F.col("block").alias(f"block_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    x, y = F.least("block_a", "block_b"), F.greatest("block_a", "block_b")
    ends = F.explode(F.array(*(F.struct((F.col(f"block_{c}") != x).alias("second"), F.col(c).alias("cid")) for c in "ab"))).alias("end")
    return both.select(x.alias("x"), y.alias("y"), ends).select("x", "y", "end.second", "end.cid").distinct()


def sieve_of(bits: DataFrame) -> np.ndarray:
    """A table of 2**SIEVE_BITS bits, of which those of the rows (bit long) are set; of fixed size."""
    span = (1 << SIEVE_BITS) // PARTS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = np.divmod(b.column(0).to_numpy(), span)
            for p in np.unique(part).tolist():
                held.setdefault(p, np.zeros(span, dtype=bool))[at[part == p]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    total = np.zeros((PARTS, span // 8), dtype=np.uint8)
    for part, own in bits.distinct().repartition(PARTS, (F.col("bit") / span).cast("int")).mapInArrow(fill, "part int, bits binary").collect():
        total[part] = np.frombuffer(own, dtype=np.uint8)
    return total.ravel()


def sieved(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """The texts that are those of placed's classes, and a few others: what is left out is never shuffled."""
    bit = lambda h, r: F.pmod(F.xxhash64(h, r), F.lit(1 << SIEVE_BITS))
    shared = texts.sparkSession.sparkContext.broadcast(sieve_of(placed.select(bit("rep_hash", "rep_row").alias("bit"))))

    def held(bits: pa.Array) -> pa.Array:
        at = bits.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return texts.filter(F.arrow_udf(held, "boolean")(bit("text_hash", "row")))


def links(texts: DataFrame, classes: DataFrame, wanted: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): the links within the tiles (x, y, second, cid), thinned to what connects. Each text is fetched by one join for all of its tiles."""
    placed = cut(wanted.join(classes.select("cid", "rep_row", "rep_hash"), "cid"))
    asked = sieved(texts.select("text_hash", "row", "text"), placed)
    met = asked.join(placed, (asked["text_hash"] == placed["rep_hash"]) & (asked["row"] == placed["rep_row"])).select("x", "y", "second", "cid", "text")
    ordered = met.repartition("x", "y").sortWithinPartitions("x", "y", "second", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cids, halves = None, [], ([], [])

        def tile() -> pa.RecordBatch:
            x, y = halves
            edges = tile_edges(x, y or None, num, den) if x and (y or at[0] == at[1]) and len(cids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([cids[i] for i, _ in edges], pa.int64()), pa.array([cids[j] for _, j in edges], pa.int64())], ["a", "b"])

        for b in sliced(batches):
            own = (b.column(i).to_pylist() for i in range(4))
            for x, y, second, cid, text in zip(*own, b.column(4), strict=True):
                if (x, y) != at:
                    if at:
                        yield tile()
                    at, cids, halves = (x, y), [], ([], [])
                cids.append(cid)
                halves[second].append(shingle_set(text.as_buffer().to_pybytes(), words))
        if at:
            yield tile()

    return ordered.mapInArrow(run, "a long, b long")


def added(found: list[Rows]) -> Rows:
    """One row per pair: (a, b, size and greatest position of either, overlap counted so far)."""
    a, b, size_a, size_b, pos_a, pos_b, n = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    most = lambda x: np.maximum.reduceat(x[order], first)
    return a[first], b[first], size_a[order][first], size_b[order][first], most(pos_a), most(pos_b), np.add.reduceat(n[order], first)


class Sums:
    """The overlap counts of a task's pairs, added up over its columns before they are shuffled; at most about MOST_SUMS pairs are held."""

    def __init__(self) -> None:
        self.found: list[Rows] = []
        self.n = 0

    def add(self, found: Rows) -> Iterator[Rows]:
        self.found.append(found)
        self.n += len(found[0])
        if self.n > MOST_SUMS:
            self.found = [added(self.found)]
            self.n = len(self.found[0][0])
            if 2 * self.n > MOST_SUMS:
                yield from self.rest()

    def rest(self) -> Iterator[Rows]:
        if self.found:
            yield added(self.found)
        self.found, self.n = [], 0


def marks_of(s: np.ndarray) -> bytes:
    """Of how many shingles of a set fall to each of MARKS numbers, whether it is odd."""
    return np.packbits(np.bincount((s & np.uint64(MARKS - 1)).astype(np.int64), minlength=MARKS) & 1).tobytes()


def marks_array(marks: list[bytes | None]) -> np.ndarray:
    out = np.zeros((len(marks), MARKS // 64), dtype=np.uint64)
    given = [i for i, x in enumerate(marks) if x is not None]
    out[given] = np.frombuffer(b"".join(marks[i] for i in given), dtype=np.uint64).reshape(-1, MARKS // 64)
    return out


def unlike(marks: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least size of the difference of the sets of rows x and y: a shingle changes one parity. 0 where parities aren't at hand."""
    given = marks.any(axis=1)
    out = np.zeros(len(x), dtype=np.int64)
    both = np.flatnonzero(given[x] & given[y])
    for at in range(0, len(both), COMPARED):
        some = both[at : at + COMPARED]
        out[some] = np.bitwise_count(marks[x[some]] ^ marks[y[some]]).sum(axis=1, dtype=np.int64)
    return out


def met_rows(own: Rows, x: np.ndarray, y: np.ndarray, num: int, den: int) -> Rows | None:
    """(a, b, size and position of either, 1) of the pairs of rows x and y that may link."""
    cid, comp, size, pos, *marks = own
    most = np.minimum(size[x] - pos[x], size[y] - pos[y])
    ok = (comp[x] != comp[y]) & (most >= least_overlap(size[x], size[y], num, den))
    x, y = x[ok], y[ok]
    if marks:
        ok = (size[x] + size[y] - unlike(marks[0], x, y)) // 2 >= least_overlap(size[x], size[y], num, den)
        x, y = x[ok], y[ok]
    if not len(x):
        return None
    x, y = np.where(cid[x] > cid[y], y, x), np.where(cid[x] > cid[y], x, y)
    return cid[x], cid[y], size[x], size[y], pos[x], pos[y], np.ones(len(x), dtype=np.int64)


def columns_product(token: np.ndarray, own: Rows, num: int, den: int) -> Iterator[Rows]:
    """The pairs that whole columns make, rows being sorted by token and size."""
    edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    count = np.diff(np.r_[edge, len(token)])
    two = edge[count == 2]
    if len(two) and (found := met_rows(own, two, two + 1, num, den)):
        yield found
    for begin, m in zip(edge[count > 2].tolist(), count[count > 2].tolist(), strict=True):
        column = np.arange(begin, begin + m)
        if (own[1][column] != own[1][begin]).any() and (found := met_rows(own, *(column[i] for i in np.triu_indices(m, 1)), num, den)):
            yield found


def between(spans: list[tuple[int, int, int | None]], num: int, den: int) -> Iterator[tuple[int, int]]:
    """The pairs of a column's runs, (least size, greatest size, their component if it is one) in order of size, that may hold a link."""
    for i, (_, high, c) in enumerate(spans):
        for j in range(i, len(spans)):
            low, _, d = spans[j]
            if low * num > high * den:
                break
            if c is None or c != d:
                yield i, j


def blocks_between(spans: list[tuple[int, int, int | None]], num: int, den: int) -> list[tuple[int, int]]:
    return list(between(spans, num, den))


def product_pairs(texts: DataFrame, classes: DataFrame, known: DataFrame, leaders: DataFrame, counts: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """(a, b): the pairs of classes of different components (known: node, component) that the product can't discard."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out, marks = [], []
            for text in b.column(2):
                s = shingle_set(text.as_buffer().to_pybytes(), words)
                rare = s[np.lexsort((s, shared.value[s >> np.uint64(64 - BUCKET_BITS)]))] if len(s) else s
                out.append(rare[: prefix_size(len(s), num, den)].view(np.int64) if len(s) else None)
                marks.append(marks_of(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["row", "text_hash", "first", "marks"])

    made = texts.select("row", "text_hash", "text").mapInArrow(prefixes, "row long, text_hash long, first array<long>, marks binary").filter("first is not null")
    crowded = leaders.join(crowds_of(leaders), "lead").select("cid", F.lit(True).alias("crowded")).distinct()
    own = known.withColumnRenamed("node", "cid")
    placed = classes.select("cid", "n", "rep_row", "rep_hash").join(own, "cid", "left").join(crowded, "cid", "left").select("cid", "n", "rep_row", "rep_hash", F.coalesce("component", "cid").alias("comp"), "crowded")
    rows = made.join(placed, (made["text_hash"] == placed["rep_hash"]) & (made["row"] == placed["rep_row"]))
    incidence = rows.select("cid", "comp", F.col("n").alias("size"), F.when(F.col("crowded"), F.col("marks")).alias("marks"), F.posexplode("first").alias("pos", "token"))
    columns = incidence.select("token", "cid", "comp", F.col("size").cast("int").alias("size"), "pos", "marks").repartition("token").sortWithinPartitions("token", "size")
    names = ["kind", "a", "b", "c", "d", "e", "f", "n", "marks"]

    def batch(kind: int, columns: tuple, marks: np.ndarray | None = None) -> pa.RecordBatch:
        m = len(columns[0])
        if len(columns) < len(names) - 2:
            columns = (*columns, np.zeros(m))
        own = pa.nulls(m, pa.binary()) if marks is None else pa.array([x.tobytes() if x.any() else None for x in marks], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, dtype=np.int32)), *(pa.array(np.asarray(c, dtype=np.int64)) for c in columns), own], names)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (kind 0); of columns of more than COLUMN rows the rows by run (kind 1) and the blocks that each run is in (kind 2)."""
        held: Rows | None = None
        hot, spans = None, []
        sums = Sums()

        def run_out(run: Rows) -> pa.RecordBatch:
            token, cid, comp, size, pos, marks = run
            place = len(spans)
            spans.append((int(size[0]), int(size[-1]), int(comp[0]) if (comp == comp[0]).all() else None))
            return batch(1, (token, cid, comp, size, pos, np.full(len(cid), place)), marks)

        def settled(own: Rows) -> Iterator[pa.RecordBatch]:
            """Rows of whole columns, of which the first may be the rest of the hot one."""
            nonlocal hot, spans
            if hot is not None:
                n = int(np.searchsorted(own[0], hot, side="right"))
                if n:
                    yield run_out(tuple(c[:n] for c in own))
                own = tuple(c[n:] for c in own)
                pairs = between(spans, num, den)
                while some := list(islice(pairs, 1 << 15)):
                    yield batch(2, tuple(zip(*((hot, run, x, y, 0, 0) for x, y in some for run in {x, y}), strict=True)))
                hot, spans = None, []
            for found in columns_product(own[0], own[1:], num, den) if len(own[0]) else ():
                yield from (batch(0, x) for x in sums.add(found))

        for b in sliced(batches):
            own = (*(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:5]), marks_array(b.column(5).to_pylist()))
            if held is not None:
                own = tuple(np.concatenate(x) for x in zip(held, own, strict=True))
            if not len(own[0]):
                continue
            if hot is not None and own[0][-1] != hot or hot is None and own[0][0] != own[0][-1]:
                last = int(np.searchsorted(own[0], own[0][-1]))
                yield from settled(tuple(c[:last] for c in own))
                own = tuple(c[last:] for c in own)
            while len(own[0]) > COLUMN:
                hot = int(own[0][0])
                yield run_out(tuple(c[:COLUMN] for c in own))
                own = tuple(c[COLUMN:] for c in own)
            held = own
        if held is not None:
            yield from settled(held)
        yield from (batch(0, x) for x in sums.rest())

    def multiply_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        sums = Sums()

        def block() -> Iterator[pa.RecordBatch]:
            *rows, marks = zip(*held, strict=True)
            *own, second = (np.array(c, dtype=np.int64) for c in rows)
            x, y = np.flatnonzero(second == 0), np.flatnonzero(second)
            pairs = (x[i] for i in np.triu_indices(len(x), 1)) if at[1] == at[2] else (np.repeat(x, len(y)), np.tile(y, len(x)))
            if found := met_rows((*own, marks_array(marks)), *pairs, num, den):
                yield from (batch(0, x) for x in sums.add(found))

        for b in sliced(batches):
            for token, x, y, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (token, x, y) != at:
                    if held:
                        yield from block()
                    at, held = (token, x, y), []
                held.append(row)
        if held:
            yield from block()
        yield from (batch(0, x) for x in sums.rest())

    schema = "kind int, a long, b long, c long, d long, e long, f long, n long, marks binary"
    first = cut(columns.mapInArrow(multiply, schema))
    runs = first.filter("kind = 1").toDF("kind", "token", "cid", "comp", "size", "pos", "run", "n", "marks").drop("kind", "n")
    ends = first.filter("kind = 2").toDF("kind", "token", "run", "x", "y", "e", "f", "n", "marks").select("token", "run", "x", "y")
    blocks = runs.join(ends, ["token", "run"]).select("token", "x", "y", "cid", "comp", "size", "pos", F.when(F.col("run") != F.col("x"), 1).otherwise(0).cast("long").alias("second"), "marks")
    second = blocks.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(multiply_blocks, schema)
    met = first.filter("kind = 0").unionByName(second).drop("marks").toDF("kind", "a", "b", "size_a", "size_b", "pos_a", "pos_b", "n")
    total = met.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("shared"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"))
    most = F.col("shared") + F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) - 1
    return total.filter(most * (num + den) >= (F.col("size_a") + F.col("size_b")) * num).select("a", "b")


def ngram_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, row, n_shingles, component_id, kept) of every row.

    component_id is the least doc_id of the component; kept marks the one row that stands for it. row is row_of() of the rows' file, so that docs that are read
    from files can be joined to the result.
    """
    docs = filed(docs)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), row_of(docs).alias("row")).withColumn("text_hash", F.xxhash64("text"))
    profile = cut(profiles(texts.select("doc_id", "text_hash", "row", "text"), words))
    rows = profile.filter("part is null").select("doc_id", "text_hash", "row", "n", "set_key", "mins")
    filled = rows.filter("n > 0")
    order = lambda i, h, r: F.struct(F.col(i).isNull().alias("none"), F.col(i).alias("id"), F.col(h).alias("hash"), F.col(r).alias("row"))
    grouped = filled.groupBy("set_key", "n", "mins").agg(F.min(order("doc_id", "text_hash", "row")).alias("rep"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("cid"), "set_key", "n", "mins", F.col("rep.id").alias("rep_id"), F.col("rep.hash").alias("rep_hash"), F.col("rep.row").alias("rep_row")))
    counts = summed_counts(profile)
    leaders = leaders_of(classes)
    known = components(links(texts, classes, stars_of(leaders), words, num, den))
    rest = cut(rest_of(leaders, known))
    if not rest.isEmpty():
        known = components(known.toDF("a", "b").unionByName(links(texts, classes, rest, words, num, den)))
    across = cut(product_pairs(texts, classes, known, leaders, counts, words, num, den))
    linked = components(known.toDF("a", "b").unionByName(links(texts, classes, tiles_of(across, leaders), words, num, den)))
    placed = classes.join(linked.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    heads = placed.groupBy("component").agg(F.min(order("rep_id", "rep_hash", "rep_row")).alias("head"))
    known = placed.join(heads, "component").select("set_key", F.col("head.id").alias("head_id"), F.col("head.hash").alias("head_hash"), F.col("head.row").alias("head_row"))
    own = (F.col("row") == F.col("head_row")) & (F.col("text_hash") == F.col("head_hash"))
    out = rows.join(known, "set_key", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", "text_hash", "row", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("head_id")).alias("component_id"), (alone | F.coalesce(own, F.lit(False))).alias("kept"))
