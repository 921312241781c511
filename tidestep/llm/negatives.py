"""Hard-negative mining by a GNAT-style multiway hyperplane tree.

A vector's components become whole numbers, floor(256 * x), and two rows are as near as their inner product is high. With one more component,
sqrt(M - |x|^2) for rows (M: the greatest squared length) and 0 for anchors, an inner product s is a distance: d^2 = |a|^2 + M - 2 s. So a window
of scores around an anchor is an annulus, and the triangle inequality holds.

The tree's nodes have up to FAN split points. A row belongs to its nearest split point (the cells are bounded by hyperplanes), and each split point
stores the least and greatest distance to the rows of each sibling cell. A row x of a cell with distance to the anchor in [lo, hi] has a
distance to split point p in [max(d - hi, lo - d), d + hi], where d is the anchor's to p; a cell whose range at any split point
misses that is eliminated. Leaves are scanned exactly, so eliminating changes no result. The distances have room for rounding.

The first node spans the whole table: ROOT split points from a bounded sample, ranges from one pass over all rows. Rows are dealt by its cells;
a cell of many rows is split into blocks in turns, so a cell of a third of all rows is many tasks. Each block builds the further nodes of its rows.
Anchors go to the blocks of the cells that aren't eliminated. An anchor's positives are sought first: the score of its fifth best row of the same label
in the sample bounds the annulus. Then each pair of anchor and positive seeks its window among the rows of other labels. As results are found, a query's lower
bound rises to its fifth score. A block hands on five rows a query. On vectors without structure, whose distances are all alike, few cells are eliminated.

Broadcast: the sample (SAMPLE rows at most), ROOT * ROOT ranges and block counts.

Defined cases: rows with a null label, a null vector, null or non-finite components, or no id take no part; vectors of unequal length count as filled up with
zeros; of rows of one id the one with the least vector (then label) is the anchor, and none of them is a result of it, while to others each is; equal
scores go by id; a positive of negative score has no window; empty tables give no row; other columns aren't read. Results are exact as long as
inner products fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestep.llm.blocks import block_count, dealt, finite, first, numbers, searched
from tidestep.llm.common import session_of
from tidestep.storage import cut

ROOT, FAN, LEAF = 32, 8, 64
#: Rows of the sample, of a block, and queries that walk a tree together.
SAMPLE, BLOCK, TOGETHER = 4096, 16384, 1024
#: Bounds of a score that is still open.
LOW, HIGH = -(1 << 62), 1 << 62
#: Room for rounding, of the greatest length that a distance is made from: a square is off by some 1e-13 of its parts, so its root by less than this.
SLACK = 2e-6


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows."""
    if not len(a) or not len(b) or a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that makes all of them equally long."""
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


def spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """The places of at most n different rows, each far from those before it."""
    chosen = [0]
    near = distances(x, x[:1])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
        near[chosen] = 0
    return np.array(chosen)


def ranges(far: np.ndarray, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) distance from split point i to the rows of cell j, from the distances (rows x points)."""
    low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
    for j in np.unique(cell):
        low[:, j], high[:, j] = far[cell == j].min(axis=0), far[cell == j].max(axis=0)
    return low, high


def annulus(own: np.ndarray, top: float, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inner, outer) distance of the rows whose scores lie within [lo, hi]."""
    base = (own * own).sum(axis=1) + top
    room = SLACK * (np.sqrt(base) + 1)
    return np.maximum(np.sqrt(np.maximum(base - 2.0 * hi, 0)) - room, 0), np.sqrt(np.maximum(base - 2.0 * lo, 0)) + room


def survivors(to_points: np.ndarray, inner: np.ndarray, outer: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(query x cell): not eliminated by any split point's range."""
    least, most = np.maximum(to_points - outer[:, None], inner[:, None] - to_points), to_points + outer[:, None]
    return ((low[None] <= most[:, :, None]) & (high[None] >= least[:, :, None])).all(axis=1)


class Search:
    """Queries' vectors, labels and windows, and the best rows of each so far."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, labels: np.ndarray, same: bool, lo: np.ndarray, hi: np.ndarray, most: int) -> None:
        self.ids, self.own, self.labels, self.same, self.lo, self.hi, self.most = ids, own, labels, same, lo.copy(), hi, most
        self.flat = np.concatenate([own, np.zeros((len(own), 1))], axis=1)
        self.score, self.row = np.full((len(ids), most), LOW), np.full((len(ids), most), HIGH)

    def offer(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        for begin in range(0, len(ids), 4096):
            part = slice(begin, begin + 4096)
            score = products(self.own[who], vectors[part])
            ok = ((labels[part][None, :] == self.labels[who][:, None]) == self.same) & (ids[part][None, :] != self.ids[who][:, None])
            ok &= (score >= self.lo[who][:, None]) & (score <= self.hi[who][:, None])
            hit = ok.any(axis=1)
            if not hit.any():
                continue
            won = who[hit]
            score = np.concatenate([self.score[won], np.where(ok[hit], score[hit], LOW)], axis=1)
            row = np.concatenate([self.row[won], np.where(ok[hit], np.broadcast_to(ids[part], ok[hit].shape), HIGH)], axis=1)
            order = np.lexsort((row, -score), axis=1)[:, : self.most]
            self.score[won], self.row[won] = np.take_along_axis(score, order, 1), np.take_along_axis(row, order, 1)
            self.lo[won] = np.maximum(self.lo[won], self.score[won, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, row's id, score)."""
        q, k = np.nonzero(self.row < HIGH)
        return q, self.row[q, k], self.score[q, k]


class Tree:
    """A block's rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, top: float) -> None:
        self.ids, self.vectors, self.labels, self.top = ids, vectors, labels, top
        self.up = lifted(vectors, top)
        self.root = self.node(np.arange(len(ids)))

    def node(self, rows: np.ndarray):
        """The rows themselves, or (split points, ranges, labels of each cell, cells)."""
        if len(rows) <= LEAF:
            return rows
        seen = rows[:: max(1, len(rows) // (16 * FAN))]
        points = self.up[seen[spread_out(self.up[seen], FAN)]]
        far = distances(self.up[rows], points)
        cell = far.argmin(axis=1)
        parts = [rows[cell == j] for j in range(len(points))]
        if max(len(p) for p in parts) == len(rows):  # all alike
            return rows
        return points, *ranges(far, cell, len(points)), [np.unique(self.labels[p]) for p in parts], [self.node(p) for p in parts]

    def walk(self, search: Search, who: np.ndarray, node=None) -> None:
        node = self.root if node is None else node
        if isinstance(node, np.ndarray):
            search.offer(who, self.ids[node], self.vectors[node], self.labels[node])
            return
        points, low, high, labels, cells = node
        to_points = distances(search.flat[who], points)
        for j in np.argsort(to_points.sum(axis=0)):
            open_ = np.isin(search.labels[who], labels[j]) if search.same else np.ones(len(who), dtype=bool) if len(labels[j]) != 1 else search.labels[who] != labels[j]
            inner, outer = annulus(search.own[who], self.top, search.lo[who], search.hi[who])
            open_ &= survivors(to_points, inner, outer, low[:, [j]], high[:, [j]])[:, 0]
            if open_.any():
                self.walk(search, who[open_], cells[j])


class Root:
    """The first node: split points, ranges over all rows, and each cell's blocks."""

    def __init__(self, sample: tuple[np.ndarray, np.ndarray, np.ndarray], top: float) -> None:
        self.sample, self.top = sample, top
        up = lifted(sample[1], top)
        self.points = up[spread_out(up, ROOT)]
        self.low = self.high = self.begin = self.blocks = None

    def cell(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = distances(lifted(vectors, self.top), self.points)
        return far, far.argmin(axis=1)

    def open(self, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        flat = np.concatenate([own, np.zeros((len(own), 1))], axis=1)
        return survivors(distances(flat, self.points), *annulus(own, self.top, lo, hi), self.low, self.high)


def hard_negatives(rows: DataFrame, anchor_divisor: int = 100, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, v): least * positive score <= 100 * negative score <= 100 * positive score."""
    spark = session_of(rows)
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v"))).select("id", "label", "v")
    quantised = F.transform("v", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    square = F.aggregate(quantised, F.lit(0.0), lambda s, x: s + x * x)
    n, width, top = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    held = lambda b: (b.column(0).to_numpy(), whole(numbers(b.column(2), width)), b.column(1).to_numpy())  # noqa: E731  ids, vectors, labels
    sampled = rows.orderBy(F.xxhash64("id"), "id", "v", "label").limit(SAMPLE).toArrow().combine_chunks().to_batches()[0]
    root = Root(held(sampled), top)
    parts = len(root.points)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = np.full((parts, parts), np.inf), np.full((parts, parts), -np.inf), np.zeros(parts, dtype=np.int64)
        for b in batches:
            far, cell = root.cell(held(b)[1])
            own = ranges(far, cell, parts)
            low, high, count = np.minimum(low, own[0]), np.maximum(high, own[1]), count + np.bincount(cell, minlength=parts)
        i, j = (x.ravel() for x in np.indices((parts, parts)))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(low.ravel()), pa.array(high.ravel()), pa.array(count[j])], ["i", "j", "low", "high", "n"])

    told = rows.mapInArrow(measure, "i int, j int, low double, high double, n long").groupBy("i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()  # ROOT * ROOT rows
    root.low, root.high, counts = np.full((parts, parts), np.inf), np.full((parts, parts), -np.inf), np.zeros(parts, dtype=np.int64)
    for r in told:
        root.low[r.i, r.j], root.high[r.i, r.j], counts[r.j] = r.low, r.high, r.n
    most = max(1, min(BLOCK, -(-n // block_count(spark, n, BLOCK))))
    root.blocks = np.maximum(-(-counts // most), 1)
    root.begin = np.cumsum(root.blocks) - root.blocks
    blocks = int(root.blocks.sum())
    shared = spark.sparkContext.broadcast(root)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In each cell the rows are dealt in turns."""
        for b in batches:
            cell = shared.value.cell(held(b)[1])[1]
            block = shared.value.begin[cell] + b.column(3).to_numpy() % shared.value.blocks[cell]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(block, pa.int32())], ["id", "label", "v", "block"])

    vector = dict(rows.dtypes)["v"]
    placed = rows.withColumn("turn", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))).mapInArrow(place, f"id long, label long, v {vector}, block int")

    def routed(asked: DataFrame, same: bool) -> DataFrame:
        """The queries (id, label, v, lo, hi and more) at each block that may hold a result."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, own, labels = held(b)
                lo, hi = b.column(3).to_numpy().copy(), b.column(4).to_numpy()
                if same:  # the sample's rows are rows, so what is found among them bounds the result
                    near = Search(ids, own, labels, True, lo, hi, positives)
                    for at in range(0, len(ids), TOGETHER):
                        near.offer(np.arange(at, min(at + TOGETHER, len(ids))), *shared.value.sample)
                    lo = near.lo
                q, cell = np.nonzero(shared.value.open(own, lo, hi))
                count = shared.value.blocks[cell]
                block = np.repeat(shared.value.begin[cell], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                q = np.repeat(q, count)
                for at in range(0, len(q), TOGETHER):
                    take = pa.array(q[at : at + TOGETHER])
                    own_lo = pa.array(lo[q[at : at + TOGETHER]])
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), own_lo, *(b.column(i).take(take) for i in range(4, b.num_columns)), pa.array(block[at : at + TOGETHER], pa.int32())], [*b.schema.names, "block"])

        return asked.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*asked.dtypes, ("block", "int")]))

    def prepare(own: pa.RecordBatch) -> Tree:
        return Tree(*held(own), shared.value.top)

    def seek(same: bool, keep: int):
        def run(tree: Tree, own: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, own.num_rows, TOGETHER):
                b = own.slice(at, TOGETHER)
                ids, vectors, labels = held(b)
                search = Search(ids, vectors, labels, same, b.column(3).to_numpy(), b.column(4).to_numpy(), keep)
                tree.walk(search, np.arange(len(ids)))
                q, row, score = search.found()
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), b.column(5).take(pa.array(q)), b.column(4).take(pa.array(q)), pa.array(row), pa.array(score)], ["anchor", "place", "asked", "row", "score"])

        return run

    found = "anchor long, place int, asked long, row long, score long"
    by_score: list[Column] = [F.col("score").desc(), F.col("row")]
    anchors = rows.filter(F.col("id") % anchor_divisor == 0).groupBy("id").agg(F.min(F.struct("v", "label")).alias("own")).select("id", "own.label", "own.v")
    bounds = lambda lo, hi, at: (lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), at.cast("int").alias("at"))
    near = searched(placed, routed(anchors.select("*", *bounds(F.lit(LOW), F.lit(HIGH), F.lit(0))), True), blocks, prepare, seek(True, positives), found)
    best = cut(first(near, ["anchor"], by_score, positives).select(F.col("anchor").alias("id"), F.col("row").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")))
    lo = F.ceil(F.lit(least) * F.col("positive_score").cast("decimal(38,0)") / 100)
    pairs = best.filter("positive_score >= 0").join(anchors, "id").select("id", "label", "v", *bounds(lo, F.col("positive_score"), F.col("place")), "positive_id")
    asked = routed(pairs.select("id", "label", "v", "lo", "hi", "at"), False)
    hard = first(searched(placed, asked, blocks, prepare, seek(False, negatives), found), ["anchor", "place"], by_score, negatives)
    out = hard.join(best.select(F.col("id").alias("anchor"), "place", "positive_id"), ["anchor", "place"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("row").alias("negative_id"), F.col("asked").alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, label, v) for hard_negatives; every seventh id gets the next label."""
    row, label = vectors[id_col].cast("long"), vectors[label_col].cast("long")
    return vectors.select(row.alias("id"), F.when(row % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), vectors[vector_col].alias("v"))
