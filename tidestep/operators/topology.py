"""Topological order of a graph given as rows, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.storage import cut, observed

#: Nodes of a block: two to this power.
BLOCK_BITS = 17


class Cycle(ValueError):
    """Nodes remain that wait for each other."""


def let_go(least: np.ndarray, open_outside: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gone, level) of a block's nodes: those go whose predecessors outside have gone and whose predecessors inside go as well. A level is least
    so far, and one more than that of each predecessor that has gone.
    """
    n, level = len(least), least.copy()
    order = np.argsort(before, kind="stable")
    successors = after[order]
    begin = np.searchsorted(before[order], np.arange(n + 1))
    waits = np.bincount(after, minlength=n) + open_outside
    gone = np.zeros(n, dtype=bool)
    front = np.flatnonzero(waits == 0)
    while len(front):
        gone[front] = True
        counts = begin[front + 1] - begin[front]
        at = np.repeat(begin[front] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        met = successors[at]
        np.maximum.at(level, met, np.repeat(level[front] + 1, counts))
        np.subtract.at(waits, met, 1)
        front = np.unique(met[waits[met] == 0])
    return gone, level


def levels(nodes: DataFrame, edges: DataFrame, key: str, before: str = "before", after: str = "after", near: str | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(key, level): 0 for a node without predecessors, else one more than the greatest level of these; edges to or from unknown nodes don't count.

    Nodes are dealt in blocks of a bounded number by `near` (a column of nodes; nodes that edges join should have it alike) and key. In a round each block lets go all
    nodes that wait for nothing outside of it, level after level; what has gone is told along the edges between blocks. So rounds are at most as many as levels,
    and no more than the blocks that a path comes through. A cycle raises Cycle.
    """
    known = nodes.groupBy(key).agg(F.min(near).alias("near")) if near else nodes.select(key, F.lit(0).alias("near")).distinct()
    # a place within its partition tells the block
    placed = cut(known.filter(F.col(key).isNotNull()).repartitionByRange("near", key).sortWithinPartitions("near", key))
    place = F.monotonically_increasing_id()
    waiting = cut(placed.select(F.col(key).alias("node"), F.shiftright(place, block_bits).alias("block"), place.bitwiseAND(F.lit((1 << block_bits) - 1)).cast("int").alias("slot")))
    of = lambda end: waiting.select(F.col("node").alias(end), F.col("block").alias(f"block_{end}"), F.col("slot").alias(f"slot_{end}"))
    links = cut(edges.select(F.col(before).alias("a"), F.col(after).alias("b")).distinct().join(of("a"), "a").join(of("b"), "b"))
    inside = links.filter("block_a = block_b").select(F.col("block_a").alias("block"), F.col("slot_a").alias("slot"), F.col("slot_b").alias("to"))
    across = links.filter("block_a <> block_b").select("a", "b")
    outside = across.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("open"))
    waiting = waiting.join(outside, "node", "left").select("node", "block", "slot", F.coalesce("open", F.lit(0)).cast("long").alias("open"), F.lit(0).cast("long").alias("level"))

    def step(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("slot", ignore_index=True)
        slots = own["slot"].to_numpy()
        a, b = held["slot"].to_numpy(), held["to"].to_numpy()
        # the edges of nodes that have gone in earlier rounds are counted already
        left = np.isin(a, slots)
        own["gone"], own["level"] = let_go(own["level"].to_numpy(), own["open"].to_numpy(), np.searchsorted(slots, a[left]), np.searchsorted(slots, b[left]))
        return own

    schema = f"node {dict(nodes.dtypes)[key]}, block long, slot int, open long, level long, gone boolean"
    done: DataFrame | None = None
    while True:
        met = waiting.groupBy("block").cogroup(inside.groupBy("block")).applyInPandas(step, schema)
        met, seen = observed(met, n=F.count("*"), gone=F.count_if("gone"))
        if seen["n"] and not seen["gone"]:
            raise Cycle(f"{seen['n']} nodes wait for each other")
        gone = met.filter("gone").select("node", "level")
        done = gone if done is None else done.unionByName(gone)
        if seen["n"] == seen["gone"]:
            break
        told = across.join(gone.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("told"), (F.max("level") + 1).alias("least"))
        waiting = met.filter("NOT gone").join(told, "node", "left").select("node", "block", "slot", (F.col("open") - F.coalesce("told", F.lit(0))).alias("open"), F.greatest("level", "least").alias("level"))
    # a node without a key has no edges
    return done.unionByName(known.filter(F.col(key).isNull()).select(F.col(key).alias("node"), F.lit(0).cast("long").alias("level"))).select(F.col("node").alias(key), "level")
