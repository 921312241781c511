"""A stated set of queries against all rows, in blocks.

Rows are dealt evenly over blocks, whatever their keys, and each block meets the queries that are meant for it in one task: its rows come
first and are made into an index, then the queries stream by in batches. So a task's memory is one block and one batch, however many
queries there are, and what it hands on is a bounded number of rows for each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidestep.llm.common import shuffle_parts


def block_count(spark: SparkSession, rows: int, most: int) -> int:
    """Blocks of at most about so many rows, and no fewer than the shuffle's partitions."""
    return max(shuffle_parts(spark), -(-rows // most))


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """The rows with the block that each belongs to, in turns within each partition of the scan."""
    return rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))


def for_all(queries: DataFrame, blocks: int) -> DataFrame:
    return queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def numbers(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, short ones filled up with zeros."""
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def finite(vector: Column) -> Column:
    """True for a vector of finite components alone; false, not null, else."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok, F.lit(False))


def searched(rows: DataFrame, queries: DataFrame, blocks: int, prepare: Callable[[pa.RecordBatch], Any], search: Callable[[Any, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What search(prepare(a block's rows), a batch of its queries) gives, over all blocks. Both frames have a column `block`."""
    packed = lambda df: F.struct(*(F.col(c) for c in df.columns if c != "block"))
    a = rows.select("block", F.lit(False).alias("asks"), packed(rows).alias("row"))
    b = queries.select("block", F.lit(True).alias("asks"), packed(queries).alias("query"))
    met = a.unionByName(b, allowMissingColumns=True).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            block, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if begin == end:
                    continue
                if block[begin] != at:
                    at, held, index = block[begin], [], None
                part = batch.column(3 if asks[begin] else 2).slice(begin, end - begin)
                part = pa.RecordBatch.from_arrays(part.flatten(), [f.name for f in part.type])
                if not asks[begin]:
                    held.append(part)
                elif held or index is not None:
                    if index is None:
                        index, held = prepare(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                    yield from search(index, part)

    return met.mapInArrow(run, schema)


def first(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first so many rows of each group, with their rank from 1; each task hands on no more than so many a group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)
