"""Step numbers, counters and running clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestep.storage import cut


def global_steps(df: DataFrame, *order: str, name: str = "step") -> DataFrame:
    """Numbers all rows from 0 in a total order without gathering them in one task.

    Rows are range-partitioned and sorted, the sorted rows are written once, and only the row counts of the partitions
    (one number each) come to the driver, to be added up as offsets.
    """
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    counts = dict(sorted_.groupBy(F.spark_partition_id().alias("p")).count().collect())
    offsets, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(at)
        at += counts.get(p, 0)
    if not offsets:
        return sorted_.withColumn(name, F.lit(0).cast("long"))
    table = F.array(*(F.lit(x) for x in offsets)).cast("array<bigint>")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.withColumn(name, table[F.spark_partition_id()] + inside)


def per_key(key: str | list[str], *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def counter(key: str, *order: str) -> Column:
    """How often a key has been seen, itself included: a local that lasts between calls."""
    return F.row_number().over(per_key(key, *order)).cast("long")


def clock(key: str, value: Column, *order: str) -> tuple[Column, Column]:
    """(step, time): steps from 0 and the running sum of the value, in the precision of its type."""
    w = per_key(key, *order)
    return (F.row_number().over(w) - 1).cast("long"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double")


def every(df: DataFrame, step: str, n: int) -> DataFrame:
    """Rows of steps 0, n, 2n ...; none for n = 0."""
    return df.filter(F.col(step) % n == 0) if n > 0 else df.limit(0)


def substeps(df: DataFrame, n: int, name: str = "sub") -> DataFrame:
    """Each row n times, numbered from 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))


def stop_after(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows, one at least: the outer iteration is counted after its body."""
    return df.orderBy(*order).limit(max(n, 1))


def in_stage_steps(df: DataFrame, stages: DataFrame, step: str = "step") -> DataFrame:
    """Joins each step to the stage that occupies it, by an interval search: a run may have any number of stages."""
    from tidestep.operators.scan import in_intervals

    end = unused(stages, "end")
    return in_intervals(df, stages.withColumn(end, F.col("lo") + F.col("occupied")), step, "lo", end).drop(end)
