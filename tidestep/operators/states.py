"""State machines over rows: one machine per key, its events in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestep.operators.steps import per_key, unused


def in_state(df: DataFrame, column: str, state: str) -> DataFrame:
    return df.filter(F.col(column) == state)


def entered(df: DataFrame, key: str, column: str, state: str, *order: str) -> DataFrame:
    """The rows at which a key comes into the state from another one, or from none."""
    before = unused(df, "before")
    marked = df.withColumn(before, F.lag(column).over(per_key(key, *order)))
    return marked.filter((F.col(column) == state) & (F.col(before).isNull() | (F.col(before) != state))).drop(before)


def applied(pending: Column, start: str, key: str, *order: str) -> Column:
    """The current state before each row's own pending one is applied."""
    return F.coalesce(F.last(pending, ignorenulls=True).over(per_key(key, *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(start))


def carried(value: Column, key: str, *order: str) -> Column:
    """The last value that was said, up to and with this row."""
    return F.last(value, ignorenulls=True).over(per_key(key, *order).rowsBetween(Window.unboundedPreceding, 0))


def stage_of_entries(df: DataFrame, key: str, column: str, state: str, most: int, *order: str) -> DataFrame:
    """Adds `stage`: how often the key has entered the state so far, at most so many."""
    w = per_key(key, *order)
    name = unused(df, "changed")
    changed = F.when((F.col(column) == state) & (F.coalesce(F.lag(column).over(w), F.lit("")) != state), 1).otherwise(0)
    so_far = F.sum(name).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, changed).withColumn("stage", F.least(so_far, F.lit(most)).cast("long")).drop(name)


def islands(df: DataFrame, key: str, column: str, ident: str, *order: str) -> DataFrame:
    """(key, column, first_id, n) of each run of equal values."""
    w = per_key(key, *order)
    starts = df.withColumn("__new", F.when(F.lag(column).over(w) == F.col(column), 0).otherwise(1))
    runs = starts.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, column, "__run").agg(F.min(ident).alias("first_id"), F.count("*").alias("n")).drop("__run")


def host_syncs(df: DataFrame, key: str, kind: str, *order: str) -> DataFrame:
    """(key, syncs): host accesses that follow a device access, each of which fetches the copy."""
    fetch = unused(df, "fetch")
    marked = df.withColumn(fetch, F.when((F.col(kind) == "host") & (F.lag(kind).over(per_key(key, *order)) == "device"), 1).otherwise(0))
    return marked.groupBy(key).agg(F.sum(fetch).cast("long").alias("syncs"))


def lagged(value: Column, start: float, key: str, *order: str) -> Column:
    """What a peer sees of a value with one iteration's delay."""
    return F.lag(value, 1, start).over(per_key(key, *order))
