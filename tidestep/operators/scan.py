"""Running values within keys by a segmented prefix scan, and what is made of it: as-of joins and the search of intervals.

A window by key puts a key into one task. Here rows are range-partitioned by key and order, sorted and written once; pieces of PIECE
rows are then the unit. Each (key, piece) gives a summary (rows, sums, last values), an exclusive scan of a key's summaries gives what each
piece starts with, and a window within the piece adds its own rows to that. So a key of all rows is as many tasks as any other,
and what meets by key is one row a piece.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestep.operators.steps import unused
from tidestep.storage import cut

#: Rows of a piece: two to this power.
PIECE_BITS = 15
#: Intervals that are searched by bisection in each task (two numbers each); more are found by an as-of scan.
MOST_INTERVALS = 1 << 17


def prefix_scan(
    df: DataFrame,
    key: str | list[str],
    order: list[str],
    *,
    count: str | None = None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    piece_bits: int = PIECE_BITS,
) -> DataFrame:
    """Adds to each row, over its key's rows up to it in the order: count (from 1), sums (null values count as nothing), the last value that isn't null
    (each with the row itself), and the value of the row just before, null for the first.

    Null keys are one key; rows of equal order are put in some order, the same for all results. Sums are made in the precision of their type.
    """
    keys = [key] if isinstance(key, str) else list(key)
    made: dict[str, tuple[str, str, Column]] = {}
    for kind, columns in (("sum", sums), ("last", lasts), ("before", before)):
        for name, column in (columns or {}).items():
            made[name] = (kind, unused(df, f"value_of_{name}"), column)
    pos, piece = unused(df, "pos"), unused(df, "piece")
    own = df.withColumns({hidden: column for _, hidden, column in made.values()})
    sorted_ = cut(own.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order))
    placed = sorted_.withColumn(pos, F.monotonically_increasing_id()).withColumn(piece, F.shiftright(pos, piece_bits))

    summary, start, local = {}, {}, {}
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(piece, *keys).orderBy(pos)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = unused(df, "rows")
    summary[rows], start[rows] = F.count("*"), F.sum(rows).over(earlier)
    if count:
        local[count] = F.row_number().over(inside) + F.coalesce(rows, F.lit(0))
    for name, (kind, hidden, _) in made.items():
        part = unused(df, f"part_of_{name}")
        value = F.col(hidden)
        if kind == "sum":
            summary[part], start[part] = F.sum(value), F.sum(part).over(earlier)
            here = F.sum(value).over(so_far)
            local[name] = F.when(here.isNull(), F.col(part)).when(F.col(part).isNull(), here).otherwise(here + F.col(part))
        elif kind == "last":
            summary[part], start[part] = F.max_by(value, F.when(value.isNotNull(), F.col(pos))), F.last(part, ignorenulls=True).over(earlier)
            local[name] = F.coalesce(F.last(value, ignorenulls=True).over(so_far), F.col(part))
        else:
            summary[part], start[part] = F.max_by(F.struct(value.alias("v")), F.col(pos)), F.last(part).over(earlier)
            local[name] = F.coalesce(F.lag(F.struct(value.alias("v"))).over(inside), F.col(part))["v"]
    pieces = placed.groupBy(*keys, piece).agg(*(c.alias(n) for n, c in summary.items()))
    carried = pieces.select(*keys, piece, *(c.alias(n) for n, c in start.items())).filter(F.col(rows).isNotNull())
    # of a piece's keys only the first can have begun before it, so the piece finds the one row
    renamed = carried.select(F.col(piece).alias(f"{piece}_"), *(F.col(k).alias(f"{k}_{piece}") for k in keys), *start)
    same = F.col(piece) == F.col(f"{piece}_")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_{piece}"))
    return placed.join(renamed, same, "left").select(*df.columns, *(c.alias(n) for n, c in local.items()))


def as_of(left: DataFrame, right: DataFrame, at: str, right_at: str, by: list[str] | None = None, delay: Column | None = None, piece_bits: int = PIECE_BITS) -> DataFrame:
    """Each left row with `seen`: the last right row (as a struct) at or before it, of the same `by`; null if there is none.

    With a delay a right row is seen so much later than it was made. Right rows without a time or left ones are never matched; of right rows
    of one time the greatest by the values of its columns is seen.
    """
    by = by or []
    time = F.col(right_at) if delay is None else F.col(right_at) + delay
    asks = left.select(*(F.col(k).alias(f"by_{i}") for i, k in enumerate(by)), F.col(at).alias("at"), F.lit(1).alias("asks"), F.struct(*left.columns).alias("own"))
    told = right.filter(F.col(right_at).isNotNull()).select(*(F.col(k).alias(f"by_{i}") for i, k in enumerate(by)), time.alias("at"), F.lit(0).alias("asks"), F.struct(*right.columns).alias("told"))
    both = asks.unionByName(told, allowMissingColumns=True).withColumn("all", F.lit(0))
    keys = [f"by_{i}" for i in range(len(by))] or ["all"]
    scanned = prefix_scan(both, keys, ["at", "asks", "told"], lasts={"seen": F.col("told")}, piece_bits=piece_bits)
    null_key = F.lit(False)
    for k in keys:
        null_key |= F.col(k).isNull()
    return scanned.filter("asks = 1").select("own.*", F.when(~null_key & F.col("at").isNotNull(), F.col("seen")).alias("seen"))


def in_intervals(df: DataFrame, intervals: DataFrame, at: str, lo: str = "lo", hi: str = "hi", most: int = MOST_INTERVALS) -> DataFrame:
    """Joins each row to the interval [lo, hi) that holds its whole number `at`; rows in none are left out. Intervals don't overlap; empty ones hold nothing.

    Up to so many intervals are looked up by bisection in the tasks, without a shuffle of the rows; more are merged with them in order.
    """
    held = intervals.filter(F.col(lo) < F.col(hi))
    few = held.select(F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi")).orderBy("lo").limit(most + 1).toPandas()
    if len(few) > most:
        found = as_of(df, held, at, lo)
        return found.filter(F.col("seen").isNotNull() & (F.col(at) < F.col(f"seen.{hi}"))).select(*df.columns, *(F.col(f"seen.{c}").alias(c) for c in held.columns))
    bounds = df.sparkSession.sparkContext.broadcast((few["lo"].to_numpy(dtype=np.int64), few["hi"].to_numpy(dtype=np.int64)))

    @F.pandas_udf("long")
    def start_of(places: pd.Series) -> pd.Series:
        low, high = bounds.value
        given = places.to_numpy(dtype=np.float64, na_value=np.nan) if places.isna().any() else places.to_numpy(dtype=np.int64)
        i = np.searchsorted(low, given, side="right") - 1
        ok = (i >= 0) & (given < high[np.maximum(i, 0)]) if len(low) else np.zeros(len(given), dtype=bool)
        return pd.Series(low[np.maximum(i, 0)] if len(low) else np.zeros(len(given), dtype=np.int64)).where(pd.Series(ok), None).astype("Int64")

    start = unused(df, "start_of")
    marked = df.withColumn(start, start_of(F.col(at).cast("long")))
    return marked.join(held, F.col(start) == F.col(lo)).drop(start)
