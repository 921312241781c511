"""Per-key state machines over streams, right for rows that arrive out of order.

A key's rows are held until the watermark has passed them, then walked in the order of time. What is held, the last row's state, the current
state, the stage, and how often each state has been entered are a key's machine. Keys are dealt in BUCKETS buckets, and the machines of a bucket are one
row of state, which comes and goes with the bucket's rows in one exchange; what an exchange costs is paid by the bucket, not by the key. A bucket's timer of
event time is set to the earliest held row, so that its keys wake when this is ripe, or to when an idle key is forgotten. Rows later than the watermark
allows are left out, as in any stream.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidestep.operators.steps import unused
from tidestep.storage import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a machine tells of each row.
TOLD = ["at", "ident", "entered", "current", "stage", "visit"]
#: Groups of keys that have one row of state.
BUCKETS = 1 << 12
Row = tuple[int, int | None, str | None]


class Machine:
    """entered: the row comes into its state from another one, or from none. current: the state that the rows before have set, of `states`,
    else `start`. stage: how often `counted` has been entered so far, at most `most`. visit: the how manieth entering of its state this is,
    or belongs to. After more than idle_ms without a row a key begins anew.
    """

    def __init__(self, key: str, start: str, states: list[str], counted: str, most: int, idle_ms: int | None = None) -> None:
        self.key, self.start, self.states, self.counted, self.most = key, start, frozenset(states), counted, most
        self.idle = None if idle_ms is None else idle_ms * 1000

    def __call__(self, bucket: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        passed = kept.getCurrentWatermarkMs()
        machines: dict = pickle.loads(kept.get[0]) if kept.exists else {}
        if not kept.hasTimedOut:
            for part in frames:
                for key, *row in zip(*(self.plain(part[c]) for c in (self.key, "at", "ident", "state")), strict=True):
                    machines.setdefault(key, (self.anew(), {}, []))[2].append(tuple(row))
        told, left, wakes = [], {}, []
        for key, (now, visits, held) in machines.items():
            held.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0))
            n = sum(r[0] <= passed * 1000 for r in held)
            rest = held[n:]
            if n:
                now, visits, own = self.walked(held[:n], now, visits)
                told += ((key, *t) for t in own)
            over = None if self.idle is None or now[0] is None else now[0] + self.idle
            if over is not None and passed * 1000 > over and not (rest and rest[0][0] <= over):
                now, visits, over = self.anew(), {}, None
            if now[0] is not None or rest:
                left[key] = (now, visits, rest)
                wakes += [-(-rest[0][0] // 1000)] if rest else []
                wakes += [over // 1000 + 1] if over is not None else []
        if left:
            kept.update((pickle.dumps(left),))
            if wakes:
                kept.setTimeoutTimestamp(max(min(wakes), passed + 1))
        else:
            kept.remove()
        if told:
            yield pd.DataFrame(told, columns=[self.key, *TOLD])

    def anew(self) -> tuple:
        return None, None, self.start, 0

    @staticmethod
    def plain(column: pd.Series) -> list:
        if not column.hasnans:
            return column.tolist()
        return [None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in column.tolist()]

    def walked(self, rows: list[Row], now: tuple, visits: dict[str, int]) -> tuple[tuple, dict[str, int], list[tuple]]:
        """What is told of the rows, and what is kept after them; between rows that are further apart than the idle time everything is forgotten."""
        before, last, current, stage = now
        told = []
        for at, ident, state in rows:
            if self.idle is not None and before is not None and at - before > self.idle:
                last, current, stage, visits = None, self.start, 0, {}
            entered = state is not None and state != last
            if entered:
                visits[state] = visits.get(state, 0) + 1
                if state == self.counted:
                    stage = min(stage + 1, self.most)
            told.append((at, ident, entered, current, stage, visits.get(state, 0)))
            if state in self.states:
                current = state
            before, last = at, state
        return (before, last, current, stage), visits, told


def machine_rows(stream: DataFrame, late: str, start: str, states: list[str], counted: str, most: int, idle_ms: int | None = None, key: str = "user_id", column: str = "event_type", ident: str = "event_id", order: str = "ts") -> DataFrame:
    """(key, at, ident, entered, current, stage, visit) of each row of a key, as soon as the watermark has passed it. Times are micros since 1970."""
    stamped = stream.select(F.col(key), F.col(column).alias("state"), F.col(ident).cast("long").alias("ident"), F.col(order).cast("timestamp").alias("stamp")).withWatermark("stamp", late)
    # one condition with the time in it, so that rows without a key still move the watermark
    rows = stamped.filter(F.when(F.col("stamp").isNull(), False).otherwise(F.col(key).isNotNull())).withColumn("at", F.unix_micros("stamp"))
    told = f"{key} {dict(stream.dtypes)[key]}, at long, ident long, entered boolean, current string, stage long, visit long"
    bucket = unused(rows, "bucket")
    return rows.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy(bucket).applyInPandasWithState(Machine(key, start, states, counted, most, idle_ms).__call__, told, "machines binary", "append", GroupStateTimeout.EventTimeTimeout)


#: Rows of a batch's file, about.
FILE_ROWS = 1 << 18


def files_of_batch(rows: int, batches: int) -> int:
    return max(1, -(-rows // (batches * FILE_ROWS)))


def arrive(df: DataFrame, batches: int, order: str = "ts", ident: str = "event_id", files: int = 1) -> tuple[str, str]:
    """(folder, lateness): the table as it may arrive: over so many batches by time, up to a batch's length out of order, and a closing row without a key.

    The batches are written to the shared folder one after another, each in so many files. Rows of a batch come in any order.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    seconds = F.unix_micros(F.col(order).cast("timestamp")) / 1e6
    lo, hi = df.agg(F.min(seconds), F.max(seconds)).first()
    span = max((hi - lo) / batches, 1.0) if lo is not None else 1.0
    shifted = seconds - (lo or 0.0) + (F.pmod(F.xxhash64(ident), F.lit(1000)) / 1000.0 - 0.5) * span
    placed = df.withColumn("__batch", F.least(F.greatest(F.floor(shifted / span), F.lit(0)), F.lit(batches)))
    for n in range(batches + 1):
        placed.filter(F.col("__batch") == n).drop("__batch").repartition(files).write.mode("append").parquet(at)
    if lo is not None:
        last = spark.range(1).select(*(F.timestamp_seconds(F.lit(hi + 4 * span + 86400 * 400)).cast(f.dataType).alias(f.name) if f.name == order else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
        last.write.mode("append").parquet(at)
    return at, f"{int(3 * span) + 1} seconds"


def arrivals(df: DataFrame, batches: int, order: str = "ts", ident: str = "event_id") -> tuple[DataFrame, str]:
    """(stream, lateness) of a table that arrives so; the files of a batch are a micro-batch."""
    files = files_of_batch(df.count(), batches)
    at, late = arrive(df, batches, order, ident, files)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(at), late


def drained_by_files(stream: DataFrame) -> DataFrame:
    """Runs a stream with RocksDB state over all files that are there, into the shared folder, and reads the result."""
    spark: SparkSession = stream.sparkSession
    base, before = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
