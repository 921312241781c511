"""Per-key state machines over Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidestep.storage import shared_dir


def step_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def entries(stream: DataFrame, state: str, key: str = "user_id", column: str = "event_type", ident: str = "event_id", order: str = "ts") -> DataFrame:
    """(ident, key) where a key enters the state. The key's last state is kept between batches; a batch's rows are put in order first."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        rows = pd.concat(frames).sort_values([order, ident])
        before = rows[column].shift(1)
        before.iloc[0] = last
        hit = (rows[column] == state) & (before.isna() | (before != state))
        held.update((rows[column].iloc[-1],))
        yield pd.DataFrame({ident: rows.loc[hit, ident], key: k[0]})

    narrow = stream.select(ident, key, column, order)
    return narrow.groupBy(key).applyInPandasWithState(run, f"{ident} long, {key} long", "last string", "append", GroupStateTimeout.NoTimeout)


def transitions(stream: DataFrame, start: str, states: list[str], key: str = "user_id", column: str = "event_type", ident: str = "event_id", order: str = "ts") -> DataFrame:
    """(ident, state): each row's state before its own pending one, if its column names one of the states, is applied."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else start
        rows = pd.concat(frames).sort_values([order, ident])
        pending = rows[column].where(rows[column].isin(states)).ffill()
        held.update((now if pd.isna(pending.iloc[-1]) else pending.iloc[-1],))
        yield pd.DataFrame({ident: rows[ident], "state": pending.shift(1).fillna(now)})

    return stream.select(ident, key, column, order).groupBy(key).applyInPandasWithState(run, f"{ident} long, state string", "current string", "append", GroupStateTimeout.NoTimeout)


def stages(stream: DataFrame, state: str, most: int, key: str = "user_id", column: str = "event_type", ident: str = "event_id", order: str = "ts") -> DataFrame:
    """(ident, stage): how often the key has entered the state so far, at most so many."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, n = held.get if held.exists else ("", 0)
        rows = pd.concat(frames).sort_values([order, ident])
        before = rows[column].shift(1)
        before.iloc[0] = last
        so_far = n + ((rows[column] == state) & (before != state)).cumsum()
        held.update((rows[column].iloc[-1], min(int(so_far.iloc[-1]), most)))
        yield pd.DataFrame({ident: rows[ident], "stage": so_far.clip(upper=most).astype("int64")})

    return stream.select(ident, key, column, order).groupBy(key).applyInPandasWithState(run, f"{ident} long, stage long", "last string, n long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, every: str = "1 day", late: str = "1 hour", time: str = "ts", column: str = "event_type") -> DataFrame:
    """(begin, column, n) by tumbling window, for update or append output; rows later than `late` behind the newest are left out."""
    stamped = stream.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    return stamped.groupBy(F.window("__at", every).alias("w"), column).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), column, "n")


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there, into the shared folder, and reads the result."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
