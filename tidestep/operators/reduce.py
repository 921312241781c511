"""Reductions over ranks, and exchange between neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def all_reduce(df: DataFrame, rank: str, sums: dict[str, str], mins: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(rank, kept columns such as the place in a grid, results): partial sums and minima per rank, then over the ranks, each of which gets the results. Values are summed in the precision of their type.

    Only the window over one row per rank stands in one task.
    """
    own = df.groupBy(rank, *keep).agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()), *(F.min(c).alias(f"__{n}") for n, c in mins.items()))
    everyone = Window.partitionBy()
    return own.select(rank, *keep, *(F.sum(f"__{n}").over(everyone).cast("double").alias(n) for n in sums), *(F.min(f"__{n}").over(everyone).alias(n) for n in mins))


def halo_exchange(values: DataFrame, rank: str, value: str, neighbours: dict[str, int]) -> DataFrame:
    """(rank, one column for each neighbour, at its offset); null where there is none. Values are read once: each goes to itself and to those that it is a neighbour of, and ranks meet in one aggregation."""
    kind = dict(values.dtypes)[value]
    to = lambda offset, name, v: F.struct((F.col(rank) - offset).cast("long").alias("to"), F.lit(name).alias("name"), v.alias("v"))
    own = to(0, "", F.lit(None).cast(kind))
    sent = values.select(F.inline(F.array(own, *(to(offset, name, F.col(value)) for name, offset in neighbours.items()))))
    at = lambda name: F.max(F.when(F.col("name") == name, F.struct("v")))["v"].alias(name)
    met = sent.groupBy("to").agg(F.bool_or(F.col("name") == "").alias("there"), *(at(name) for name in neighbours))
    return met.filter("there").select(F.col("to").cast(dict(values.dtypes)[rank]).alias(rank), *neighbours)


def exchanged(edges: DataFrame, payload: str, room: str, rank: str = "rank", slot: str = "slot", to: str = "to_rank", source: str = "from_rank") -> DataFrame:
    """(rank, slot, from_rank, received): what each edge's receiving half gets.

    An edge sends its payload, a vector, to rank `to`, and receives into a place for `room` numbers from rank `source`; -1 disables a half. A receipt meets
    the sending of the same slot from its source to its rank, and takes as many numbers as both have: the least of the payload's length and the room. It is
    null where nothing was sent, a null room or payload counting as none. Of several payloads on one way the greatest is taken. An edge is read once and
    dealt once, as its two halves.
    """
    way = lambda dest, src, sent, held, asks: F.struct(dest.alias("dest"), src.alias("src"), F.col(slot).alias("slot"), sent.alias("sent"), held.alias("room"), F.lit(asks).alias("asks"))
    own = F.col(rank)
    none, nowhere = F.lit(None), F.lit(None).cast("int")
    kind = dict(edges.dtypes)[payload]
    halves = F.array(way(F.col(to), own, F.col(payload), nowhere, False), way(own, F.col(source), none.cast(kind), F.col(room).cast("int"), True))
    both = edges.select(F.inline(halves)).filter("dest >= 0 AND src >= 0")
    met = both.groupBy("dest", "src", "slot").agg(F.max("sent").alias("sent"), F.max("room").alias("room"), F.bool_or("asks").alias("asks"))
    received = F.when(F.col("sent").isNotNull() & F.col("room").isNotNull(), F.slice("sent", 1, F.least(F.size("sent"), F.greatest("room", F.lit(0)))))
    return met.filter("asks").select(F.col("dest").alias(rank), F.col("slot").alias(slot), F.col("src").alias(source), received.alias("received"))
