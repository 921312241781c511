"""Configuration as data: documents of a key laid over one another in order, as VARIANT values.

Deep merging one document over another replaces a value by a value, a table by a value, and a value by a table, and merges tables. A fold of any
number of documents needs no walk through them: a leaf stays unless a later document of its key writes the same path, a table that it
stands in (as a value), or something below it. A JSON null is a tombstone: it removes what is at or below its path, and says nothing itself.

A VARIANT holds 2.0 as 2 and -0.0 as 0; a number that was written with a fraction keeps one here, also in arrays, which are read from the text for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestep.storage import cut, observed


def _is_table(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def _entered(rows: DataFrame) -> DataFrame:
    """(owner, at, path, v, text): the members of each table, and the other rows as they are; empty tables are left out."""
    texts = F.when(F.col("open") & F.col("text").rlike(r"\[|-0"), F.from_json("text", "map<string, string>"))
    met = rows.withColumn("open", _is_table(F.col("v"))).withColumn("texts", texts)
    inside = met.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.when(F.col("open").outer(), F.col("v").outer()))).filter(~F.col("open") | F.col("key").isNotNull())
    inner = lambda member, own: F.when(F.col("open"), member).otherwise(F.col(own)).alias(own)
    return inside.select("owner", "at", inner(F.concat("path", F.array("key")), "path"), inner(F.col("value"), "v"), inner(F.try_element_at("texts", F.col("key")), "text"))


def leaves_of(docs: DataFrame, key: str, order: list[str], doc: str, levels: int) -> DataFrame:
    """(key, at, path, value, deeper): the leaves of JSON texts; path is a list of names, value JSON text, null for a tombstone. Arrays are leaves, empty tables say nothing.

    Texts that aren't JSON, or no table, say nothing, nor do rows without a key. Tables are entered `levels` deep in one pass; one that lies deeper is a row marked deeper.
    """
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("owner"), F.struct(*order).alias("at"), F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(doc)).alias("v"), F.col(doc).alias("text")).filter(_is_table(F.col("v")))
    for _ in range(levels):
        rows = _entered(rows)
    kind = F.schema_of_variant("v")
    plain = F.to_json("v")
    bare = F.regexp_replace("text", r'("(?:[^"\\]++|\\.)*+")|\s+', "$1")
    written = (
        F.when(kind.startswith("ARRAY"), F.coalesce(bare, plain))
        .when(kind.startswith("DECIMAL") & (plain == "0"), F.coalesce("text", F.lit("0.0")))
        .when(kind.startswith("DECIMAL") & ~F.contains(plain, F.lit(".")), F.concat(plain, F.lit(".0")))
        .otherwise(plain)
    )
    return rows.select(F.col("owner").alias(key), "at", "path", F.when(~F.is_variant_null("v"), written).alias("value"), _is_table(F.col("v")).alias("deeper"))


def _last_writes(docs: DataFrame, key: str, order: list[str], doc: str, deepest: int = 32) -> DataFrame:
    """(owner, path, at, said, value): the last write to each path of a key, kept, so that the documents are read once; tables nested deeper than `deepest` raise ValueError.

    Tables are entered four levels deep, or twice as deep as before while some lie deeper.
    """
    write, levels = F.struct("at", F.col("value").isNotNull().alias("said"), "value"), 4
    while True:
        met = leaves_of(docs, key, order, doc, levels).groupBy(F.col(key).alias("owner"), "path").agg(F.max(write).alias("last"), F.bool_or("deeper").alias("deeper"))
        last, seen = observed(met.select("owner", "path", "last.at", "last.said", "last.value", "deeper"), deeper=F.bool_or("deeper"))
        if not seen["deeper"]:
            return last.drop("deeper")
        if levels > deepest:
            raise ValueError(f"tables are nested deeper than {deepest}")
        levels = min(2 * levels, deepest + 1)


def folded(docs: DataFrame, key: str, order: list[str], doc: str) -> DataFrame:
    """(key, path, value): each key's documents laid over one another in order; path is dotted, value JSON text.

    Only the last write to a path counts for anything, so a key's rows shrink to one a path before they are shuffled. Of writes of equal order the greatest value counts.
    """
    last = _last_writes(docs, key, order, doc)
    tables = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", 1, i))
    nested = last.filter(F.size("path") > 1).select("owner", "path", "at", "said", F.explode(tables).alias("table"))
    # what was written at a table that the leaf stands in, and below the leaf
    over = nested.join(last.select("owner", F.col("path").alias("table"), F.col("at").alias("at_over")), ["owner", "table"]).groupBy("owner", "path").agg(F.max("at_over").alias("at_over"))
    under = nested.filter("said").groupBy("owner", F.col("table").alias("path")).agg(F.max("at").alias("at_under"))
    met = last.filter("said").join(over, ["owner", "path"], "left").join(under, ["owner", "path"], "left")
    stays = F.coalesce(F.col("at_over") <= F.col("at"), F.lit(True)) & F.coalesce(F.col("at_under") <= F.col("at"), F.lit(True))
    return met.filter(stays).select(F.col("owner").alias(key), F.array_join("path", ".").alias("path"), "value")


def under_each(base: str, docs: DataFrame, doc: str) -> DataFrame:
    """(doc, path, value): each document of a column laid over the base. Equal documents come to equal leaves, so each is folded once, however many rows hold it; null ones say nothing and are left out."""
    own = cut(docs.select(doc).filter(F.col(doc).isNotNull()).distinct())
    return folded(own.select(doc, F.posexplode(F.array(F.lit(base), doc)).alias("i", "layer")), doc, ["i"], "layer")
