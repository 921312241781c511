"""Checks of registries as relations: what is required, provided, named twice or out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unprovided(required: DataFrame, provided: DataFrame, on: str | list[str]) -> DataFrame:
    return required.join(provided.select(on), on, "left_anti")


def missing(reads: DataFrame, have: DataFrame) -> DataFrame:
    """(sys, res) of reads that aren't optional and that nothing holds."""
    return unprovided(reads.filter(~F.col("opt")), have, "res").select("sys", "res")


def duplicates(plugins: DataFrame) -> DataFrame:
    return plugins.filter("uniq").groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def unordered_dependencies(deps: DataFrame, plugins: DataFrame) -> DataFrame:
    """(plugin, dep) where no plugin of the name stands before."""
    first = plugins.groupBy("name").agg(F.min("pos").alias("first"))
    met = deps.join(first, deps["dep"] == first["name"], "left")
    return met.filter(F.col("first").isNull() | (F.col("first") >= F.col("pos"))).select("plugin", "dep")


def without_label(systems: DataFrame, label: str) -> DataFrame:
    """Systems of another label, or of none."""
    return systems.filter(~F.col("label").eqNullSafe(label))


def overlaid(base: DataFrame, over: DataFrame, key: str = "path", value: str = "v") -> DataFrame:
    """Leaf values by dotted path, those of `over` first: a value there takes the place of a table here (of all paths below it), a table there that of a value."""
    tables = lambda path: F.transform(F.sequence(F.lit(1), F.size(F.split(path, r"\."))), lambda i: F.array_join(F.slice(F.split(path, r"\."), 1, i), "."))
    # a path with all that it stands in, itself last
    taken = over.select(F.explode(tables(F.col(key))).alias(key)).distinct()
    inside = base.select(key, F.explode(tables(F.col(key))).alias("__table")).join(over.select(F.col(key).alias("__table")), "__table", "left_semi").select(key).distinct()
    left = base.join(taken, key, "left_anti").join(inside, key, "left_anti")
    return left.select(key, value).unionByName(over.select(key, value))


def with_defaults(defaults: DataFrame, said: DataFrame, key: str = "path", value: str = "v") -> DataFrame:
    s = said.select(key, F.col(value).alias("__said"))
    return defaults.join(s, key, "left").select(key, F.coalesce("__said", value).alias(value))


def any_done(df: DataFrame, key: str, done) -> DataFrame:
    return df.groupBy(key).agg(F.bool_or(done).alias("any_done"))


def below(paths: DataFrame, table: str, key: str = "path") -> DataFrame:
    """The rows of the paths below a table, named from there."""
    return paths.filter(F.col(key).startswith(f"{table}.")).withColumn(key, F.substring(key, len(table) + 2, 1 << 30))


def later_mentions(stages: DataFrame, index: str, section: str, first_only: set[str]) -> DataFrame:
    """Stages after the first that say something of a section that only the first one's values are read of."""
    return stages.filter((F.col(index) > 0) & F.col(section).isin(*sorted(first_only)))


def mismatched(expected: DataFrame, actual: DataFrame, key: str, name: str) -> DataFrame:
    """(key, expected, actual) where the names differ or one is lacking."""
    e, a = (df.select(key, F.col(name).alias(kind)) for df, kind in ((expected, "expected"), (actual, "actual")))
    return e.join(a, key, "full").filter(~F.col("expected").eqNullSafe(F.col("actual"))).select(key, "expected", "actual")
