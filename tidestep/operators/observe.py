"""Observation: logged lines, timings and traces as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestep.functions.format import LARGE, SMALL, format_value

#: Fixed value: what stands for a column that was never set.
MISSING = "—"


def log_line(columns: list[Column], width: int = 14, large: float = 1e6) -> Column:
    """The columns' last values in order, right-aligned, a dash where there is none."""
    cell = lambda c: F.coalesce(format_value(c, width, large), F.lpad(F.lit(MISSING), width, " "))
    return F.concat_ws("", *(cell(c) for c in columns))


def timing_table(df: DataFrame, name: str, seconds: Column) -> DataFrame:
    """(name, t, pct), the longest first; the window spans one row per name."""
    own = df.groupBy(name).agg(seconds.alias("t"))
    return own.withColumn("pct", F.col("t") / F.sum("t").over(Window.partitionBy())).orderBy(F.desc("t"))


def joined_snippets(df: DataFrame, order: str, text: str, name: str = "cfg", by: list[str] | None = None) -> DataFrame:
    """The snippets in order, an empty line between them; one text for each group."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(text).alias("t")))), lambda s: s["t"]), "\n\n").alias(name)
    return df.groupBy(*(by or [])).agg(joined)


class TermOut:
    """Logged values on the driver: the last of each name is shown until another is set."""

    def __init__(self, columns: list[str], every: int = 100, width: int = 14) -> None:
        self.columns, self.every, self.width = columns, every, width
        self.values: dict[str, float] = {}
        self.lines: list[str] = []

    def set(self, name: str, value: float) -> None:
        self.values[name] = value

    def cell(self, name: str) -> str:
        if name not in self.values:
            return MISSING.rjust(self.width)
        v = self.values[name]
        if name == "step":
            return str(int(v)).rjust(self.width)
        if v and not SMALL <= abs(v) < LARGE:
            mantissa, _, power = f"{v:.6e}".partition("e")
            return f"{mantissa}e{int(power)}".rjust(self.width)
        return f"{v:.6f}".rjust(self.width)

    def print(self, step: int, time: float) -> str | None:
        """The line of a step that is due, after the header at the first."""
        if self.every <= 0 or step % self.every:
            return None
        self.values |= {"step": step, "time": time}
        if not self.lines:
            self.lines.append("".join(c.rjust(self.width) for c in self.columns))
        self.lines.append("".join(map(self.cell, self.columns)))
        return self.lines[-1]
