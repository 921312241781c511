"""Delta iteration: each row leaves the loop when it has converged, and a round reads only those that haven't.

Each round is one write: the step's rows go to the shared folder, finished and open ones into folders of their own, and the number
of open rows is observed by the same job. The next round reads the open folder alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tidestep.plans.schedule import NotConverged, OnMax
from tidestep.storage import shared_dir


@dataclass
class DeltaLoop:
    """Applies `step` to the frontier until `done` holds for each row, asked after the step, at most so many rounds.

    With ACCEPT, rows that are open at the limit come out as they are then, with converged = false; with RAISE they raise NotConverged; with ROLLBACK
    they come out as they went in. `extent` tells afterwards how many rows each round read.
    """

    step: Callable[[DataFrame], DataFrame]
    done: Column
    most: int
    on_max: OnMax = OnMax.ACCEPT
    extent: list[int] = field(default_factory=list)

    def run(self, df: DataFrame, key: list[str] | None = None) -> DataFrame:
        """The rows with `iterations` and `converged`. A rollback needs the key by which the open rows are found in the input."""
        spark = df.sparkSession
        if self.most <= 0:
            return self._over(df.withColumns({"iterations": F.lit(0), "converged": F.lit(False)}), df, key)
        base = f"{shared_dir(spark)}/delta-{uuid.uuid4().hex}"
        frontier, self.extent, schema = df, [], None
        for n in range(1, self.most + 1):
            stepped = self.step(frontier)
            seen = Observation()
            marked = stepped.withColumn("converged", F.coalesce(self.done, F.lit(False))).observe(seen, F.count_if(~F.col("converged")).alias("open"), F.count("*").alias("rows"))
            marked.write.partitionBy("converged").parquet(f"{base}/iterations={n}")
            self.extent.append(seen.get["rows"])
            schema = schema or stepped.schema
            if not seen.get["open"]:
                break
            frontier = spark.read.schema(schema).parquet(f"{base}/iterations={n}/converged=false")
        whole = spark.read.schema(StructType([*schema.fields, StructField("iterations", IntegerType()), StructField("converged", BooleanType())])).parquet(base)
        result = whole.filter(F.col("converged") | (F.col("iterations") == n))
        return self._over(result, df, key) if seen.get["open"] else result

    def _over(self, result: DataFrame, df: DataFrame, key: list[str] | None) -> DataFrame:
        if self.on_max is OnMax.RAISE:
            raise NotConverged(f"rows are open after {self.most} rounds")
        if self.on_max is not OnMax.ROLLBACK:
            return result
        if not key:
            raise ValueError("a rollback needs a key")
        left = result.filter("not converged").select(*key, "iterations", "converged")
        return result.filter("converged").unionByName(df.join(left, key).select(*result.columns))


def recursive(df: DataFrame, step: dict[str, str], done: str, most: int) -> DataFrame:
    """The same loop as one plan, a recursive common table: `step` gives columns as SQL of the row before, `done` is asked of the row after it.

    Rows with `iterations` and `converged`; open rows at the limit come out as they are then. Spark runs a job a round and keeps all rounds' rows, so this suits
    frames whose rounds are small; its limit on the rows of all rounds is lifted for the session.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    quoted = {c: f"`{c.replace('`', '``')}`" for c in df.columns}
    made = ", ".join(f"CAST({step.get(c, q)} AS {t}) AS {q}" for (c, t), q in zip(df.dtypes, quoted.values(), strict=True))
    text = f"""WITH RECURSIVE loop MAX RECURSION LEVEL {most + 1} AS (
      SELECT {made}, 1 AS iterations FROM {{src}}
      UNION ALL SELECT {made}, iterations + 1 FROM loop WHERE NOT coalesce({done}, false) AND iterations < {most})
    SELECT *, coalesce({done}, false) AS converged FROM loop WHERE coalesce({done}, false) OR iterations = {most}"""
    return spark.sql(text, src=df)
