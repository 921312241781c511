"""Cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests), one of our own."""
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidestep-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict[str, Any]]:
    """The rows written to the shared folder and read again, and aggregates over them that the same job has taken."""
    seen, at = Observation(), f"{shared_dir(df.sparkSession)}/observed-{uuid.uuid4().hex}"
    df.observe(seen, *(c.alias(n) for n, c in metrics.items())).write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), seen.get
