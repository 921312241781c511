"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.storage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns, also such as clash with an operator's own names, are not read. A null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def filed(docs: DataFrame) -> DataFrame:
    """The rows as rows of files: as they are if they are read from files, else written to the shared folder and read again."""
    try:
        docs.select(row_of(docs)).schema  # noqa: B018
        return docs
    except AnalysisException:
        at = f"{shared_dir(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
        docs.write.parquet(at)
        return docs.sparkSession.read.schema(docs.schema).parquet(at)


def row_of(docs: DataFrame) -> Column:
    """A hash of the file and place that a row stands at: the same at each reading, however the files are split."""
    own = docs.metadataColumn("_metadata")
    return F.xxhash64(own["file_path"], own["row_index"])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterable[pa.RecordBatch], slice_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about slice_bytes, so that only so much text is held as Python objects at a time."""
    for b in batches:
        rows = max(1, b.num_rows * slice_bytes // max(b.nbytes, 1))
        for begin in range(0, b.num_rows, rows):
            yield b.slice(begin, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the table's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(names: list[str]) -> list[Column]:
    """The columns of these names, whatever characters they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]
