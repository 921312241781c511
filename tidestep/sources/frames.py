"""Frames of steps as files, with commits: a data source that writes all or nothing, and reads the steps that are asked for.

Each task writes its rows of a step to one Parquet file in a staging folder of the job. When all tasks have ended, the driver moves the files
to the folders of their steps and then writes the job's manifest; readers see the files of manifests alone, so a job appears at once. If a task
fails, the staging folder goes. Files are reached by Arrow's file systems (a URI, or a path that all executors share).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

STEP = "step"
MANIFESTS, STAGED = "_manifests", "_staged"
#: Rows of one step that a task holds before it writes a row group.
ROWS = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    found, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found, own.rstrip("/")


def listed(files: fs.FileSystem, folder: str) -> list[str]:
    return sorted(f.path for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


@dataclass
class Written(WriterCommitMessage):
    """(staged file, step, rows) of one task."""

    files: list[tuple[str, int, int]]


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = opened(self.path)
        folder, task = f"{root}/{STAGED}/{self.job}", uuid.uuid4().hex
        files.create_dir(folder)
        open_: dict[int, tuple[pq.ParquetWriter, pa.NativeFile, str]] = {}
        rows: dict[int, int] = {}
        try:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for step in table.column(STEP).unique().to_pylist():
                    if step is None:
                        raise ValueError("a frame has no step")
                    own = table.filter(pa.compute.equal(table.column(STEP), step)).drop_columns([STEP])
                    if step not in open_:
                        name = f"{folder}/{task}-{step}.parquet"
                        sink = files.open_output_stream(name)
                        open_[step] = pq.ParquetWriter(sink, own.schema), sink, name
                    open_[step][0].write_table(own, row_group_size=ROWS)
                    rows[step] = rows.get(step, 0) + own.num_rows
        except BaseException:
            for writer, sink, name in open_.values():
                sink.close()
                files.delete_file(name)
            raise
        for writer, sink, _ in open_.values():
            writer.close()
            sink.close()
        return Written([(name, step, rows[step]) for step, (_, _, name) in open_.items()])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = opened(self.path)
        before = listed(files, f"{root}/{MANIFESTS}") if self.overwrite else []
        held = []
        for name, step, rows in (x for m in messages if m for x in m.files):
            files.create_dir(f"{root}/{STEP}={step}")
            to = f"{STEP}={step}/{name.rsplit('/', 1)[1]}"
            files.move(name, f"{root}/{to}")
            held.append({"file": to, STEP: step, "rows": rows})
        files.create_dir(f"{root}/{MANIFESTS}")
        aside = f"{root}/{STAGED}/{self.job}.json"
        files.create_dir(f"{root}/{STAGED}")
        with files.open_output_stream(aside) as out:
            out.write(json.dumps(held).encode())
        files.move(aside, f"{root}/{MANIFESTS}/{self.job}.json")
        for old in before:  # what an overwrite replaces goes after the new frames are there
            for entry in manifest(files, old):
                files.delete_file(f"{root}/{entry['file']}")
            files.delete_file(old)
        self._clear(files, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{STAGED}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{STAGED}/{self.job}")


def manifest(files: fs.FileSystem, path: str) -> list[dict]:
    with files.open_input_stream(path) as held:
        return json.loads(held.read())


@dataclass
class FrameFile(InputPartition):
    path: str
    step: int


class FrameReader(DataSourceReader):
    """One partition for each file of the steps that are asked for."""

    def __init__(self, path: str, schema: StructType, low: int | None, high: int | None) -> None:
        self.path, self.schema, self.low, self.high = path, schema, low, high

    def _asked(self, step: int) -> bool:
        return (self.low is None or step >= self.low) and (self.high is None or step <= self.high)

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.path)
        return [FrameFile(f"{root}/{e['file']}", e[STEP]) for m in listed(files, f"{root}/{MANIFESTS}") for e in manifest(files, m) if self._asked(e[STEP])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, FrameFile):  # Spark asks once for a table without files
            return
        files, _ = opened(self.path)
        target = to_arrow_schema(self.schema)
        with files.open_input_file(partition.path) as held:
            for batch in pq.ParquetFile(held).iter_batches(ROWS, columns=[f.name for f in target if f.name != STEP]):
                columns = [pa.array([partition.step] * batch.num_rows, pa.int64()) if f.name == STEP else batch.column(f.name).cast(f.type) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)


class StepFrames(DataSource):
    """Format `step_frames`; options path, from and to (the first and last step that is read). Frames have a column `step` (long) and any others; reading needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "step_frames"

    def schema(self) -> StructType:
        raise ValueError("frames are read by a given schema")

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        if STEP not in schema.names or schema[STEP].dataType != LongType():
            raise ValueError("frames have a column step of whole numbers")
        return FrameWriter(self.options["path"], overwrite)

    def reader(self, schema: StructType) -> FrameReader:
        bound = lambda name: int(self.options[name]) if name in self.options else None
        return FrameReader(self.options["path"], schema, bound("from"), bound("to"))


def write_steps(df: DataFrame, path: str, mode: str = "append", parts: int = 8) -> None:
    """Writes frames; a step of many rows is dealt over several tasks."""
    from pyspark.sql import functions as F

    df.sparkSession.dataSource.register(StepFrames)
    dealt = df.repartition(F.col(STEP), F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    dealt.write.format("step_frames").mode(mode).option("path", path).save()


def read_steps(spark: SparkSession, path: str, schema: StructType | str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The committed frames of the steps from first to last; only their files are opened.

    The steps are options and not filters that Spark hands down: Spark 4.1 keeps what it has handed down to a Python source in the frame that was filtered, and a
    later use of that frame without the filter would miss rows.
    """
    spark.dataSource.register(StepFrames)
    reader = spark.read.format("step_frames").schema(schema).option("path", path)
    for name, bound in (("from", first), ("to", last)):
        reader = reader if bound is None else reader.option(name, bound)
    return reader.load()
