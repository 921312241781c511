"""Versioned snapshots of frames: immutable files and manifests of versions, which outlast a session.

A store is a folder. A frame's rows are dealt into buckets by a hash of their key; each write makes files of its own and never touches others. A version is
a manifest that names, for each bucket, the files that hold it, so an update writes the buckets that it changes and takes
over the others (copy on write). A manifest is written last, into a folder that appears by one rename: a write that fails leaves the versions as
they were. Of two writers of one version number the second is refused. Old versions are removed with the files that no version names any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, frame string, bucket int, files string, schema string, key string, buckets int"


class NoVersion(LookupError):
    """The store holds no such version."""


class Versions:
    """The versions of named frames below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def versions(self, frame: str) -> list[int]:
        at = self._at("manifests", frame)
        if not self._fs.exists(at):
            return []
        return sorted(int(name.removeprefix("v")) for s in self._fs.listStatus(at) if (name := s.getPath().getName()).startswith("v"))

    def _manifest(self, frame: str, version: int | None = None) -> tuple[int, list]:
        held = self.versions(frame)
        if not held or version is not None and version not in held:
            raise NoVersion(f"{frame} has no version" + (f" {version}" if version is not None else ""))
        number = held[-1] if version is None else version
        return number, self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/{frame}/v{number:09}").collect()  # a row a bucket

    def _publish(self, frame: str, version: int, rows: list[tuple]) -> int:
        """The manifest is written aside and appears by a rename."""
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(aside)
        target = self._at("manifests", frame, f"v{version:09}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._at(aside.rsplit("/", 1)[1]), target):
            self._fs.delete(self._at(aside.rsplit("/", 1)[1]), True)
            raise FileExistsError(f"version {version} of {frame} is there already")
        return version

    def _written(self, df: DataFrame, key: str, buckets: int) -> tuple[str, set[int]]:
        """(name of the files, the buckets that they hold)."""
        name = uuid.uuid4().hex
        at = f"{self.path}/data/{name}"
        df.withColumn("__bucket", bucket_of(key, buckets)).repartition("__bucket", F.pmod(F.monotonically_increasing_id(), F.lit(8))).write.partitionBy("__bucket").parquet(at)
        folders = self._fs.listStatus(self._at("data", name))
        return name, {int(s.getPath().getName().split("=")[1]) for s in folders if s.isDirectory() and "=" in s.getPath().getName()}

    def save(self, frame: str, df: DataFrame, key: str, buckets: int = 64) -> int:
        """A version of these rows alone; the number of the version."""
        name, held = self._written(df, key, buckets)
        version = max(self.versions(frame), default=0) + 1
        return self._publish(frame, version, [(version, frame, b, name if b in held else None, df.schema.json(), key, buckets) for b in range(buckets)])

    def load(self, frame: str, version: int | None = None) -> DataFrame:
        """The rows of a version, the last if none is given."""
        _, manifest = self._manifest(frame, version)
        return self._read(manifest, None)

    def _read(self, manifest: list, buckets: set[int] | None) -> DataFrame:
        from pyspark.sql.types import StructType
        import json

        schema = StructType.fromJson(json.loads(manifest[0].schema))
        paths = [f"{self.path}/data/{m.files}/__bucket={m.bucket}" for m in manifest if m.files and (buckets is None or m.bucket in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def update(self, frame: str, changes: DataFrame, deleted: DataFrame | None = None) -> int:
        """The next version: rows of the changes take the place of those of their keys, keys of `deleted` go. Only the buckets of these keys are read and written."""
        number, manifest = self._manifest(frame)
        key, n = manifest[0].key, manifest[0].buckets
        keys = changes.select(key) if deleted is None else changes.select(key).unionByName(deleted.select(key))
        touched = {r[0] for r in keys.select(bucket_of(key, n)).distinct().collect()}  # at most a number a bucket
        left = self._read(manifest, touched).join(keys.distinct(), key, "left_anti")
        fresh = changes if deleted is None else changes.join(deleted.select(key).distinct(), key, "left_anti")
        columns = left.columns
        name, held = self._written(left.unionByName(fresh.select(*columns)), key, n)
        rows = [(number + 1, frame, m.bucket, (name if m.bucket in held else None) if m.bucket in touched else m.files, m.schema, key, n) for m in manifest]
        return self._publish(frame, number + 1, rows)

    def restore(self, frame: str, version: int) -> int:
        """A new version that names the files of an old one; nothing is copied."""
        _, manifest = self._manifest(frame, version)
        number = self.versions(frame)[-1] + 1
        return self._publish(frame, number, [(number, frame, m.bucket, m.files, m.schema, m.key, m.buckets) for m in manifest])

    def prune(self, frame: str, keep: int) -> list[int]:
        """Removes all but the last versions, and files that no version of any frame names; the numbers removed. Not to be run beside a writer."""
        gone = self.versions(frame)[: -max(keep, 1)]
        for v in gone:
            self._fs.delete(self._at("manifests", frame, f"v{v:09}"), True)
        frames = self._fs.listStatus(self._at("manifests"))
        named = set()
        for f in frames:
            own = f.getPath().getName()
            for v in self.versions(own):
                named |= {m.files for m in self._manifest(own, v)[1]}
        for s in self._fs.listStatus(self._at("data")):
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
        return gone


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
