"""Versioned snapshots and frame files: what is kept, shared, refused and removed."""

import os

import pytest
from pyspark.sql import functions as F

from tidestep.sources.frames import read_steps, write_steps
from tidestep.sources.versions import NoVersion, Versions

SCHEMA = "step long, k long, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_outlast_their_session(spark, tmp_path):
    """Update, delete, restore from another object over the same folder, in another session."""
    store = Versions(spark, str(tmp_path / "store"))
    first = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    assert store.save("frame", first, "k", 8) == 1
    change = spark.createDataFrame([(3, -1), (200, -2)], "k long, x long")
    assert store.update("frame", change, spark.createDataFrame([(5,)], "k long")) == 2
    later = Versions(spark.newSession(), str(tmp_path / "store"))
    want = {k: 2 * k for k in range(100)}
    assert dict(rows(later.load("frame", 1))) == want
    changed = {**want, 3: -1, 200: -2}
    del changed[5]
    assert dict(rows(later.load("frame"))) == changed
    assert later.restore("frame", 1) == 3 and dict(rows(store.load("frame"))) == want
    with pytest.raises(NoVersion):
        store.load("frame", 9)
    with pytest.raises(NoVersion):
        store.load("other")


def test_an_update_writes_the_changed_buckets_alone(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    store.save("frame", spark.range(1000).select(F.col("id").alias("k"), F.lit(0).alias("x")), "k", 16)
    before = {m.bucket: m.files for m in store._manifest("frame", 1)[1]}
    store.update("frame", spark.createDataFrame([(7, 1)], "k long, x int"))
    after = {m.bucket: m.files for m in store._manifest("frame", 2)[1]}
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.prune("frame", 1) == [1] and store.versions("frame") == [2]
    assert rows(store.load("frame").groupBy("x").count()) == [(0, 999), (1, 1)]
    assert len(os.listdir(tmp_path / "data")) == 2  # the first files still hold fifteen buckets


def test_a_version_is_written_once(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    store.save("frame", spark.range(3).select(F.col("id").alias("k")), "k", 2)
    with pytest.raises(FileExistsError):
        store._publish("frame", 1, [(1, "frame", 0, None, "{}", "k", 1)])
    assert store.versions("frame") == [1] and not [x for x in os.listdir(tmp_path) if x.startswith("aside")]
    assert store.save("empty", spark.range(0).select(F.col("id").alias("k")), "k", 2) == 1 and store.load("empty").count() == 0


def test_frames_come_back_and_a_step_reads_its_files(spark, tmp_path):
    path = str(tmp_path / "frames")
    df = spark.range(1000).select((F.col("id") % 5).alias("step"), F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # what is small here is large there
    try:
        write_steps(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = read_steps(spark, path, SCHEMA)
    assert rows(whole.fillna("-")) == rows(df.fillna("-"))
    one = read_steps(spark, path, SCHEMA, 3, 3)
    assert one.filter("k > 10").count() == df.filter("step = 3 AND k > 10").count() and one.count() == 200
    assert read_steps(spark, path, SCHEMA, first=2).count() == 600 and read_steps(spark, path, SCHEMA, last=0).count() == 200
    files = len(os.listdir(f"{path}/step=3"))
    assert files > 1 and one.rdd.getNumPartitions() == files < whole.rdd.getNumPartitions()
    assert whole.filter("step > 9").count() == 0 and whole.count() == 1000 and read_steps(spark, path, SCHEMA, 9).count() == 0
    write_steps(df.filter("step = 1").withColumn("k", -F.col("k")), path)
    assert read_steps(spark, path, SCHEMA).filter("step IN (1, 2)").count() == 600  # a frame lists its files once
    write_steps(df.filter("k < 3"), path, "overwrite")
    assert rows(read_steps(spark, path, SCHEMA).select("k")) == [(0,), (1,), (2,)]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "frames")
    write_steps(spark.range(10).select(F.lit(1).cast("long").alias("step"), F.col("id").alias("k"), F.lit("a").alias("v")), path)
    broken = spark.range(100).select(F.lit(2).cast("long").alias("step"), F.col("id").alias("k"), F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise("b").alias("v"))
    with pytest.raises(Exception, match="broken|abort"):
        broken.write.format("step_frames").mode("append").option("path", path).save()
    with pytest.raises(Exception, match="no step"):
        spark.createDataFrame([(2, 1, "x"), (None, 2, "y")], SCHEMA).coalesce(1).write.format("step_frames").mode("append").option("path", path).save()
    assert read_steps(spark, path, SCHEMA).count() == 10
    left = [f for d, _, names in os.walk(path) for f in names if not f.startswith(".")]
    assert len([f for f in left if f.endswith(".json")]) == 1 and not os.path.exists(f"{path}/step=2")
    assert os.listdir(f"{path}/_staged") == []
    with pytest.raises(Exception, match="whole numbers"):
        spark.createDataFrame([("x", 1)], "step string, k int").write.format("step_frames").mode("append").option("path", path).save()
