"""State machines over streams whose rows arrive out of order: equal to the batch, state dropped by timers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidestep.streaming.ordered import arrivals, arrive, drained_by_files, machine_rows

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp_ntz"


@pytest.fixture(scope="module")
def events(spark):
    begin, kinds = datetime(2024, 1, 1), ["error", "click", "signup", None, "error", "error"]
    rows = [(i, [1, 2, 1, 3, None, 1][i % 6], kinds[(i * i + i // 5) % 6], begin + timedelta(minutes=7 * i + (i % 3))) for i in range(120)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1).cache()


def walked(events, idle=None):
    """What the machines say of each row, walked in order."""
    out, machines = {}, {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        if r.user_id is None:
            continue
        m = machines.setdefault(r.user_id, {})
        if idle and m and r.ts - m["ts"] > idle:
            m.clear()
        state, visits = r.event_type, m.setdefault("visits", {})
        entered = state is not None and m.get("last") != state
        if entered:
            visits[state] = visits.get(state, 0) + 1
        stage = m.get("stage", 0)
        stage = min(stage + (entered and state == "error"), 3)
        out[r.event_id] = (r.user_id, entered, m.get("current", "init"), stage, visits.get(state, 0))
        m.update(ts=r.ts, last=state, stage=stage, current=state if state in ("signup", "error") else m.get("current", "init"))
    return out


@pytest.mark.parametrize("idle_minutes", [None, 12])
def test_rows_out_of_order_give_what_the_batch_gives(spark, events, idle_minutes):
    stream, late = arrivals(events, 5)
    told = drained_by_files(machine_rows(stream, late, "init", ["signup", "error"], "error", 3, idle_minutes and idle_minutes * 60_000))
    got = {r.ident: (r.user_id, r.entered, r.current, r.stage, r.visit) for r in told.collect()}
    assert got == walked(events, timedelta(minutes=idle_minutes) if idle_minutes else None)


def test_arrivals_are_out_of_order_and_whole(spark, events):
    at, late = arrive(events, 5)
    assert late.endswith("seconds")
    batch = spark.read.schema(SCHEMA).parquet(at).filter("event_id IS NOT NULL")
    assert batch.exceptAll(events).count() == 0 and batch.count() == 120
    spans = batch.groupBy(F.input_file_name()).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("lo").collect()
    assert any(a.hi > b.lo for a, b in zip(spans, spans[1:], strict=False))


def test_idle_machines_leave_the_state_store(spark, events):
    """After the closing row's watermark only the idle rule decides what is held: with it nothing is."""
    held = {}
    for idle in (None, 60_000):
        stream, late = arrivals(events, 2)
        query = machine_rows(stream, late, "init", ["signup"], "error", 3, idle)
        told, rows = _with_progress(spark, query)
        assert told.count() == events.filter("user_id IS NOT NULL").count()
        held[idle] = rows
    assert held[60_000] < held[None]


def test_many_keys_share_rows_of_state(spark):
    from tidestep.streaming.ordered import files_of_batch

    many = spark.range(3000).selectExpr("id AS event_id", "id % 1500 AS user_id", "'error' AS event_type", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int), 0) AS ts")
    stream, late = arrivals(many, 1)
    told, rows = _with_progress(spark, machine_rows(stream, late, "init", ["signup"], "error", 3))
    assert told.count() == 3000 and told.filter("entered").count() == 1500
    assert 0 < rows < 1500
    assert files_of_batch(10, 5) == 1 and files_of_batch(6_000_000, 5) == 5


def _with_progress(spark, query):
    """(result, rows of state at the end)."""
    import tempfile

    from tidestep.streaming.ordered import PROVIDER, ROCKS

    base, before = tempfile.mkdtemp(), spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = query.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
        q.awaitTermination()
        rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(query.schema).parquet(f"{base}/out"), rows
