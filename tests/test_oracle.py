"""Every engine query against its SQL, and the queries' plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidestep import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(frame):
    plain = lambda v: tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v
    return sorted((tuple(str(plain([float(x) for x in v] if hasattr(v, "tolist") and hasattr(v, "__len__") else v)) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_matches_sql(spark, duck, sf, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), duck.sql(engine.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(engine.DRIVER_CHECKS))
def test_driver_matches_sql(spark, duck, sf, name):
    query, sql = engine.DRIVER_CHECKS[name]
    assert canonical(query(spark, sf).toPandas()) == canonical(duck.sql(sql).df())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_scans_are_pruned(spark, sf):
    plan = engine.QUERIES["in_state"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "props" not in plan


def test_stages_of_odd_lines_match_sql(spark, tmp_path):
    """stage_overrides: lines without a key or a flag, of other flags, numbered past 7, and held more than once."""
    lines = [
        (1, 1, "N"), (1, 1, "R"), (1, 1, "A"), (1, 2, "A"), (1, 3, "A"), (1, 3, "N"), (2, 3, None), (2, 4, "A"), (2, 4, None), (None, 1, "N"), (None, 1, "N"), (None, 2, "A"), (3, None, "R"), (None, None, None),
        (1, 9, "N"), (2, 1, "A"), (2, 9, "N"), (3, 1, "N"), (4, 1, "X"), (4, 2, ""), (4, 3, "B"), (-1, 1, "R"),
    ]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got, want = engine.QUERIES["stage_overrides"](spark, str(tmp_path)).select("stage", "path", "value").collect(), c.execute(engine.SQL["stage_overrides"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(want) > 20 and any(stage is None for stage, _, _ in want)
