"""Traces, orders and contracts of the engine without data, and properties of its merges and codecs."""

from dataclasses import dataclass
from enum import Enum

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidestep.functions import wire
from tidestep.functions.format import expand
from tidestep.plans import conditions as when
from tidestep.plans.app import App, ContractError, Plugin, PluginGroup
from tidestep.plans.coupling import Mirror, Multi
from tidestep.plans.ordering import OrderError, missing_resources, ordered, remove, topological
from tidestep.plans.schedule import Group, Loop, NotConverged, OnMax, Phase, Scheduler, branch, loop_until, loop_while, sequence
from tidestep.plans.system import System, condition
from tidestep.plans.world import MissingResource, World
from tidestep.sources.config import Config, ConfigError, command_line, deep_merge, leaves
from tidestep.sources.run import InputPlugin, Stage, stages_of


class P(Enum):
    A = 0
    B = 1
    C = 2


class Q(Enum):
    X = 0


def logged(log, name, phase=P.A, **more):
    return System(name, lambda: log.append(name), phase, **more)


def run(tree, *systems, steps=1):
    s = Scheduler(World()).add(*systems)
    if tree:
        s.set_schedule(tree)
    s.organise()
    for _ in range(steps):
        s.run()
    return s


def test_loop_body_runs_before_its_condition():
    log = []
    run(sequence(P.A, loop_until(P.B, lambda w: len(log) >= 4, 10), P.C), logged(log, "A"), logged(log, "body", P.B), logged(log, "C", P.C))
    assert log == ["A", "body", "body", "body", "C"]


def test_loop_limits():
    log = []
    with pytest.raises(NotConverged, match="in 2 iterations"):
        run(loop_until(P.A, lambda w: False, 2, OnMax.RAISE), logged(log, "a"))
    assert log == ["a", "a"]
    run(sequence(loop_until(P.A, lambda w: False, 1, OnMax.ROLLBACK, P.B), P.C), logged(log, "a"), logged(log, "back", P.B), logged(log, "c", P.C))
    assert log[2:] == ["a", "back", "c"]
    with pytest.raises(ValueError):
        Loop(Phase(P.A), condition(lambda w: True), -1)
    log.clear()
    run(loop_until(P.A, lambda w: True, 0, OnMax.ROLLBACK, P.B), logged(log, "a"), logged(log, "back", P.B))
    assert log == ["back"]


def test_branches():
    log = []
    run(branch((lambda w: False, P.A), (lambda w: True, P.B), (lambda w: True, P.C)), logged(log, "a"), logged(log, "b", P.B), logged(log, "c", P.C))
    run(sequence(branch((lambda w: False, P.A))), logged(log, "a"))
    assert log == ["b"]


def test_order_is_first_in_first_out():
    log = []
    made = [logged(log, "A", after=("C",)), logged(log, "B"), logged(log, "C")]
    assert [s.name for s in topological(made)] == ["B", "C", "A"]
    assert [s.name for s in ordered([logged(log, "x", P.B), logged(log, "y", P.A), logged(log, "z", P.B)])] == ["y", "x", "z"]
    with pytest.raises(OrderError, match="cycle"):
        ordered([logged(log, "a", after=("b",)), logged(log, "b", after=("a",))])
    with pytest.raises(OrderError, match="requires the label"):
        run(None, logged(log, "a", requires=("nothing",)))


def test_schedules_refuse_doubt():
    log = []
    with pytest.raises(OrderError, match="twice"):
        Scheduler(World()).set_schedule(sequence(P.A, P.A))
    with pytest.raises(OrderError, match="overlap"):
        Scheduler(World()).set_schedule(sequence(P, P.A))
    with pytest.raises(OrderError, match="not in the schedule"):
        run(sequence(P.A), logged(log, "x", Q.X))


def test_missing_resources_are_listed_together():
    made = [System("s", lambda a, b: None, P.A, ("a", "b")), System("t", lambda c: None, P.B, ("c",), ("d",))]
    assert missing_resources(made, World().put("b", 1)) == [("s", "a"), ("t", "c")]
    with pytest.raises(MissingResource):
        World().get("x")


def test_run_if_asks_the_last_added_first():
    asked = []
    s = System("s", lambda: None, P.A).run_if(lambda w: asked.append("inner") or True).run_if(lambda w: asked.append("outer"))
    assert not s(World()) and asked == ["outer"]


def test_edge_conditions_fire_once():
    w = World().put("m", type("M", (), {"current": "a"})())
    c = when.on_enter_state("m", "a")
    assert [c(w), c(w)] == [True, False]
    w.get("m").current = "b"
    assert not c(w)
    w.get("m").current = "a"
    assert c(w)
    assert not when.every_n_steps(0)(w.put("clock", type("K", (), {"step": 0})()))


def test_groups():
    log = []
    own = loop_while("g", [logged(log, "two", after=("one",)), logged(log, "one")], lambda w: len(log) < 6, 10, P.A)
    run(Phase(P.A), own)
    assert log == ["one", "two"] * 3 and own.rounds == 3
    capped = Group("h", [logged(log, "x")], P.A, condition(lambda w: True), 2)
    run(Phase(P.A), capped)
    assert capped.rounds == 2
    reads = Group("r", [System("p", lambda a: 1, P.A, ("a",), (), ("b",)), System("q", lambda b: 2, P.A, ("b",), (), ("c",))]).as_system()
    assert reads.accesses() == {"a": "read", "b": "write", "c": "write"}
    log.clear()
    phased = Group("p", [logged(log, "late", P.B), Group("n", [logged(log, "early", after=("late",))], P.A)], P.A)
    s = run(Phase(P.A), phased.run_if(lambda w: True).label("l"), Group("no", [logged(log, "never")], P.A).run_if(lambda w: False))
    assert log == ["early", "late"] and set(phased.timings) == {"n", "late"}
    assert [x.split()[-1] for x in s.report().splitlines()] == ["p", "n", "late"]
    assert '"0:p/late"' in s.dot()


def test_setup_systems_may_require_labels_of_later_ones():
    s = Scheduler(World()).add_setup(logged([], "a", requires=("nothing",)))
    s.organise()


def test_absent_optionals_are_not_accessed():
    s = System("s", lambda a=None: None, P.A, optional=("a",))
    assert s.accesses(World()) == {} and s.accesses(World().put("a", 1)) == {"a": "read"}


def test_warnings_trace_and_dot(caplog, monkeypatch, tmp_path):
    s = Scheduler(World(), warnings_of=lambda phases: [f"no {phases[0]}"], dot_path=str(tmp_path / "s.dot")).add(logged([], "a"), logged([], "b", before=("a",)))
    monkeypatch.setenv("TIDESTEP_TRACE", "1")
    s.start(1)
    assert any(r.message.startswith("no ") for r in caplog.records) and "[step 0] A: b" in [r.message for r in caplog.records] and s.trace == []
    assert '"0:b" -> "0:a" [style=dashed]' in (tmp_path / "s.dot").read_text()
    caplog.clear()
    monkeypatch.setenv("TIDESTEP_NO_WARNINGS", "1")
    s.organise()
    assert not caplog.records


def test_clock_and_reductions_keep_their_precision(spark):
    from pyspark.sql import functions as F
    from tidestep.operators import reduce, states, steps

    frame = spark.createDataFrame([(1, i, 0.004) for i in range(5)], "k long, i long, dt double")
    step, time = steps.clock("k", F.col("dt"), "i")
    last = frame.select(step.alias("step"), time.alias("time")).orderBy("step").collect()[-1]
    assert last.step == 4 and last.time == pytest.approx(0.02)
    got = reduce.all_reduce(frame, "k", {"s": "dt"}, {"m": "dt"}).first()
    assert got.s == pytest.approx(0.02) and got.m == 0.004
    clash = frame.withColumn("__before", F.lit("x")).withColumn("before", F.lit("y"))
    assert states.entered(clash, "k", "before", "y", "i").columns == clash.columns


def test_removal_by_name_and_label():
    log = []
    made = [logged(log, "a").label("x"), logged(log, "b"), logged(log, "c").label("y")]
    assert [s.name for s in remove(made, label="x")] == ["b", "c"]
    assert [s.name for s in remove(made, name="b")] == ["a", "c"]


def test_undeclared_writes_are_refused():
    with pytest.raises(ValueError, match="without declaring"):
        System("s", lambda: {"x": 1}, P.A, writes=("y",))(World())


class Own(Plugin):
    def __init__(self, name, **more):
        self.name = name
        self.__dict__.update(more)

    def build(self, app):
        pass


def test_plugin_contracts():
    with pytest.raises(ContractError, match="twice"):
        App().add_plugins(Own("a"), Own("a"))
    with pytest.raises(ContractError, match="before it"):
        App().add_plugins(Own("a", dependencies=("b",)))
    with pytest.raises(ContractError, match="requires"):
        App().add_plugins(Own("a", requires=("x",))).start(1)
    kept = App().add_plugins(PluginGroup([Own("a")]).disable("a").add(Own("a", provides=("new",))).add(Own("b")))
    assert [(p.name, p.provides) for p in kept.plugins] == [("a", ()), ("b", ())]


def test_coupling():
    m = Multi().add_app("a", App().put("x", 1))
    with pytest.raises(ValueError):
        m.add_app("a", App())
    m.tick("a", 3)
    assert m.find("a").app.scheduler.step == 3 and m.read("b", "x") is None
    with pytest.raises(MissingResource):
        m.expect("a", "y")


def test_configuration(tmp_path):
    assert stages_of(Config()) == [Stage()]
    with pytest.raises(ConfigError):
        Config.read("x.json")
    with pytest.raises(ConfigError):
        Config.parse("a = [")
    path = tmp_path / "c.toml"
    path.write_text('[output]\ndir = "out"\n')
    config, given_ = command_line([str(path), "--generate-config"])
    assert given_.output_dir == "out" and given_.generate_config and command_line([], config)[0] is config
    app = App().add_plugins(InputPlugin([str(path), "--generate-config"]), Own("a", default_config="[a]"), Own("b", default_config="[b]"))
    app.add_systems(System("never", lambda: pytest.fail("the app ran"), P.A))
    assert app.start().printed == "[a]\n\n[b]" and app.world.get("input").output_dir == "out"
    assert not App().add_plugins(InputPlugin([str(path)])).generate_config


def test_unknown_fields_of_a_section():
    @dataclass
    class Open:
        n: int = 1

    class Strict(Open):
        DENY_UNKNOWN = True

    config = Config.parse("[k]\nn = 2\nodd = 3\n")
    assert config.section("k", Open) == Open(2) and config.section("none", Strict) == Strict()
    with pytest.raises(ConfigError, match="odd"):
        config.section("k", Strict)
    with pytest.raises(ConfigError, match="should be"):
        Config.parse('[k]\nn = "2"\n').section("k", Open)


def test_a_mirror_holds_resources_that_it_never_exchanges():
    board = {}
    m = Mirror("a", board, "b", World()).with_resource("own", 3).send_each_iteration("x", lambda: 1)
    m.step()
    assert m.find("own") == 3 and list(board) == [("b", 0, "x")]


trees = st.recursive(st.integers(), lambda x: st.dictionaries(st.sampled_from("abcd"), x, max_size=3), max_leaves=8)
tables = st.dictionaries(st.sampled_from("abcd"), trees, max_size=4)


@given(tables, tables)
@settings(max_examples=100, deadline=None)
def test_merge_keeps_what_is_laid_over(base, over):
    merged = deep_merge(base, over)
    assert all(leaves(merged)[p] == v for p, v in leaves(over).items() if v != {})
    assert deep_merge(merged, over) == merged and deep_merge(base, {}) == base


@given(st.text(), st.lists(st.floats(allow_nan=False)), st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**64 - 1), st.booleans(), st.floats(allow_nan=False))
@settings(max_examples=60, deadline=None)
def test_codecs_round_trip(text, vector, i64, u64, flag, f64):
    for kind, value in (("string", text), ("vec_f64", vector), ("i64", i64), ("u64", u64), ("bool", flag), ("f64", f64), ("f64x3", [f64, 0.0, 1.5])):
        assert wire.unpack(kind, wire.pack(kind, value)) == value
    assert wire.pack("i32", None) is None and len(wire.pack("f64x3", [1, 2, 3])) == 24


@pytest.mark.parametrize(("template", "want"), [("f_{step}.x", "f_7.x"), ("{step:06}", "000007"), ("{time}-{other}", "1.5-{other}"), ("open{step", "open{step")])
def test_path_templates(template, want):
    assert expand(template, 7, 1.5) == want


def test_extracted_parameters_and_handles():
    from tidestep.plans.system import system

    @system(P.A, writes=("y",), extract={"twice": lambda w: 2 * w.get("x")})
    def own(twice):
        return twice + 1

    w = World().put("x", 4)
    assert own.reads == () and own(w) and w.get("y") == 9
    m = Multi().add_app_with_config("a", Config.parse("[a.k]\nn = 2\n"), lambda app: app.put("n", app.world.get("config").table["k"]["n"]), {"k": {"n": 1, "m": 3}})
    assert m.at("a").get("n") == 2 and m.at("a").get("config").table["k"] == {"n": 2, "m": 3}
    m.at("a").put("n", 5)
    assert m.read("a", "n") == 5
    with pytest.raises(MissingResource):
        m.at("b").put("n", 1)


def test_stage_enums():
    from tidestep.plans.ordering import has, stage_at, stage_names

    assert stage_names(P) == ["a", "b", "c"] and stage_at(P, 1) is P.B and stage_at(P, 3) is None
    with pytest.raises(OrderError):
        stage_names(Enum("Twice", {"one": 0, "ONE": 1}))
    assert has([logged([], "a")], "a") and not has([], "a")


def test_printed_schedules():
    s = Scheduler(World()).add(logged([], "b", P.B), logged([], "a").run_if(when.in_stage("relax")))
    s.organise()
    assert s.printed() == "[A]\n  a if in_stage(relax)\n[B]\n  b"
    dot = s.dot(["relax", "flow"])
    assert '"0:a"' in dot and '"1:a"' not in dot and '"1:b"' in dot


def test_byte_frames(spark, tmp_path):
    from tidestep.sources.dump import FrameFiles

    spark.dataSource.register(FrameFiles)
    spark.createDataFrame([("a/1.bin", b"x"), ("b.bin", b"yz")], "path string, payload binary").write.format("frames").mode("append").option("path", str(tmp_path)).save()
    assert (tmp_path / "a/1.bin").read_bytes() == b"x" and (tmp_path / "b.bin").read_bytes() == b"yz"


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=14))
@settings(max_examples=150, deadline=None)
def test_orders_respect_edges(edges):
    """Edges from a lesser to a greater number never form a cycle; without edges the registration order stays."""
    wanted = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    made = [System(str(i), lambda: None, P.A, after=tuple(str(a) for a, b in wanted if b == i)) for i in reversed(range(8))]
    at = {s.name: k for k, s in enumerate(topological(made))}
    assert all(at[str(a)] < at[str(b)] for a, b in wanted)
    if not wanted:
        assert [s.name for s in topological(made)] == [s.name for s in made]


@given(st.lists(st.integers(0, 5), min_size=1, max_size=6), st.lists(st.booleans(), min_size=6, max_size=6))
@settings(max_examples=60, deadline=None)
def test_stage_walks_take_the_steps_that_they_say(steps, skips):
    from tidestep.sources.run import RunPlugin

    table = {"run": [{"name": f"s{i}", "steps": n, "skip": skips[i]} for i, n in enumerate(steps)]}
    app, seen = App(), []
    app.add_plugins(RunPlugin(Config(table)))
    app.add_systems(System("log", lambda: seen.append(app.control.stage_name), P.A))
    app.start(200)
    assert seen == [f"s{i}" for i, n in enumerate(steps) for _ in range(max(0 if skips[i] else n, 1))]


def test_pins_cut_the_lineage_of_a_loop_that_reads_itself(spark, sf):
    """Each round moves a price halfway to its customer's mean, which joins the frame with an aggregate of itself."""
    from pyspark.sql import functions as F

    def smooth(frame):
        means = frame.groupBy("k").agg(F.avg("x").alias("m"))
        return frame.join(means, "k").select("k", "id", ((F.col("x") + F.col("m")) / 2).alias("x"))

    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    spread = lambda w: w.get("frame").groupBy("k").agg((F.max("x") - F.min("x")).alias("s")).agg(F.max("s")).first()[0]
    w = World(spark).put("frame", orders)
    first = spread(w)
    loop = loop_until(P.A, lambda w: spread(w) < first / 30, 10, OnMax.RAISE, pin=("frame",))
    s = Scheduler(w).add(System("smooth", smooth, P.A, ("frame",), (), ("frame",))).set_schedule(loop)
    s.organise()
    s.run()
    assert s.iterations[id(loop)] == 5
    assert w.get("frame")._jdf.queryExecution().logical().toString().count("Join") == 0


def test_stages_of_a_config():
    """A stage's overrides over the run's config, sections that later stages may not say, and names against the states expected."""
    from tidestep.plans.ordering import set_namespace, unmet_labels
    from tidestep.sources.run import first_stage_warnings, stage_config, validate_stages

    config = Config.parse('[pump]\nrate = 1\nn = 5\n[[run]]\nname = "fill"\n[run.mesh]\nx = 1\n[[run]]\nname = "press"\n[run.pump]\nrate = 2\n[run.mesh]\nx = 1\n')
    stages = stages_of(config)
    assert [leaves(stage_config(config, s).table)["pump.rate"] for s in stages] == [1, 2]
    assert first_stage_warnings(stages, {"mesh", "wire"}) == [(1, "mesh")]
    assert validate_stages(stages, ["fill", "flow"]) == [(1, "flow", "press")]
    assert validate_stages(stages, ["fill"]) == [(1, None, "press")]
    set_namespace(Q, 100)
    made = [System("late", lambda: None, Q.X), System("b", lambda: None, P.B), System("a", lambda: None, P.A), System("a2", lambda: None, P.A)]
    assert [s.name for s in ordered(made)] == ["a", "a2", "b", "late"]
    assert unmet_labels([System("s1", lambda: None, P.A, requires=("x",)), System("s2", lambda: None, P.B, requires=("x",)), System("has", lambda: None, P.A, labels=("x",))]) == [("s2", "x")]
    set_namespace(Q, 0)


def test_batches_on_the_wire():
    """Whole batches as the values one by one, with nulls and slices of larger batches."""
    import pyarrow as pa

    kinds = {
        "f32": (pa.float32(), [1.5, None, -2.0]), "f64": (pa.float64(), [1e300, None, 0.1]), "i32": (pa.int32(), [-1, None, 7]), "i64": (pa.int64(), [None, -(2**40), 3]),
        "u32": (pa.int64(), [2**32 - 1, 0, None]), "u64": (pa.decimal128(20, 0), [2**64 - 1, None, 5]), "bool": (pa.bool_(), [True, None, False]), "f64x3": (pa.list_(pa.float64()), [[1.0, 2.0, 3.0], None, [0.0, 0.5, 9.0]]),
        "vec_f64": (pa.list_(pa.float64()), [[], None, [1.0, 2.5]]), "string": (pa.string(), ["naïve", None, ""]),
    }
    for kind, (arrow, values) in kinds.items():
        for given in (pa.array(values, arrow), pa.array([*values, *values], arrow).slice(2, 3), pa.array([], arrow)):
            sent = wire.encode(kind, given)
            assert sent.to_pylist() == [wire.pack(kind, v) for v in given.to_pylist()]
            for raw in (sent, pa.concat_arrays([sent, sent]).slice(1, len(sent))):
                assert wire.decode(kind, raw).to_pylist() == [wire.unpack(kind, b) for b in raw.to_pylist()]


def test_a_schedule_is_organised_and_drawn_once_a_setup(tmp_path, caplog):
    seen = []
    s = Scheduler(World(), warnings_of=lambda phases: ["careful"], dot_path=str(tmp_path / "schedule.dot")).add(logged(seen, "a"))
    with caplog.at_level("INFO"):
        s.start(1)
    assert seen == ["a"] and "digraph" in (tmp_path / "schedule.dot").read_text()
    assert [r.message for r in caplog.records].count("careful") == 1


def test_generated_configuration_is_printed(capsys):
    class Named(Plugin):
        is_unique = False

        def __init__(self, name, text):
            self.name, self.default_config = name, text

        def build(self, app):
            pass

    app = App().add_plugins(Named("a", "[a]\nx = 1\n\n"), Named("b", "\n[b]"))
    app.generate_config = True
    app.start()
    assert "[a]\nx = 1\n\n[b]\n" in capsys.readouterr().out
