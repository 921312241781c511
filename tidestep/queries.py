"""The engine's queries by name, each through the engine's own operators, and the SQL that states what they return."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidestep.functions import format as fmt
from tidestep.functions import names, wire
from tidestep.operators import observe, reduce, registry, states, steps
from tidestep.operators.overlay import folded, under_each
from tidestep.operators.scan import as_of, prefix_scan
from tidestep.operators.topology import levels
from tidestep.plans import conditions as when
from tidestep.plans.app import App, ContractError, FunctionPlugin, Plugin, PluginGroup, StatesPlugin
from tidestep.plans.coherence import Coherence
from tidestep.plans.coupling import Mirror, Multi, OuterIterations
from tidestep.plans.delta import DeltaLoop, recursive
from tidestep.plans.ordering import OrderError, chain_namespaces, ordered
from tidestep.plans.schedule import Group, NotConverged, OnMax, Phase, Scheduler, State, branch, loop_until, loop_while, sequence
from tidestep.plans.states import StateMachine, check_stage_advance
from tidestep.plans.system import System, system
from tidestep.plans.world import World
from tidestep.sources.config import Config, parsed_arrays
from tidestep.sources.dump import DumpConfig, DumpPlugin, write_frames
from tidestep.sources.frames import read_steps, write_steps
from tidestep.sources.run import RunPlugin, stage_frame, stages_of
from tidestep.sources.versions import Versions
from tidestep.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: What a driver does without any table, as rows and as SQL: kept for the tests, not registered.
DRIVER_CHECKS: dict[str, tuple[Query, str]] = {}


def driver_check(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        DRIVER_CHECKS[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


class Step(Enum):
    A = 0
    B = 1
    C = 2
    BACK = 3


def world_of(spark: SparkSession, d: str, **frames: DataFrame) -> World:
    w = World(spark)
    for n, f in frames.items():
        w.put(n, f)
    return w


def prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))


def arithmetic(name: str, phase: Step, change, **more) -> System:
    return System(name, lambda frame: frame.withColumn("x", change(F.col("x"))), phase, ("frame",), (), ("frame",), **more)


def driven(world: World, tree, *systems: System | Group) -> Scheduler:
    s = Scheduler(world, keep_trace=True)
    s.add(*systems).set_schedule(tree)
    s.organise()
    s.run()
    return s


# --- state access -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders")
def res_read(spark, d):
    w = world_of(spark, d, orders=table(spark, d, "orders"))
    System("read", lambda orders: orders.select("o_orderkey", "o_totalprice"), None, ("orders",), (), ("out",))(w)
    return w.get("out")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS x FROM lineitem")
def resmut_update(spark, d):
    w = world_of(spark, d, frame=table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"))
    System("charge", lambda frame: frame.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x")), None, ("frame",), (), ("frame",))(w)
    return w.get("frame")


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer")
def resource_replace(spark, d):
    w = World(spark).put("t", table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v")))
    return w.put("t", table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), same_schema=True).get("t")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) AS BIGINT) AS call_no FROM events")
def local_counter(spark, d):
    return table(spark, d, "events").select("event_id", steps.counter("user_id", "ts", "event_id").alias("call_no"))


@query("SELECT d.doc_id, coalesce(l.quality,-1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id")
def res_optional(spark, d):
    w = world_of(spark, d, documents=table(spark, d, "documents").select("doc_id"), labels=table(spark, d, "labels").select("doc_id", "quality"))

    @system(writes=("out",), optional=("labels",))
    def judge(documents, labels):
        return documents.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality")) if labels is not None else documents.withColumn("quality", F.lit(-1))

    judge(w)
    return w.get("out")


@query("SELECT doc_id AS name FROM documents WHERE source IS DISTINCT FROM 'src3'")
def remove_by_label(spark, d):
    """Documents stand for systems, labelled by their source."""
    return registry.without_label(table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.col("source").alias("label")), "src3").select("name")


# --- ordering -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 100 WHEN 'view' THEN 101 WHEN 'purchase' THEN 200 ELSE 300 END, event_id) AS BIGINT) AS pos FROM events")
def phase_sort(spark, d):
    """Events stand for systems whose types are phases in chained namespaces: sorted by phase, those of one phase as they came."""
    namespaces = {"signup": 0, "click": 100, "view": 101, "purchase": 200}
    phase = F.coalesce(*(F.when(F.col("event_type") == t, n) for t, n in namespaces.items()), F.lit(300))
    events = table(spark, d, "events").select("event_id", phase.alias("phase"))
    return steps.global_steps(events, "phase", "event_id").select("event_id", (F.col("step") + 1).alias("pos"))


@query("WITH RECURSIVE e AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS a, lag(event_id, 2) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS b FROM events), l AS (SELECT event_id, 0 AS level FROM e WHERE a IS NULL AND b IS NULL UNION SELECT e.event_id, l.level + 1 FROM l JOIN e ON e.a = l.event_id OR e.b = l.event_id) SELECT event_id, CAST(max(level) AS BIGINT) AS level FROM l GROUP BY event_id")
def topo_order(spark, d):
    """An event comes after the one before it of its user's day, and after the second one before it of its type's hour: levels of a topological order."""
    day, hour = Window.partitionBy("user_id", F.to_date("ts")).orderBy("event_id"), Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("event_id")
    events = table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), F.array(F.lag("event_id").over(day), F.lag("event_id", 2).over(hour)).alias("comes_after"))
    edges = events.select(F.explode("comes_after").alias("before"), F.col("event_id").alias("after")).filter("before IS NOT NULL")
    return levels(events.select("event_id", "day"), edges, "event_id", near="day")


@query("SELECT event_id, user_id FROM events r WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events h WHERE h.event_type = 'signup' AND h.user_id = r.user_id AND CAST(h.ts AS DATE) = CAST(r.ts AS DATE))")
def requires_label(spark, d):
    """A purchase requires a system labelled signup in its own group, the user's day."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return registry.unprovided(events.filter("event_type = 'purchase'"), events.filter("event_type = 'signup'"), ["user_id", "day"]).select("event_id", "user_id")


@query("SELECT doc_id AS sys, doc_id AS res FROM documents WHERE lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_resources(spark, d):
    """Documents read their label; those in English can do without."""
    reads = table(spark, d, "documents").select(F.col("doc_id").alias("sys"), F.col("doc_id").alias("res"), (F.col("lang") == "en").alias("opt"))
    return registry.missing(reads, table(spark, d, "labels").select(F.col("doc_id").alias("res")))


@driver_check("SELECT * FROM (VALUES ('setup',CAST(0 AS BIGINT)),('namespace',CAST(1 AS BIGINT)),('cycle',CAST(2 AS BIGINT))) t(name,ns)")
def namespace_chain(spark, d):
    """Systems added before their enums are chained follow the chain; a cycle is refused."""
    classes = {n: Enum(n, {"ONLY": 0}) for n in ("cycle", "namespace", "setup")}
    made = [System(n, lambda: None, c.ONLY) for n, c in classes.items()]
    chain_namespaces(classes["setup"], classes["namespace"], classes["cycle"])
    try:
        ordered([System("a", lambda: None, Step.A, after=("b",)), System("b", lambda: None, Step.A, after=("a",))])
        raise AssertionError("the cycle passed")
    except OrderError:
        return rows(spark, "name string, ns long", *((s.name, i) for i, s in enumerate(ordered(made))))


# --- run conditions -----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN (SELECT count(*) FROM orders)>1000 THEN o_totalprice*2 ELSE o_totalprice END AS x FROM orders")
def run_if_gate(spark, d):
    w = world_of(spark, d, frame=prices(spark, d))
    arithmetic("double", Step.A, lambda x: x * 2).run_if(lambda w: w.get("frame").count() > 1000)(w)
    return w.get("frame")


@query("SELECT event_id,user_id FROM events WHERE event_id % 100 = 0")
def every_n_steps(spark, d):
    return steps.every(table(spark, d, "events").select("event_id", "user_id"), "event_id", 100)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def in_state(spark, d):
    return states.in_state(table(spark, d, "events"), "event_type", "purchase").select("event_id", "user_id")


@query("SELECT event_id,user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts,event_id) AS prev FROM events) t WHERE event_type='error' AND (prev IS NULL OR prev<>'error')")
def on_enter_state(spark, d):
    return states.entered(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", "error", "ts", "event_id").select("event_id", "user_id")


STAGED = Config.parse('[[run]]\nname = "settle"\nsteps = 40\n[[run]]\nname = "production"\nsteps = 100\n')


def staged_events(spark: SparkSession, d: str, config: Config = STAGED) -> DataFrame:
    events = steps.global_steps(table(spark, d, "events").select("ts", "event_id"), "ts", "event_id")
    return steps.in_stage_steps(events, stage_frame(spark, stages_of(config)))


EV = "SELECT event_id, row_number() OVER (ORDER BY ts,event_id)-1 AS step FROM events"


@query(f"WITH ev AS ({EV}) SELECT event_id FROM ev WHERE step >= 40 AND step < 140")
def in_stage(spark, d):
    return states.in_state(staged_events(spark, d), "name", "production").select("event_id")


@query(f"WITH ev AS ({EV}) SELECT event_id, CASE WHEN step = 0 THEN 'settle' ELSE 'production' END AS stage FROM ev WHERE step IN (0, 40)")
def on_enter_stage(spark, d):
    return staged_events(spark, d).filter(F.col("step") == F.col("lo")).select("event_id", F.col("name").alias("stage"))


@query(f"WITH ev AS ({EV}) SELECT event_id FROM ev WHERE step < 40")
def first_stage_only(spark, d):
    return staged_events(spark, d).filter("i = 0").select("event_id")


@driver_check("SELECT * FROM (VALUES (CAST(0 AS BIGINT), true, true, true, true), (CAST(1 AS BIGINT), false, true, false, true), (CAST(2 AS BIGINT), true, false, true, false), (CAST(3 AS BIGINT), false, false, false, false)) t(step, every2, in_a, enters, first_stage)")
def driver_conditions(spark, d):
    """The driver's conditions over a world's clock, state machine and stages: 'enters' fires at each change of state."""
    from tidestep.sources.run import Clock

    w, clock, machine = World(spark), Clock(), StateMachine("a")
    app = App(spark)
    w.put("clock", clock).put("m", machine).put("run_control", app.control)
    every, inside, first = when.every_n_steps(2), when.in_state("m", "a"), when.first_stage_only()
    enters = [when.on_enter_state("m", s) for s in "ab"]
    out = []
    for step in range(4):
        out.append((step, every(w), inside(w), any([c(w) for c in enters]), first(w)))
        clock.advance()
        if step == 1:
            machine.set("b")
            machine.apply()
            app.control.index = 1
    return rows(spark, "step long, every2 boolean, in_a boolean, enters boolean, first_stage boolean", *out)


# --- control flow -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, ((o_totalprice+1)*2)-3 AS x FROM orders")
def sequence_(spark, d):
    w = world_of(spark, d, frame=prices(spark, d))
    driven(w, sequence(Step.A, Step.B, Step.C), arithmetic("c", Step.C, lambda x: x - 3), arithmetic("a", Step.A, lambda x: x + 1), arithmetic("b", Step.B, lambda x: x * 2))
    return w.get("frame")


QUERIES["sequence"] = QUERIES.pop("sequence_")
SQL["sequence"] = SQL.pop("sequence_")


@query("SELECT o_orderkey, (o_totalprice*2)+1 AS x FROM orders")
def sequence_variant(spark, d):
    """The tree, not the enum, gives the order."""
    w = world_of(spark, d, frame=prices(spark, d))
    driven(w, sequence(Step.B, Step.A), arithmetic("a", Step.A, lambda x: x + 1), arithmetic("b", Step.B, lambda x: x * 2))
    return w.get("frame")


@query("SELECT o_orderkey, (o_totalprice+1)*2 AS x FROM orders")
def flat_run(spark, d):
    w = world_of(spark, d, frame=prices(spark, d))
    s = Scheduler(w).add(arithmetic("b", Step.B, lambda x: x * 2), arithmetic("a", Step.A, lambda x: x + 1))
    s.prepare()
    s.run()
    return w.get("frame")


@query("SELECT o_orderkey, ((o_totalprice+3)*4) AS x FROM orders")
def system_group_phases(spark, d):
    """A group's systems are ordered within each phase: an edge to a system of a later phase doesn't move it. Groups nest and can be gated."""
    w = world_of(spark, d, frame=prices(spark, d))
    nested = Group("nested", [arithmetic("add", Step.A, lambda x: x + 3, after=("times",))], Step.A)
    group = Group("outer", [arithmetic("times", Step.B, lambda x: x * 4), nested], Step.A)
    driven(w, sequence(Step.A), group, Group("never", [arithmetic("ten", Step.A, lambda x: x * 10)], Step.A).run_if(lambda w: False))
    return w.get("frame")


@query("SELECT o_orderkey, ((o_totalprice+1)*2)*10 AS x FROM orders")
def system_group(spark, d):
    w = world_of(spark, d, frame=prices(spark, d))
    inner = Group("inner", [arithmetic("two", Step.A, lambda x: x * 2, after=("one",)), arithmetic("one", Step.A, lambda x: x + 1)], Step.A)
    driven(w, sequence(Step.A, Step.B), arithmetic("ten", Step.B, lambda x: x * 10), inner)
    return w.get("frame")


LOOP = "WITH RECURSIVE it(n,mx) AS (SELECT 0, max(o_totalprice) FROM orders UNION ALL SELECT n+1, mx/2 FROM it WHERE n<20 AND (n=0 OR mx>=1000)), k AS (SELECT max(n) AS n FROM it) SELECT o_orderkey, o_totalprice/power(2,k.n) AS x, k.n AS iters FROM orders CROSS JOIN k"


def halve() -> System:
    return arithmetic("halve", Step.A, lambda x: x / 2)


def below(limit: float):
    return lambda w: w.get("frame").agg(F.max("x")).first()[0] < limit


@query(LOOP)
def loop_until_(spark, d):
    w = world_of(spark, d, frame=prices(spark, d))
    loop = loop_until(Step.A, below(1000), 20)
    s = driven(w, loop, halve())
    return w.get("frame").withColumn("iters", F.lit(s.iterations[id(loop)]))


QUERIES["loop_until"] = QUERIES.pop("loop_until_")
SQL["loop_until"] = SQL.pop("loop_until_")


@query(LOOP)
def loop_measured(spark, d):
    """The metric comes with the write of the round: one job a round."""
    w = world_of(spark, d, frame=prices(spark, d))
    loop = loop_until(Step.A, when.measured("frame", lambda seen: seen["most"] < 1000, most=F.max("x")), 20)
    s = driven(w, loop, halve())
    return w.get("frame").withColumn("iters", F.lit(s.iterations[id(loop)]))


OWN_LOOP = "WITH RECURSIVE it AS (SELECT o_orderkey, o_totalprice / 2 AS x, 1 AS n FROM orders UNION ALL SELECT o_orderkey, x / 2, n + 1 FROM it WHERE x >= 1000 AND n < {most})"


@query(OWN_LOOP.format(most=20) + " SELECT o_orderkey, x, n AS iters, x < 1000 AS converged FROM it WHERE x < 1000 OR n = 20")
def delta_halving(spark, d):
    """Each order halves until it is below 1000, leaves the loop then and keeps its own count; a round reads what is left."""
    loop = DeltaLoop(lambda f: f.withColumn("x", F.col("x") / 2), F.col("x") < 1000, 20)
    return loop.run(prices(spark, d)).select("o_orderkey", "x", F.col("iterations").alias("iters"), "converged")


@query(OWN_LOOP.format(most=20) + " SELECT o_orderkey, x, n AS iters, x < 1000 AS converged FROM it WHERE x < 1000 OR n = 20")
def recursive_halving(spark, d):
    """The same loop as one recursive plan."""
    return recursive(prices(spark, d), {"x": "x / 2"}, "x < 1000", 20).select("o_orderkey", "x", F.col("iterations").alias("iters"), "converged")


@query(OWN_LOOP.format(most=6) + " SELECT i.o_orderkey, CASE WHEN x < 1000 THEN x ELSE o_totalprice END AS x, n AS iters, x < 1000 AS converged FROM it i JOIN orders o ON o.o_orderkey = i.o_orderkey WHERE x < 1000 OR n = 6")
def delta_rollback(spark, d):
    """Orders that six rounds don't bring below 1000 come out as they went in."""
    loop = DeltaLoop(lambda f: f.withColumn("x", F.col("x") / 2), F.col("x") < 1000, 6, OnMax.ROLLBACK)
    return loop.run(prices(spark, d), ["o_orderkey"]).select("o_orderkey", "x", F.col("iterations").alias("iters"), "converged")


@query("SELECT o_orderkey, o_totalprice/8 AS x FROM orders")
def loop_accept(spark, d):
    w = world_of(spark, d, frame=prices(spark, d))
    driven(w, loop_until(Step.A, below(1), 3), halve())
    return w.get("frame")


@query(LOOP)
def loop_while_(spark, d):
    w = world_of(spark, d, frame=prices(spark, d))
    own = loop_while("halving", [halve()], lambda w: w.get("frame").agg(F.max("x")).first()[0] >= 1000, 20, Step.A)
    driven(w, Phase(Step.A), own)
    return w.get("frame").withColumn("iters", F.lit(own.rounds))


QUERIES["loop_while"] = QUERIES.pop("loop_while_")
SQL["loop_while"] = SQL.pop("loop_while_")


@query("SELECT 'not_converged' AS status, CAST(3 AS BIGINT) AS iters")
def loop_panic(spark, d):
    w, loop = world_of(spark, d, frame=prices(spark, d)), loop_until(Step.A, below(1), 3, OnMax.RAISE)
    s = Scheduler(w).add(halve()).set_schedule(loop)
    s.organise()
    try:
        s.run()
        status = "converged"
    except NotConverged:
        status = "not_converged"
    return rows(spark, "status string, iters long", (status, s.iterations[id(loop)]))


@query("SELECT o_orderkey, o_totalprice AS x, true AS rolled_back FROM orders")
def loop_rollback(spark, d):
    w = world_of(spark, d, frame=prices(spark, d)).put("rolled_back", False)
    save = System("save", lambda: w.snapshot("frame"), Step.B)
    back = System("back", lambda: {"rolled_back": w.restore("frame")}, Step.BACK, writes=("rolled_back",))
    driven(w, sequence(Step.B, loop_until(Step.A, below(1), 3, OnMax.ROLLBACK, Step.BACK)), save, halve(), back)
    return w.get("frame").withColumn("rolled_back", F.lit(w.get("rolled_back")))


TRACE = "SELECT * FROM (VALUES {}) t(seq, phase, system)"


@driver_check(TRACE.format(", ".join(f"(CAST({i} AS BIGINT),'{p}','{s}')" for i, (p, s) in enumerate([("A", "body"), ("A", "body"), ("BACK", "back")] * 2))))
def retry_loop(spark, d):
    """Two tries of a loop of two rounds, each rolled back."""
    w = world_of(spark, d, frame=prices(spark, d))
    w.snapshot("frame")
    inner = loop_until(Step.A, lambda w: False, 2, OnMax.ROLLBACK, Step.BACK)
    body = arithmetic("body", Step.A, lambda x: x / 2)
    s = driven(w, loop_until(inner, lambda w: False, 2), body, System("back", lambda: None if w.restore("frame") else None, Step.BACK))
    return rows(spark, "seq long, phase string, system string", *((i, p, n) for i, (_, _, p, n) in enumerate(s.trace)))


@query("SELECT o_orderkey, CASE WHEN o_totalprice<50000 THEN 'A' WHEN o_totalprice<150000 THEN 'B' END AS arm FROM orders")
def branch_first_match(spark, d):
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(x < 50000, "A").when(x < 150000, "B").alias("arm"))


@query("SELECT o_orderkey, o_totalprice*2 AS x FROM orders")
def branch_tree(spark, d):
    """Of a branch's arms the first that holds runs, once; a branch without a match changes nothing."""
    w = world_of(spark, d, frame=prices(spark, d))
    some = lambda w: w.get("frame").count() > 0
    tree = sequence(branch((lambda w: False, Step.A), (some, Step.B), (some, Step.C)), branch((lambda w: False, Step.BACK)))
    driven(w, tree, arithmetic("a", Step.A, lambda x: x + 1), arithmetic("b", Step.B, lambda x: x * 2), arithmetic("c", Step.C, lambda x: x * 5), arithmetic("d", Step.BACK, lambda x: x * 7))
    return w.get("frame")


@driver_check(TRACE.format(", ".join(f"(CAST({i} AS BIGINT),'{p}','{s}')" for i, (p, s) in enumerate([("SETUP", "init"), ("A", "work"), ("A", "work"), ("A", "stop"), ("END", "with_app"), ("END", "plain")]))))
def lifecycle(spark, d):
    app, seen = App(spark), []
    app.on_cleanup(lambda: seen.append(("END", "plain"))).on_cleanup(lambda a: seen.append(("END", "with_app")), with_app=True)
    outer = OuterIterations(2)
    app.add_setup_systems(System("init", lambda: seen.append(("SETUP", "init")), None))
    app.add_systems(System("stop", lambda: outer.step(app) or (seen.append(("A", "stop")) if app.is_done() else None), Step.B), System("work", lambda: seen.append(("A", "work")), Step.A))
    app.start()
    assert app.control.state is State.END
    return rows(spark, "seq long, phase string, system string", *((i, p, n) for i, (p, n) in enumerate(seen)))


# --- state machines, stages, snapshots ------------------------------------------------------------------------------


@query("SELECT event_id, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),'init') AS state FROM (SELECT *, CASE WHEN event_type IN ('signup','error') THEN event_type END AS p FROM events) t")
def apply_transitions(spark, d):
    pending = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", states.applied(pending, "init", "user_id", "ts", "event_id").alias("state"))


@query("SELECT event_id, CAST(CASE WHEN n>3 THEN 3 ELSE n END AS BIGINT) AS stage FROM (SELECT event_id, sum(chg) OVER (PARTITION BY user_id ORDER BY ts,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, CASE WHEN event_type='error' AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts,event_id),'')<>'error' THEN 1 ELSE 0 END AS chg FROM events) a) b")
def stage_advance(spark, d):
    return states.stage_of_entries(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", "error", 3, "ts", "event_id").select("event_id", "stage")


@driver_check("SELECT * FROM (VALUES (CAST(0 AS BIGINT),'fill',false),(CAST(1 AS BIGINT),'relax',false),(CAST(2 AS BIGINT),'flow',true),(CAST(3 AS BIGINT),'fill',true),(CAST(4 AS BIGINT),'fill',true)) t(i, state, advance)")
def stage_machine(spark, d):
    """A pending state is dropped when the stage changes; a state that the user changes asks for the next stage."""
    machine, app = StateMachine("fill"), App(spark)
    stages, out = ["fill", "relax", "flow"], []
    check_stage_advance(machine, app.control, stages)
    out.append((0, machine.current, app.control.advance_requested))
    machine.set("flow")
    app.control.index = 1
    check_stage_advance(machine, app.control, stages)
    machine.apply()
    out.append((1, machine.current, app.control.advance_requested))
    machine.set("flow")
    machine.apply()
    check_stage_advance(machine, app.control, stages)
    out.append((2, machine.current, app.control.advance_requested))
    # the new stage's state is there already, so what is pending stays
    app.control.index, app.control.advance_requested = 2, False
    machine.set("fill")
    check_stage_advance(machine, app.control, stages)
    machine.apply()
    check_stage_advance(machine, app.control, stages)
    out.append((3, machine.current, app.control.advance_requested))
    app.control.index = 3  # past the last stage
    check_stage_advance(machine, app.control, stages)
    out.append((4, machine.current, app.control.advance_requested))
    return rows(spark, "i long, state string, advance boolean", *out)


@query("SELECT o_orderkey, o_totalprice AS x FROM orders")
def snapshot_restore(spark, d):
    w = world_of(spark, d, frame=prices(spark, d))
    w.snapshot("frame")
    halve()(w)
    assert w.restore("frame")
    return w.get("frame")


@query("""
WITH v1 AS (SELECT o_orderkey, o_totalprice AS x FROM orders),
v2 AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 2 ELSE o_totalprice END AS x FROM orders WHERE o_orderstatus <> 'P')
SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v1""")
def versioned_orders(spark, d):
    """A saved frame, an update with removed rows, and the first version restored: what each version holds, read from its files."""
    import uuid

    store = Versions(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}")
    orders = table(spark, d, "orders")
    store.save("orders", orders.select("o_orderkey", F.col("o_totalprice").alias("x")), "o_orderkey")
    store.update("orders", orders.filter("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_totalprice") / 2).alias("x")), orders.filter("o_orderstatus = 'P'").select("o_orderkey"))
    store.restore("orders", 1)
    held = [store.load("orders", v).select(F.lit(v).alias("version"), "o_orderkey", "x") for v in store.versions("orders")]
    return held[0].unionByName(held[1]).unionByName(held[2])


@query("SELECT o_orderkey, o_totalprice/2 AS x FROM orders")
def restore_noop(spark, d):
    w = world_of(spark, d, frame=prices(spark, d))
    halve()(w)
    assert not w.restore("frame")
    return w.get("frame")


@query("SELECT o_orderkey, o_totalprice AS x FROM orders")
def subapp_snapshot(spark, d):
    app = App(spark).put("frame", prices(spark, d)).add_systems(halve())
    m = Multi().add_app("solver", app)
    m.snapshot("solver", "frame")
    m.tick("solver", 2)
    m.restore("solver", "frame")
    return m.read("solver", "frame")


# --- plugins ------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey * 8 + l_linenumber AS name, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey * 8 + l_linenumber HAVING count(*) > 1")
def plugin_duplicates(spark, d):
    """Lines stand for plugins, named by order and number; those not returned may repeat."""
    return registry.duplicates(table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("name"), (F.col("l_returnflag") != "N").alias("uniq")))


@query("SELECT event_id AS plugin, user_id || ':signup' AS dep FROM events d WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = d.user_id AND p.event_type = 'signup' AND p.event_id < d.event_id)")
def ordered_dependencies(spark, d):
    """A purchase depends on a signup of its user that stands before it."""
    events = table(spark, d, "events")
    deps = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("plugin"), F.concat(F.col("user_id").cast("string"), F.lit(":signup")).alias("dep"), F.col("event_id").alias("pos"))
    return registry.unordered_dependencies(deps, events.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("name"), F.col("event_id").alias("pos")))


@query("SELECT c_nationkey AS cap, c_custkey AS plugin FROM customer ANTI JOIN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) s ON c_nationkey = s_nationkey")
def capability_contracts(spark, d):
    """Customers require a rich supplier of their nation."""
    required = table(spark, d, "customer").select(F.col("c_nationkey").alias("cap"), F.col("c_custkey").alias("plugin"))
    return registry.unprovided(required, table(spark, d, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("cap")), "cap")


class Named(Plugin):
    is_unique = False

    def __init__(self, name: str, **more) -> None:
        self.name = name
        for k, v in more.items():
            setattr(self, k, v)

    def build(self, app: App) -> None:
        app.put(f"built_{self.name}", True)


@driver_check("SELECT * FROM (VALUES (CAST(0 AS BIGINT),'A'),(CAST(1 AS BIGINT),'B'),(CAST(2 AS BIGINT),'D')) t(i, name)")
def group_disable(spark, d):
    """Disabling acts on what is added later: B is there already, C isn't."""
    app = App(spark).add_plugins(PluginGroup([Named("A"), Named("B")]).disable("B").disable("C").add(Named("C")).add(Named("D")))
    return rows(spark, "i long, name string", *((i, p.name) for i, p in enumerate(app.plugins)))


@driver_check("SELECT * FROM (VALUES ('capability'),('dependency'),('duplicate')) t(refused)")
def contract_errors(spark, d):
    """An app refuses a second unique plugin and a dependency that isn't there yet at once, a missing capability at its start."""
    refused = []
    for name, build in (
        ("duplicate", lambda: App(spark).add_plugins(Named("A", is_unique=True), Named("A", is_unique=True))),
        ("dependency", lambda: App(spark).add_plugins(Named("B", dependencies=("A",)))),
        ("capability", lambda: App(spark).add_plugins(Named("C", requires=("x",)), FunctionPlugin(lambda app: None), StatesPlugin("m", "a")).start(1)),
    ):
        try:
            build()
        except ContractError:
            refused.append((name,))
    return rows(spark, "refused string", *refused)


@query("SELECT l_orderkey, string_agg('[part.' || l_partkey || ']' || chr(10) || 'flag = \"' || l_returnflag || '\"', chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS cfg FROM lineitem GROUP BY l_orderkey")
def generate_config(spark, d):
    """A config of each order, of its lines' snippets."""
    snip = F.concat(F.lit("[part."), F.col("l_partkey").cast("string"), F.lit(']\nflag = "'), "l_returnflag", F.lit('"'))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("i"), snip.alias("snip"))
    return observe.joined_snippets(lines, "i", "snip", by=["l_orderkey"])


# --- configuration, stages, observation -----------------------------------------------------------------------------


@query("SELECT p_partkey AS path, coalesce(c.v, p_retailprice) AS v FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS v FROM lineitem WHERE l_discount > 0.08 GROUP BY l_partkey) c ON p_partkey = l_partkey")
def section_defaults(spark, d):
    """Prices of parts: the default, or what lines with a high discount say."""
    said = table(spark, d, "lineitem").filter("l_discount > 0.08").groupBy(F.col("l_partkey").alias("path")).agg(F.max("l_extendedprice").alias("v"))
    return registry.with_defaults(table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("v")), said)


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract_string(props,'$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id")
def parse_array(spark, d):
    """Each user's events as an array of tables in one text, parsed by type: every element once, in its place."""
    texts = table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: F.concat(F.lit("[[event]]\nk = "), F.get_json_object(x["props"], "$.k"))), "\n").alias("text"))
    parsed = parsed_arrays(texts, "user_id", "text", "event", "k long")
    return parsed.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@driver_check("SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(1.5 AS DOUBLE)), (CAST(1 AS BIGINT), CAST(-2.0 AS DOUBLE))) t(i, gx)")
def config_array(spark, d):
    forces = Config.parse("[[force]]\ngx = 1.5\n[[force]]\ngx = -2.0\n").array("force")
    return rows(spark, "i long, gx double", *((i, f["gx"]) for i, f in enumerate(forces)))


@query("""
WITH b AS (SELECT 'part.' || p_partkey || '.size' AS path, CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT 'part.' || p_partkey || '.brand.name', p_brand FROM part),
o AS (SELECT 'part.' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '.size' WHEN 1 THEN '' WHEN 2 THEN '.size.least' WHEN 3 THEN '.brand' ELSE '.brand.owner' END AS path, 'over' AS v FROM part)
SELECT path, v FROM o UNION ALL SELECT path, v FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = b.path OR starts_with(b.path, o.path || '.') OR starts_with(o.path, b.path || '.'))""")
def deep_merge(spark, d):
    """Two leaves of every part, overlaid by a third: on a leaf, in place of the whole part, below a leaf, in place of a table, beside a leaf."""
    part = table(spark, d, "part")
    path = lambda leaf: F.concat(F.lit("part."), F.col("p_partkey").cast("string"), leaf)
    base = part.select(path(F.lit(".size")).alias("path"), F.col("p_size").cast("string").alias("v")).unionByName(part.select(path(F.lit(".brand.name")).alias("path"), F.col("p_brand").alias("v")))
    leaf = F.element_at(F.array(*(F.lit(x) for x in (".size", "", ".size.least", ".brand", ".brand.owner"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return registry.overlaid(base, part.select(path(leaf).alias("path"), F.lit("over").alias("v")))


@query("SELECT substring(path, 6) AS path, v FROM (SELECT source || '.' || lang || '.' || doc_id AS path, n_chars AS v FROM documents) WHERE path LIKE 'src3.%'")
def subapp_config(spark, d):
    """The lengths of the documents by source, language and id; what stands below one source."""
    paths = table(spark, d, "documents").select(F.concat_ws(".", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("v"))
    return registry.below(paths, "src3")


@query("SELECT event_id, CAST(row_number() OVER w - 1 AS BIGINT) AS step, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS time FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts,event_id)")
def sim_clock(spark, d):
    step, time = steps.clock("user_id", F.col("value").cast("decimal(18,2)"), "ts", "event_id")
    return table(spark, d, "events").select("event_id", step.alias("step"), time.alias("time"))


@query(f"WITH st AS (SELECT name, steps, sum(steps) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-steps AS lo FROM (VALUES (0,'settle',40),(1,'production',100)) v(i,name,steps)), ev AS ({EV}) SELECT ev.event_id, st.name AS stage, CAST(ev.step-st.lo AS BIGINT) AS stage_step FROM ev JOIN st ON ev.step>=st.lo AND ev.step<st.lo+st.steps")
def run_stages(spark, d):
    return staged_events(spark, d).select("event_id", F.col("name").alias("stage"), (F.col("step") - F.col("lo")).alias("stage_step"))


@query(f"WITH st AS (SELECT i,name,steps,sum(CASE WHEN steps<1 THEN 1 ELSE steps END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-CASE WHEN steps<1 THEN 1 ELSE steps END AS lo FROM (VALUES (0,'a',3),(1,'b',0),(2,'c',2)) v(i,name,steps)), ev AS ({EV}) SELECT ev.event_id, st.name AS stage, st.steps=0 AS ghost FROM ev JOIN st ON ev.step>=st.lo AND ev.step<st.lo+CASE WHEN st.steps<1 THEN 1 ELSE st.steps END")
def stage_skip(spark, d):
    config = Config.parse('[[run]]\nname = "a"\nsteps = 3\n[[run]]\nname = "b"\nskip = true\n[[run]]\nname = "c"\nsteps = 2\n')
    return staged_events(spark, d, config).select("event_id", F.col("name").alias("stage"), "ghost")


@driver_check("SELECT * FROM (VALUES (CAST(0 AS BIGINT),'a'),(CAST(1 AS BIGINT),'a'),(CAST(2 AS BIGINT),'b'),(CAST(3 AS BIGINT),'c')) t(step, stage)")
def stage_walk(spark, d):
    """An app led through its stages by the run plugin; the skipped one runs a ghost step."""
    config = Config.parse('[[run]]\nname = "a"\nsteps = 2\n[[run]]\nname = "b"\nskip = true\n[[run]]\nname = "c"\nsteps = 1\n')
    app, seen = App(spark), []
    app.add_plugins(RunPlugin(config))
    app.add_systems(System("log", lambda: seen.append((app.world.get("clock").step, app.control.stage_name)), Step.A))
    app.start()
    return rows(spark, "step long, stage string", *seen)


#: The lines that one task takes.
STAGES_A_TASK = 250_000


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, max(l_returnflag) OVER (PARTITION BY l_orderkey, l_linenumber) AS flag FROM lineitem)
SELECT l_orderkey * 8 + l_linenumber AS stage, 'price.total' AS path, '1' AS value FROM l WHERE flag <> 'A' UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'price.flag', CASE WHEN flag = 'N' THEN '0' ELSE '"R"' END FROM l WHERE flag <> 'A'
UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'price', '"A"' FROM l WHERE flag = 'A'""")
def stage_overrides(spark, d):
    """Each line is a stage with the run's config under its own: R sets one field, A puts a value in place of the table."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    own = lambda flag: F.when(flag == "A", '{"price":"A"}').when(flag == "N", "{}").when(flag.isNotNull(), '{"price":{"flag":"R"}}')
    stages = lines.repartition(lines.count() // STAGES_A_TASK + 1, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(own(F.max("l_returnflag")).alias("own"))
    # three documents at most, so their leaves go to the stages, and no stage to its document
    leaves = under_each('{"price":{"total":1,"flag":0}}', lines.select(own(F.col("l_returnflag")).alias("own")), "own")
    return stages.join(F.broadcast(leaves), "own").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("stage"), "path", "value")


@query("SELECT l_orderkey, l_linenumber - 1 AS i, l_returnflag AS sec FROM lineitem WHERE l_linenumber > 1 AND l_returnflag IN ('A', 'R')")
def first_stage_warnings_(spark, d):
    """Lines stand for an order's stages, return flags for sections; A and R are read at the first stage only."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("i"), F.col("l_returnflag").alias("sec"))
    return registry.later_mentions(lines, "i", "sec", {"A", "R"})


QUERIES["first_stage_warnings"] = QUERIES.pop("first_stage_warnings_")
SQL["first_stage_warnings"] = SQL.pop("first_stage_warnings_")


@query("""
WITH e AS (SELECT o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'O' ELSE 'mixed' END AS name FROM orders),
a AS (SELECT l_orderkey AS pos, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'mixed' END AS name FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(e.pos, a.pos) AS pos, e.name AS expected, a.name AS actual FROM e FULL OUTER JOIN a ON e.pos = a.pos WHERE e.name IS DISTINCT FROM a.name""")
def validate_stages_(spark, d):
    """By order: the status that it states against that of its lines."""
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")).otherwise("mixed").alias("name"))
    own = F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus")).otherwise("mixed")
    return registry.mismatched(expected, table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(own.alias("name")), "pos", "name")


QUERIES["validate_stages"] = QUERIES.pop("validate_stages_")
SQL["validate_stages"] = SQL.pop("validate_stages_")


SHOWN = "last_value({} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, {SHOWN.format('v')} AS shown FROM (SELECT *, CASE WHEN event_type='purchase' THEN value END AS v FROM events) t")
def termout_locf(spark, d):
    said = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, d, "events").select("event_id", states.carried(said, "user_id", "ts", "event_id").alias("shown"))


NUMBER = "printf('%14s', CASE WHEN {0}<>0 AND (abs({0})<1e-3 OR abs({0})>=1e2) THEN regexp_replace(printf('%.6e',{0}),'e[+]?(-?)0*([0-9]+)','e\\1\\2') ELSE printf('%.6f',{0}) END)"


@query(f"SELECT event_id, coalesce(CASE WHEN p IS NULL THEN NULL ELSE {NUMBER.format('p')} END, lpad('—',14,' ')) || coalesce(CASE WHEN c IS NULL THEN NULL ELSE {NUMBER.format('c')} END, lpad('—',14,' ')) AS line FROM (SELECT event_id, {SHOWN.format('a')} AS p, {SHOWN.format('b')} AS c FROM (SELECT *, CASE WHEN event_type='purchase' THEN value END AS a, CASE WHEN event_type='click' THEN value END AS b FROM events) t) u WHERE event_id % 100 = 0")
def termout_lines(spark, d):
    said = lambda kind: states.carried(F.when(F.col("event_type") == kind, F.col("value")), "user_id", "ts", "event_id")
    lines = table(spark, d, "events").select("event_id", said("purchase").alias("p"), said("click").alias("c"))
    return steps.every(lines, "event_id", 100).select("event_id", observe.log_line([F.col("p"), F.col("c")], 14, 1e2).alias("line"))


@query(f"SELECT event_id, {NUMBER.format('value')} AS txt FROM events")
def format_value(spark, d):
    return table(spark, d, "events").select("event_id", fmt.format_value(F.col("value"), 14, 1e2).alias("txt"))


@query("SELECT event_id, printf('frame_%06d.json',event_id) AS path FROM events")
def dump_path(spark, d):
    return table(spark, d, "events").select("event_id", fmt.dump_path("frame_{step:06}.json", F.col("event_id")).alias("path"))


@query("SELECT CAST(event_id % 10 AS BIGINT) AS step, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_id % 10")
def dump_frames(spark, d):
    import uuid

    path = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    write_frames(table(spark, d, "events").select((F.col("event_id") % 10).alias("step"), "user_id"), path)
    return spark.read.parquet(path).groupBy(F.col("step").cast("long").alias("step")).agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("SELECT l_linenumber AS step, l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY l_linenumber, l_returnflag")
def committed_frames(spark, d):
    """Lines written as frames of their number, all or nothing, and three steps read back."""
    import uuid

    path = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    lines = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("step"), "l_returnflag", "l_orderkey")
    write_steps(lines, path)
    own = read_steps(spark, path, "step long, l_returnflag string, l_orderkey long", 2, 4).groupBy("step", "l_returnflag")
    return own.agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys")).select(F.col("step").cast("int").alias("step"), "l_returnflag", "n", "keys")


@query("SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts,event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts,event_id)=event_type THEN 0 ELSE 1 END AS chg FROM events) a) b GROUP BY user_id, event_type, g")
def phase_islands(spark, d):
    return states.islands(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", "event_id", "ts", "event_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '::') ELSE p_brand || '::' || p_name END AS s FROM part")
def short_name(spark, d):
    """The last two segments of paths made of type, brand and name."""
    deep = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("::", "p_type", "p_brand", F.replace("p_name", F.lit(" "), F.lit("::")))).otherwise(F.concat_ws("::", "p_type", "p_brand", "p_name"))
    return table(spark, d, "part").select("p_partkey", names.short_name(deep).alias("s"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lower(source) WHEN 1 THEN lang ELSE '' END AS stage FROM documents")
def condition_stage(spark, d):
    """Conditions made of each document's source and language."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("in_state("), F.upper("source"), F.lit(")"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("in_stage("), "lang", F.lit(")"))).otherwise(F.concat(F.lit("on_enter_stage("), "lang", F.lit(")")))
    return table(spark, d, "documents").select("doc_id", names.condition_stage(text).alias("stage"))


@query("SELECT l_returnflag, CAST(t AS DOUBLE) AS t, t/sum(t) OVER () AS pct FROM (SELECT l_returnflag, count(*) AS t FROM lineitem GROUP BY l_returnflag) q")
def timing_table(spark, d):
    return observe.timing_table(table(spark, d, "lineitem"), "l_returnflag", F.count("*").cast("double"))


@driver_check("SELECT system, calls, share FROM (SELECT 'double' AS system, CAST(2 AS BIGINT) AS calls, true AS share UNION ALL SELECT 'add', 2, true) WHERE (SELECT count(*) FROM orders) > 0")
def run_timings(spark, d):
    """The timings of a run of two steps over orders: calls, and whether the shares of the systems make up the whole."""
    w = world_of(spark, d, frame=prices(spark, d))
    s = Scheduler(w).add(arithmetic("double", Step.A, lambda x: x * 2), arithmetic("add", Step.B, lambda x: x + 1))
    s.prepare()
    for _ in range(2):
        s.run()
    spent = rows(spark, "system string, calls long, seconds double", *((n, c, t) for _, n, c, t in s.timing_rows()))
    shares = observe.timing_table(spent, "system", F.sum("seconds"))
    whole = abs(shares.agg(F.sum("pct")).first()[0] - 1) < 1e-9
    assert w.get("frame").count()
    return spent.groupBy("system").agg(F.sum("calls").alias("calls")).withColumn("share", F.lit(whole))


@driver_check("SELECT * FROM (VALUES (CAST(0 AS BIGINT),CAST(0 AS BIGINT),'A','a'),(CAST(0 AS BIGINT),CAST(1 AS BIGINT),'B','b'),(CAST(1 AS BIGINT),CAST(2 AS BIGINT),'A','a'),(CAST(1 AS BIGINT),CAST(3 AS BIGINT),'B','b')) t(step, seq, phase, system)")
def exec_trace(spark, d):
    s = Scheduler(World(spark), keep_trace=True).add(System("b", lambda: None, Step.B), System("a", lambda: None, Step.A), System("off", lambda: None, Step.A).run_if(lambda w: False))
    s.prepare()
    s.run()
    s.run()
    return rows(spark, "step long, seq long, phase string, system string", *s.trace)


@query("SELECT o_orderkey, o_totalprice AS x, CAST(s AS BIGINT) AS step FROM orders CROSS JOIN (VALUES (0),(2)) t(s)")
def dump_plugin(spark, d):
    """An app of four steps that dumps a frame every second step."""
    import uuid

    folder = f"{shared_dir(spark)}/dumps-{uuid.uuid4().hex}"
    app = App(spark).put("frame", prices(spark, d)).add_plugins(RunPlugin(Config.parse("[run]\nsteps = 4\n")), DumpPlugin("frame", folder, DumpConfig(2, "step={step}"), Step.A))
    app.start()
    return spark.read.parquet(folder).select("o_orderkey", "x", F.col("step").cast("long").alias("step"))


@driver_check("SELECT * FROM (VALUES (CAST(0 AS BIGINT),'          step             x'),(CAST(1 AS BIGINT),'             0             —'),(CAST(2 AS BIGINT),'             2      2.500000'),(CAST(3 AS BIGINT),'             4    1.000000e7')) t(i, line)")
def termout_driver(spark, d):
    """The driver's log: a header once, a dash for what was never set, the last value until another is set."""
    out = observe.TermOut(["step", "x"], every=2)
    for step, x in enumerate((None, 2.5, None, 1e7, None)):
        if x is not None:
            out.set("x", x)
        out.print(step, 0.0)
    return rows(spark, "i long, line string", *enumerate(out.lines))


# --- coupling -----------------------------------------------------------------------------------------------------


@driver_check("SELECT * FROM (VALUES (CAST(0 AS BIGINT),'orders'),(CAST(1 AS BIGINT),'customers')) t(i, name)")
def participants(spark, d):
    m = Multi().add_app("orders", App(spark)).add_app("customers", App(spark))
    return rows(spark, "i long, name string", *enumerate(m.participants()))


@query("SELECT o.o_orderkey, o.o_totalprice+c.c_acctbal AS v FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey")
def multi_read_write(spark, d):
    m = Multi().add_app("orders", App(spark).put("t", table(spark, d, "orders"))).add_app("customers", App(spark).put("t", table(spark, d, "customer")))
    o, c = m.expect("orders", "t"), m.expect("customers", "t")
    m.write("orders", "t", o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", (F.col("o_totalprice") + F.col("c_acctbal")).alias("v")))
    assert m.read("orders", "absent") is None and not m.write("nobody", "t", o)
    return m.read("orders", "t")


@query("SELECT n_nationkey, sub FROM (SELECT n_nationkey, unnest(range(1,4)) AS sub FROM nation)")
def substeps(spark, d):
    return steps.substeps(table(spark, d, "nation").select("n_nationkey"), 3)


@query("SELECT o_orderkey, o_totalprice/8 AS x FROM orders")
def tick_substeps(spark, d):
    """Three ticks of a coupled app within one outer iteration."""
    m = Multi().add_app("solver", App(spark).put("frame", prices(spark, d)).add_systems(halve()))
    m.tick("solver", 3)
    assert not m.any_done()
    return m.expect("solver", "frame")


@query("SELECT o_custkey, bool_or(o_orderstatus='F') AS any_done FROM orders GROUP BY o_custkey")
def any_done(spark, d):
    return registry.any_done(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


@query("SELECT c_custkey, c_acctbal, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey, c_acctbal")
def mirror_exported(spark, d):
    """Two sides exchange frames in the same iteration: all sends before all receipts, and the joined result sees no lag."""
    board: dict = {}
    mine, theirs = World(spark), World(spark)
    a = Mirror("orders", board, "customers", mine).send_each_iteration("c", lambda: table(spark, d, "customer").select("c_custkey", "c_acctbal")).receive_each_iteration("o")
    b = Mirror("customers", board, "orders", theirs).send_each_iteration("o", lambda: table(spark, d, "orders").select("o_custkey", "o_orderkey"))
    b.step()
    a.step()
    c, o = board["customers", 0, "c"], mine.get("o")
    return c.join(o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n")), c["c_custkey"] == F.col("o_custkey"), "left").select("c_custkey", "c_acctbal", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT event_id, lag(value,1,CAST(0 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts,event_id) AS seen FROM events")
def mirror_latency(spark, d):
    return table(spark, d, "events").select("event_id", states.lagged(F.col("value"), 0.0, "user_id", "ts", "event_id").alias("seen"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice, CAST([p_retailprice, p_retailprice*2] AS DOUBLE[]) AS pair, CAST(8+4+octet_length(encode(p_name))+4+4+16 AS BIGINT) AS n_bytes FROM part")
def wire_roundtrip(spark, d):
    kinds = {"p_name": "string", "p_size": "i32", "p_retailprice": "f64", "pair": "vec_f64"}
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", F.array("p_retailprice", F.col("p_retailprice") * 2).alias("pair"))
    sent = part.select("p_partkey", *(wire.encoder(k)(c).alias(c) for c, k in kinds.items()))
    size = sum((F.octet_length(c) for c in kinds), F.lit(0)).cast("long")
    return sent.select("p_partkey", *(wire.decoder(k)(c).alias(c) for c, k in kinds.items()), size.alias("n_bytes"))


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 200")
def outer_iter_stop(spark, d):
    """The first n iterations: the limit is the feature."""
    return steps.stop_after(table(spark, d, "events").select("ts", "event_id"), 200, "ts", "event_id").select("event_id")


# --- reductions, exchange, coherence --------------------------------------------------------------------------------


@query("SELECT r AS rank, CAST(sum(loc) OVER () AS DOUBLE) AS gsum, min(mn) OVER () AS gmin FROM (SELECT l_suppkey % 4 AS r, sum(CAST(l_quantity AS DECIMAL(18,2))) AS loc, min(l_extendedprice) AS mn FROM lineitem GROUP BY l_suppkey % 4) t")
def all_reduce(spark, d):
    own = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("rank"), F.col("l_quantity").cast("decimal(18,2)").alias("l_quantity"), "l_extendedprice")
    return reduce.all_reduce(own, "rank", {"gsum": "l_quantity"}, {"gmin": "l_extendedprice"})


@query("WITH b AS (SELECT l_suppkey % 4 AS r, max(l_extendedprice) AS v FROM lineitem GROUP BY l_suppkey % 4) SELECT x.r AS rank, l.v AS from_left, g.v AS from_right FROM b x LEFT JOIN b l ON l.r=x.r-1 LEFT JOIN b g ON g.r=x.r+1")
def halo_exchange(spark, d):
    own = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("rank")).agg(F.max("l_extendedprice").alias("v"))
    return reduce.halo_exchange(own, "rank", "v", {"from_left": -1, "from_right": 1})


@query("SELECT user_id, CAST(sum(CASE WHEN kind='host' AND prev='device' THEN 1 ELSE 0 END) AS BIGINT) AS syncs FROM (SELECT user_id, kind, lag(kind) OVER (PARTITION BY user_id ORDER BY ts,event_id) AS prev FROM (SELECT *, CASE WHEN event_type='purchase' THEN 'device' ELSE 'host' END AS kind FROM events) a) t GROUP BY user_id")
def coherence_syncs(spark, d):
    kinds = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "purchase", "device").otherwise("host").alias("kind"))
    return states.host_syncs(kinds, "user_id", "kind", "ts", "event_id")


@driver_check("SELECT * FROM (VALUES ('frame', CAST(2 AS BIGINT), true)) t(name, syncs, host_dirty)")
def coherence_registry(spark, d):
    """Reads of a name whose copy is ahead fetch it once; a write leaves the host ahead, until a producer takes the mark."""
    w = world_of(spark, d, frame=prices(spark, d))
    c = Coherence().register("frame", lambda w: w.update("frame", lambda f: f))
    s = Scheduler(w, before_system=c.before, after_system=c.after).add(System("device", lambda: c.mark_device("frame"), Step.A), System("look", lambda frame: None, Step.B, ("frame",)), arithmetic("write", Step.C, lambda x: x + 1))
    s.prepare()
    s.run()
    s.run()
    return rows(spark, "name string, syncs long, host_dirty boolean", ("frame", c.entries["frame"].syncs, c.take_host_dirty("frame")))


# --- prefix scans, as-of joins, intervals, exchange along edges -------------------------------------------------------


@query("""
SELECT doc_id, CAST(row_number() OVER w - 1 AS BIGINT) AS step, CAST(sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars,
  last_value(CASE WHEN n_chars > 1000 THEN lang END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS long_lang, lag(n_chars, 1, -1) OVER w AS before
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def scan_sources(spark, d):
    """Clock, running sum, last observation and the row before, within each source; a source of very many documents is many tasks."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    scanned = prefix_scan(docs, "source", ["doc_id"], count="call", sums={"chars": F.col("n_chars")}, lasts={"long_lang": F.when(F.col("n_chars") > 1000, F.col("lang"))}, before={"before": F.col("n_chars")})
    return scanned.select("doc_id", (F.col("call") - 1).cast("long").alias("step"), F.col("chars").cast("long").alias("chars"), "long_lang", F.coalesce("before", F.lit(-1).cast("long")).alias("before"))


@query("""
SELECT event_id, CAST(row_number() OVER w - 1 AS BIGINT) AS step, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS time,
  last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS shown, lag(value, 1, 0) OVER w AS seen
FROM events WINDOW w AS (ORDER BY ts, event_id)""")
def scan_one_key(spark, d):
    """The clock of the whole table, its last shown value and what a peer sees one step late: all rows are one key."""
    events = table(spark, d, "events").select("event_id", "ts", "event_type", "value").withColumn("all", F.lit(0))
    shown = F.when(F.col("event_type") == "purchase", F.col("value"))
    scanned = prefix_scan(events, "all", ["ts", "event_id"], count="call", sums={"time": F.col("value").cast("decimal(18,2)")}, lasts={"shown": shown}, before={"seen": F.col("value")}, piece_bits=10)
    return scanned.select("event_id", (F.col("call") - 1).cast("long").alias("step"), F.col("time").cast("double").alias("time"), "shown", F.coalesce("seen", F.lit(0.0)).alias("seen"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01' + to_hours(CAST((o_orderkey * 7919) % 720 AS INTEGER)) AS at FROM orders),
e AS (SELECT user_id, ts + INTERVAL 1 HOUR AS known, event_id, value FROM events)
SELECT o_orderkey, coalesce(e.event_id, -1) AS event_id, coalesce(e.value, -1) AS value FROM o ASOF LEFT JOIN e ON o.user_id = e.user_id AND o.at >= e.known""")
def asof_exchange(spark, d):
    """Two worlds with their own rates: each order sees its user's last event that was known, an hour after it was made."""
    hour = F.expr("make_interval(0, 0, 0, 0, cast((o_orderkey * 7919) % 720 AS int), 0, 0)")
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + hour).alias("at"))
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    met = as_of(orders, events, "at", "ts", ["user_id"], delay=F.expr("INTERVAL '1' HOUR"))
    return met.select("o_orderkey", F.coalesce("seen.event_id", F.lit(-1).cast("long")).alias("event_id"), F.coalesce("seen.value", F.lit(-1.0)).alias("value"))


@query("""
WITH l AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS step FROM lineitem),
n AS (SELECT l_orderkey AS stage, count(*) AS n FROM lineitem GROUP BY l_orderkey),
s AS (SELECT stage, sum(n) OVER (ORDER BY stage) - n AS lo, sum(n) OVER (ORDER BY stage) AS hi FROM n)
SELECT s.stage, CAST(min(l.step - s.lo) AS BIGINT) AS first_step, CAST(max(l.step - s.lo) AS BIGINT) AS last_step, min(l_orderkey) = max(l_orderkey) AS alone FROM l JOIN s ON l.step >= s.lo AND l.step < s.hi GROUP BY s.stage""")
def stages_of_orders(spark, d):
    """A run of as many stages as there are orders: each line's global step is sought among the stages' intervals."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = steps.global_steps(lines, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").select("l_orderkey", "step")
    sizes = lines.groupBy(F.col("l_orderkey").alias("stage")).agg(F.count("*").alias("occupied")).withColumn("all", F.lit(0))
    stages = prefix_scan(sizes, "all", ["stage"], sums={"hi": F.col("occupied")}).select("stage", (F.col("hi") - F.col("occupied")).alias("lo"), "occupied")
    own = F.col("step") - F.col("lo")
    return steps.in_stage_steps(numbered, stages).groupBy("stage").agg(F.min(own).alias("first_step"), F.max(own).alias("last_step"), (F.min("l_orderkey") == F.max("l_orderkey")).alias("alone"))


@query("""
WITH e AS (SELECT vec_id AS r, vec_id // 8 AS block, CASE WHEN vec_id % 8 = 7 THEN -1 ELSE vec_id + 1 END AS to_rank, CASE WHEN vec_id % 8 = 0 THEN -1 ELSE vec_id - 1 END AS from_rank, embedding[1:4 + vec_id % 5] AS sent, 3 + vec_id % 7 AS room FROM embeddings)
SELECT a.r AS rank, a.from_rank, CAST(least(len(b.sent), a.room) AS BIGINT) AS n, CAST(b.sent[1] AS DOUBLE) AS first_value, CAST(b.sent[least(len(b.sent), a.room)] AS DOUBLE) AS last_value
FROM e a LEFT JOIN e b ON b.r = a.from_rank AND b.to_rank = a.r WHERE a.from_rank >= 0""")
def edge_exchange(spark, d):
    """Vectors shifted along chains of eight ranks: the ends have a disabled half, and a receipt takes as many numbers as both sides have."""
    v = F.col("vec_id")
    to, source = F.when(v % 8 == 7, -1).otherwise(v + 1), F.when(v % 8 == 0, -1).otherwise(v - 1)
    sent = F.slice("embedding", 1, (4 + v % 5).cast("int"))
    edges = table(spark, d, "embeddings").select(v.alias("rank"), F.lit(0).alias("slot"), to.cast("long").alias("to_rank"), source.cast("long").alias("from_rank"), sent.alias("sent"), (3 + v % 7).cast("int").alias("room"))
    got = F.col("received")
    return reduce.exchanged(edges, "sent", "room").select("rank", "from_rank", F.size(got).cast("long").alias("n"), got[0].cast("double").alias("first_value"), F.element_at(got, -1).cast("double").alias("last_value"))


#: What each kind of event says: (event type, path, value or None for a tombstone).
SAID = [("purchase", "pump", "k"), ("click", "pump.rate", "k"), ("click", "pump.head.max", "value"), ("view", "mode.stage.n", "k"), ("error", "pump", None), ("signup", "mode", "k")]


@query(f"""
WITH e AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events),
w AS ({" UNION ALL ".join(f"SELECT user_id, event_id, '{path}' AS path, {f'CAST({said} AS VARCHAR)' if said else 'NULL'} AS value FROM e WHERE event_type = '{kind}'" for kind, path, said in SAID)})
SELECT user_id, path, value FROM w a WHERE value IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM w b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND (b.path = a.path OR starts_with(a.path, b.path || '.') OR (b.value IS NOT NULL AND starts_with(b.path, a.path || '.'))))""")
def overlay_events(spark, d):
    """Each user's events as configuration laid over one another: values replace tables, tables values, and an error removes one."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("null"))
    say = {
        "purchase": F.concat(F.lit('{"pump":'), k, F.lit("}")),
        "click": F.concat(F.lit('{"pump":{"rate":'), k, F.lit(',"head":{"max":'), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit("}}}")),
        "view": F.concat(F.lit('{"mode":{"stage":{"n":'), k, F.lit("}}}")),
        "error": F.lit('{"pump":null}'),
        "signup": F.concat(F.lit('{"mode":'), k, F.lit("}")),
    }
    doc = F.coalesce(*(F.when(F.col("event_type") == kind, text) for kind, text in say.items()))
    return folded(table(spark, d, "events").select("user_id", "event_id", doc.alias("doc")), "user_id", ["event_id"], "doc")


# --- streaming ----------------------------------------------------------------------------------------------------


@query(SQL["on_enter_state"])
def stream_on_enter_state(spark, d):
    from tidestep.streaming.machines import drained, entries, step_stream

    return drained(entries(step_stream(spark, d), "error"))


@query(SQL["apply_transitions"])
def stream_apply_transitions(spark, d):
    from tidestep.streaming.machines import drained, step_stream, transitions

    return drained(transitions(step_stream(spark, d), "init", ["signup", "error"]))


@query(SQL["stage_advance"])
def stream_stage_advance(spark, d):
    from tidestep.streaming.machines import drained, stages, step_stream

    return drained(stages(step_stream(spark, d), "error", 3))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS begin, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Tumbling windows behind a watermark, over rows that arrive out of order; the closing row lets out those of the end."""
    from tidestep.streaming.machines import drained, windowed_counts
    from tidestep.streaming.ordered import arrivals

    stream, late = arrivals(table(spark, d, "events"), 5)
    return drained(windowed_counts(stream, late=late)).select(F.col("begin").cast("date").cast("string").alias("begin"), "event_type", "n")


def machine_events(spark, d, idle_ms: int | None = None) -> DataFrame:
    """What the machines of the users tell, their events arriving out of order in five batches."""
    from tidestep.streaming.ordered import arrivals, drained_by_files, machine_rows

    stream, late = arrivals(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), 5)
    return drained_by_files(machine_rows(stream, late, "init", ["signup", "error"], "error", 3, idle_ms))


@query("""
WITH s AS (SELECT *, lag(event_type) OVER w AS prev, coalesce(last_value(CASE WHEN event_type IN ('signup','error') THEN event_type END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'init') AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT *, CASE WHEN prev IS NULL OR prev <> event_type THEN 1 ELSE 0 END AS enters FROM s)
SELECT event_id, enters = 1 AS entered, state, CAST(least(sum(CASE WHEN event_type = 'error' THEN enters ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS BIGINT) AS stage, CAST(sum(enters) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS visit FROM e""")
def stream_machines(spark, d):
    """Entries, transitions, stages and visits of the states at once, right whatever the order of arrival."""
    return machine_events(spark, d).select(F.col("ident").alias("event_id"), "entered", F.col("current").alias("state"), "stage", "visit")


@query("SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER w AS prev, lag(ts) OVER w AS prev_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'error' AND (prev IS NULL OR prev <> 'error' OR ts - prev_ts > INTERVAL 8 HOUR)")
def stream_idle_machines(spark, d):
    """A user's machine is forgotten after eight hours without an event, by a timer; entries into errors."""
    told = machine_events(spark, d, 8 * 3600 * 1000).filter("entered")
    errors = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("ident"))
    return told.join(errors, "ident").select(F.col("ident").alias("event_id"), "user_id")
