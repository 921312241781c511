"""Schedules: trees of phases, sequences, loops, branches and groups that drive systems over a world.

Frames are composed lazily; a condition that needs data runs one aggregate. A loop cuts the lineage of the frames named in
`pin` every `pin_every` rounds: needed where a body uses its own frame more than once, useless for a narrow body.
"""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from enum import Enum, auto
from typing import Any

from tidestep.plans.ordering import OrderError, names_of, ordered, validate
from tidestep.plans.system import Condition, System, condition
from tidestep.plans.world import World


LOG = logging.getLogger(__name__)


class NotConverged(RuntimeError):
    pass


class OnMax(Enum):
    ACCEPT = auto()
    RAISE = auto()
    ROLLBACK = auto()


class State(Enum):
    SETUP = auto()
    RUN = auto()
    END = auto()


@dataclass
class RunControl:
    state: State = State.SETUP
    index: int = 0
    stage_name: str = ""
    advance_requested: bool = False


class Node:
    def leaves(self) -> Iterable[Any]:
        return ()


@dataclass(frozen=True)
class Phase(Node):
    """All systems of an Enum of phases, or of one member."""

    of: Any

    def leaves(self) -> Iterable[Any]:
        yield self.of

    def holds(self, system: System) -> bool:
        return system.phase is self.of or isinstance(self.of, type) and isinstance(system.phase, self.of)


@dataclass(frozen=True)
class Sequence(Node):
    nodes: tuple[Node, ...]

    def leaves(self) -> Iterable[Any]:
        for n in self.nodes:
            yield from n.leaves()


@dataclass(frozen=True)
class Loop(Node):
    """Runs the body until a condition holds, which is asked after the body, at most so often; a limit of 0 goes straight to what follows it."""

    body: Node
    until: Condition
    most: int
    on_max: OnMax = OnMax.ACCEPT
    rollback: Node | None = None
    pin: tuple[str, ...] = ()
    pin_every: int = 1

    def __post_init__(self) -> None:
        if self.most < 0:
            raise ValueError("a loop can't run less than no round")

    def leaves(self) -> Iterable[Any]:
        yield from self.body.leaves()
        if self.rollback:
            yield from self.rollback.leaves()


@dataclass(frozen=True)
class Branch(Node):
    """The first arm whose condition holds; none: nothing."""

    arms: tuple[tuple[Condition, Node], ...]

    def leaves(self) -> Iterable[Any]:
        for _, n in self.arms:
            yield from n.leaves()


def sequence(*nodes: Any) -> Node:
    own = tuple(n if isinstance(n, Node) else Phase(n) for n in nodes)
    return own[0] if len(own) == 1 else Sequence(own)


def loop_until(body: Any, until: Callable[..., bool], most: int, on_max: OnMax = OnMax.ACCEPT, rollback: Any = None, pin: Iterable[str] = (), pin_every: int = 1) -> Loop:
    node = lambda n: n if n is None or isinstance(n, Node) else sequence(*n) if isinstance(n, (list, tuple)) else Phase(n)
    return Loop(node(body), condition(until), most, on_max, node(rollback), tuple(pin), pin_every)


def branch(*arms: tuple[Callable[..., bool], Any]) -> Branch:
    return Branch(tuple((condition(c), n if isinstance(n, Node) else Phase(n)) for c, n in arms))


@dataclass
class Group:
    """Systems and groups that run as one, ordered by phase and within each phase, once or while a condition holds (asked after each round; the round limit ends it silently).

    A group can be given conditions, labels and an order like a system, as which it stands from then on.
    """

    name: str
    systems: list[System | Group]
    phase: Any = None
    while_: Condition | None = None
    most: int = 1
    rounds: int = 0
    total_rounds: int = 0
    #: Seconds by inner system, in their order.
    timings: dict[str, float] = field(default_factory=dict)

    def as_system(self) -> System:
        inner = ordered([s.as_system() if isinstance(s, Group) else s for s in self.systems])
        made: set[str] = set()
        reads: list[str] = []
        for s in inner:
            reads += [r for r in s.reads if r not in made and r not in reads]
            made.update(s.writes)
        writes = tuple(dict.fromkeys(w for s in inner for w in s.writes))
        group = self

        class Grouped(System):
            def __call__(self, world: World) -> bool:
                if not self.may_run(world):
                    return False
                group.rounds = 0
                while True:
                    for s in inner:
                        began = time.perf_counter()
                        s(world)
                        group.timings[s.name] = group.timings.get(s.name, 0.0) + time.perf_counter() - began
                    group.rounds += 1
                    group.total_rounds += 1
                    if group.while_ is None or group.rounds >= group.most or not group.while_(world):
                        return True

        Grouped.group, Grouped.inner = group, inner
        return Grouped(self.name, lambda: None, self.phase, tuple(reads), (), writes)

    def run_if(self, test: Callable[..., bool] | Condition) -> System:
        return self.as_system().run_if(test)

    def label(self, *names: str) -> System:
        return self.as_system().label(*names)

    def ordered(self, **edges: Iterable[str]) -> System:
        return self.as_system().ordered(**edges)


def loop_while(name: str, systems: Iterable[System], test: Callable[..., bool], most: int, phase: Any = None) -> Group:
    return Group(name, list(systems), phase, condition(test), most)


@dataclass
class Timing:
    calls: int = 0
    seconds: float = 0.0


@dataclass
class Scheduler:
    world: World
    systems: list[System] = field(default_factory=list)
    setup: list[System] = field(default_factory=list)
    tree: Node | None = None
    control: RunControl = field(default_factory=RunControl)
    before_system: Callable[[System, World], None] | None = None
    after_system: Callable[[System, World], None] | None = None
    warnings_of: Callable[[list[str]], list[str]] | None = None
    #: (step, number, phase, system) of each call; kept only if asked for, as it grows with every call.
    trace: list[tuple[int, int, str, str]] = field(default_factory=list)
    keep_trace: bool = False
    #: Where start() writes the schedule as a DOT graph.
    dot_path: str | None = None
    stage_names: tuple[str, ...] = ()
    calls: int = 0
    timings: dict[tuple[int, str], Timing] = field(default_factory=dict)
    iterations: dict[int, int] = field(default_factory=dict)
    step: int = 0

    def add(self, *systems: System | Group) -> Scheduler:
        self.systems += [s.as_system() if isinstance(s, Group) else s for s in systems]
        return self

    def add_setup(self, *systems: System) -> Scheduler:
        self.setup += systems
        return self

    def set_schedule(self, tree: Node) -> Scheduler:
        """Installs a tree. A phase stands in it once, and not both as a whole and by a member; every system belongs to it."""
        leaves = list(tree.leaves())
        for i, a in enumerate(leaves):
            for b in leaves[i + 1 :]:
                if a is b:
                    raise OrderError(f"{a} stands in the schedule twice")
                if isinstance(a, type) and isinstance(b, a) or isinstance(b, type) and isinstance(a, b):
                    raise OrderError(f"{a} and {b} overlap")
        self.tree = tree
        return self

    def organise(self) -> None:
        """Orders and checks the systems, and logs the warnings of `warnings_of` unless TIDESTEP_NO_WARNINGS is set."""
        self.setup = validate(self.setup, self.world, labels=False)
        self.systems = validate(self.systems, self.world)
        if self.tree:
            phases = [Phase(x) for x in self.tree.leaves()]
            if lost := [s.name for s in self.systems if not any(p.holds(s) for p in phases)]:
                raise OrderError("not in the schedule: " + ", ".join(lost))
        if not os.environ.get("TIDESTEP_NO_WARNINGS"):
            for text in self.warnings():
                LOG.warning(text)

    def warnings(self) -> list[str]:
        return self.warnings_of(sorted({str(s.phase) for s in self.systems})) if self.warnings_of else []

    def _call(self, s: System) -> None:
        if self.before_system:
            self.before_system(s, self.world)
        began = time.perf_counter()
        if s(self.world):
            own = self.timings.setdefault((self.control.index, s.name), Timing())
            own.calls, own.seconds = own.calls + 1, own.seconds + time.perf_counter() - began
            phase = str(getattr(s.phase, "name", s.phase))
            if self.keep_trace:
                self.trace.append((self.step, self.calls, phase, s.name))
            if os.environ.get("TIDESTEP_TRACE"):
                LOG.warning("[step %d] %s: %s", self.step, phase, s.name)
            self.calls += 1
            if self.after_system:
                self.after_system(s, self.world)

    def _node(self, node: Node) -> None:
        if isinstance(node, Phase):
            for s in [s for s in self.systems if node.holds(s)]:
                self._call(s)
        elif isinstance(node, Sequence):
            for n in node.nodes:
                self._node(n)
        elif isinstance(node, Branch):
            for test, n in node.arms:
                if test(self.world):
                    return self._node(n)
        elif isinstance(node, Loop):
            for i in range(1, node.most + 1):
                self._node(node.body)
                self.iterations[id(node)] = i
                if i % node.pin_every == 0:
                    for name in node.pin:
                        self.world.pin(name)
                if node.until(self.world):
                    return None
            if node.on_max is OnMax.RAISE:
                raise NotConverged(f"{node.until.name} did not converge in {node.most} iterations")
            if node.on_max is OnMax.ROLLBACK and node.rollback:
                self._node(node.rollback)
        return None

    def run(self) -> None:
        """One step: the tree, or all systems in their order."""
        if self.tree:
            self._node(self.tree)
        else:
            for s in self.systems:
                self._call(s)
        self.step += 1

    def prepare(self) -> None:
        self.organise()
        if self.dot_path:
            with open(self.dot_path, "w") as f:
                f.write(self.dot(self.stage_names))
            LOG.info(self.printed())
        for s in self.setup:
            self._call(s)
        if self.control.state is State.SETUP:
            self.control.state = State.RUN

    def start(self, most_steps: int | None = None) -> None:
        """Setup and steps until a system ends the run; a change of stage sets up again. The report of timings is logged at the end."""
        while self.control.state is not State.END:
            if self.control.state is State.SETUP:
                self.prepare()
            else:
                self.run()
                if most_steps is not None and self.step >= most_steps:
                    self.control.state = State.END
        LOG.info(self.report())

    def timing_rows(self) -> list[tuple[int, str, int, float]]:
        return [(i, n, t.calls, t.seconds) for (i, n), t in self.timings.items()]

    def printed(self) -> str:
        """The systems by phase, those of one phase together."""
        lines, at = [], object()
        for s in self.systems:
            if s.phase is not at:
                at = s.phase
                lines.append(f"[{getattr(at, 'name', at)}]")
            lines.append("  " + s.name + "".join(f" if {c.name}" for c in s.conditions))
        return "\n".join(lines)

    def report(self) -> str:
        """Seconds and share of each system, the longest first, and those of a group's systems below it."""
        spent: dict[str, float] = {}
        for (_, name), t in self.timings.items():
            spent[name] = spent.get(name, 0.0) + t.seconds
        total = sum(spent.values()) or 1.0
        groups = {s.name: s.group for s in [*self.setup, *self.systems] if hasattr(s, "group")}
        lines = []
        for name, seconds in sorted(spent.items(), key=lambda x: (-x[1], x[0])):
            lines.append(f"{seconds:12.6f} s {100 * seconds / total:6.2f} %  {name}")
            if name in groups:
                lines += [f"{t:12.6f} s {100 * t / total:6.2f} %    {n}" for n, t in groups[name].timings.items()]
        return "\n".join(lines)

    def dot(self, stages: Iterable[str] = ()) -> str:
        """The schedule as a DOT graph: a cluster for each stage, in it one for each phase; edges for the run order, dashed ones for `before` and `after`; a group's systems below it.

        A system whose condition names a stage stands only there.
        """
        from tidestep.functions.names import stage_of_condition

        out = ["digraph schedule {"]
        for k, stage in enumerate([*stages] or [None]):
            shown = [s for s in self.systems if stage is None or all(stage_of_condition(c.name) in (None, stage.lower()) for c in s.conditions)]
            out.append(f'  subgraph cluster_{k} {{ label="{stage or "step"}";')
            for p, phase in enumerate(dict.fromkeys(str(getattr(s.phase, "name", s.phase)) for s in shown)):
                out.append(f'    subgraph cluster_{k}_{p} {{ label="{phase}";')
                out += [f'      "{k}:{s.name}" [label="{s.name}"];' for s in shown if str(getattr(s.phase, "name", s.phase)) == phase]
                out.append("    }")
            out += [f'    "{k}:{a.name}" -> "{k}:{b.name}";' for a, b in zip(shown, shown[1:], strict=False)]
            owner = {n: s.name for s in shown for n in names_of(s)}
            for s in shown:
                out += [f'    "{k}:{s.name}" -> "{k}:{owner[n]}" [style=dashed];' for n in s.before if n in owner]
                out += [f'    "{k}:{owner[n]}" -> "{k}:{s.name}" [style=dashed];' for n in s.after if n in owner]
                out += [f'    "{k}:{s.name}" -> "{k}:{s.name}/{i.name}" [style=dotted]; "{k}:{s.name}/{i.name}" [label="{i.name}"];' for i in getattr(s, "inner", ())]
            out.append("  }")
        return "\n".join([*out, "}"])
