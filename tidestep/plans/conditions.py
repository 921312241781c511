"""Run conditions on a world's control values.

Edge conditions fire at the first asking at which they hold and didn't before; each instance remembers for itself.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column

from tidestep.plans.schedule import RunControl
from tidestep.plans.system import Condition
from tidestep.plans.world import World
from tidestep.storage import observed

CONTROL, CLOCK = "run_control", "clock"


def _edge(name: str, test) -> Condition:
    def fires(world: World, local: dict) -> bool:
        now, before = test(world), local.get("active", False)
        local["active"] = now
        return now and not before

    return Condition(fires, name)


def _control(world: World) -> RunControl:
    return world.find(CONTROL) or RunControl()


def in_state(name: str, state: Any) -> Condition:
    """The state machine of that name is in the state."""
    return Condition(lambda w: w.get(name).current == state, f"in_state({state})")


def on_enter_state(name: str, state: Any) -> Condition:
    return _edge(f"on_enter_state({state})", lambda w: w.get(name).current == state)


def in_stage(stage: str) -> Condition:
    return Condition(lambda w: _control(w).stage_name == stage, f"in_stage({stage})")


def on_enter_stage(stage: str) -> Condition:
    return _edge(f"on_enter_stage({stage})", lambda w: _control(w).stage_name == stage)


def first_stage_only() -> Condition:
    return Condition(lambda w: _control(w).index == 0, "first_stage_only()")


def every_n_steps(n: int) -> Condition:
    """At steps 0, n, 2n ...; never for n = 0."""
    return Condition(lambda w: n > 0 and w.get(CLOCK).step % n == 0, f"every_n_steps({n})")


def measured(frame: str, test: Callable[[dict[str, Any]], bool], **metrics: Column) -> Condition:
    """A test of aggregates over a frame, for loops: the round's rows are written once and the aggregates come from that write.

    So a round costs one job and reads the round before it, instead of an aggregate over the whole lineage.
    """

    def holds(world: World) -> bool:
        rows, seen = observed(world.get(frame), **metrics)
        world.put(frame, rows)
        return test(seen)

    return Condition(holds, f"measured({frame})")
