"""Systems and conditions: functions with declared reads and writes.

A system's function is called with the frames and values that it reads, by parameter name, and returns what it writes: a
frame (or value) for a single name, a dict for several, or None. It composes plans and must not collect.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from tidestep.plans.world import World


@dataclass(frozen=True)
class Condition:
    """A named test of a world. `local` is a dict of this instance's own that lasts between calls."""

    test: Callable[..., bool]
    name: str = ""
    local: dict = field(default_factory=dict, compare=False)

    def __call__(self, world: World) -> bool:
        wants_local = len(inspect.signature(self.test).parameters) > 1
        return bool(self.test(world, self.local) if wants_local else self.test(world))


def condition(test: Callable[..., bool] | Condition, name: str = "") -> Condition:
    return test if isinstance(test, Condition) else Condition(test, name or getattr(test, "__name__", "condition"))


@dataclass(frozen=True)
class System:
    name: str
    function: Callable[..., Any]
    phase: Any = None
    reads: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = ()
    #: (parameter, extractor): further parameters, each made from the world by a function of its own.
    extract: tuple[tuple[str, Callable[[World], Any]], ...] = ()
    local: dict = field(default_factory=dict, compare=False)

    def run_if(self, test: Callable[..., bool] | Condition) -> System:
        """A further condition; the last that was added is asked first, and a false one stops the asking."""
        return replace(self, conditions=(condition(test), *self.conditions))

    def label(self, *names: str) -> System:
        return replace(self, labels=self.labels + names)

    def ordered(self, before: Iterable[str] = (), after: Iterable[str] = (), requires: Iterable[str] = ()) -> System:
        return replace(self, before=self.before + tuple(before), after=self.after + tuple(after), requires=self.requires + tuple(requires))

    def in_phase(self, phase: Any) -> System:
        return replace(self, phase=phase)

    def accesses(self, world: World | None = None) -> dict[str, str]:
        """What it touches: 'write' or 'read' by name; of the optional names, if a world is given, those that it has."""
        there = [n for n in self.optional if world is None or world.find(n) is not None]
        return {n: "read" for n in (*self.reads, *there)} | {n: "write" for n in self.writes}

    def may_run(self, world: World) -> bool:
        return all(c(world) for c in self.conditions)

    def __call__(self, world: World) -> bool:
        """Runs if its conditions hold; says whether it ran."""
        if not self.may_run(world):
            return False
        given = {n: world.get(n) for n in self.reads} | {n: world.find(n) for n in self.optional}
        given |= {n: make(world) for n, make in self.extract}
        if "local" in inspect.signature(self.function).parameters:
            given["local"] = self.local
        made = self.function(**given)
        if made is not None:
            for name, value in (made if isinstance(made, dict) else {self.writes[0]: made}).items():
                if name not in self.writes:
                    raise ValueError(f"{self.name} writes {name!r} without declaring it")
                world.put(name, value)
        return True


def system(phase: Any = None, *, writes: Iterable[str] = (), optional: Iterable[str] = (), name: str | None = None, extract: dict[str, Callable[[World], Any]] | None = None, **more: Any) -> Callable[[Callable[..., Any]], System]:
    """Decorator: what the function reads are its parameters, but `local`, the optional and the extracted ones."""

    def wrap(function: Callable[..., Any]) -> System:
        own = tuple(p for p in inspect.signature(function).parameters if p != "local" and p not in (*optional, *(extract or ())))
        return System(name or function.__name__, function, phase, own, tuple(optional), tuple(writes), extract=tuple((extract or {}).items()), **{k: tuple(v) for k, v in more.items()})

    return wrap
