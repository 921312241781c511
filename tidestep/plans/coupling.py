"""Coupled applications: named sub-worlds that a parent ticks and that exchange frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from tidestep.plans.app import App
from tidestep.plans.world import MissingResource, World
from tidestep.sources.config import Config


class Physics(Protocol):
    """What a coupled participant offers."""

    name: str

    def prepare(self) -> None: ...
    def step(self) -> None: ...
    def is_done(self) -> bool: ...
    def cleanup(self) -> None: ...
    def find(self, resource: str) -> Any: ...


@dataclass
class AppPhysics:
    """An application as a participant."""

    name: str
    app: App

    def prepare(self) -> None:
        self.app.prepare()

    def step(self) -> None:
        self.app.run()

    def is_done(self) -> bool:
        return self.app.is_done()

    def cleanup(self) -> None:
        self.app.cleanup()

    def find(self, resource: str) -> Any:
        return self.app.world.find(resource)


@dataclass
class Mirror:
    """A participant that stands for a peer: each setup or step sends and receives named resources, all sends before all receipts.

    Peers meet through a board of (iteration, resource) values, which are frames: the exchange is a binding, the data stay where they are.
    """

    name: str
    board: dict
    own: str
    world: World
    at_setup: list[tuple[str, str]] = field(default_factory=list)
    each_iteration: list[tuple[str, str]] = field(default_factory=list)
    exports: dict[str, Callable[[], Any]] = field(default_factory=dict)
    iteration: int = 0

    def send_each_iteration(self, resource: str, export: Callable[[], Any]) -> Mirror:
        """export gives the value as it is at the sending, so no iteration lags."""
        self.each_iteration.append(("send", resource))
        self.exports[resource] = export
        return self

    def receive_each_iteration(self, resource: str) -> Mirror:
        self.each_iteration.append(("receive", resource))
        return self

    def send_at_setup(self, resource: str, export: Callable[[], Any]) -> Mirror:
        self.at_setup.append(("send", resource))
        self.exports[resource] = export
        return self

    def receive_at_setup(self, resource: str) -> Mirror:
        self.at_setup.append(("receive", resource))
        return self

    def with_resource(self, resource: str, value: Any) -> Mirror:
        """A resource that the mirror holds and never exchanges."""
        self.world.put(resource, value)
        return self

    def _pump(self, which: list[tuple[str, str]], key: Any) -> None:
        for verb, r in which:
            if verb == "send":
                self.board[self.own, key, r] = self.exports[r]()
        for verb, r in which:
            if verb == "receive":
                self.world.put(r, self.board[self.name, key, r])

    def prepare(self) -> None:
        self._pump(self.at_setup, "setup")

    def step(self) -> None:
        self._pump(self.each_iteration, self.iteration)
        self.iteration += 1

    def is_done(self) -> bool:
        return False

    def cleanup(self) -> None:
        return None

    def find(self, resource: str) -> Any:
        return self.world.find(resource)


@dataclass(frozen=True)
class Handle:
    multi: Multi
    namespace: str

    def get(self, resource: str) -> Any:
        return self.multi.expect(self.namespace, resource)

    def put(self, resource: str, value: Any) -> None:
        if not self.multi.write(self.namespace, resource, value):
            raise MissingResource(f"no resource {resource!r} in {self.namespace!r}")


class Multi:
    """The participants of a parent, in order of their registration."""

    def __init__(self) -> None:
        self._held: dict[str, Physics] = {}
        self._ready: set[str] = set()

    def add(self, participant: Physics) -> Multi:
        if participant.name in self._held:
            raise ValueError(f"participant {participant.name!r} is added twice")
        self._held[participant.name] = participant
        return self

    def add_app(self, name: str, app: App) -> Multi:
        app.world.namespace = name
        return self.add(AppPhysics(name, app))

    def add_app_with_config(self, name: str, config: Config, build: Callable[[App], None], base: dict | None = None) -> Multi:
        """A sub-application that gets its own slice of the configuration, laid over a base, before it is built."""
        app = App(namespace=name).put("config", config.for_subapp(name, base))
        build(app)
        return self.add_app(name, app)

    def at(self, name: str) -> Handle:
        """A participant's resources by a handle of fixed namespace; a missing one is an error."""
        return Handle(self, name)

    def participants(self) -> list[str]:
        return list(self._held)

    def find(self, name: str) -> Physics | None:
        return self._held.get(name)

    def read(self, name: str, resource: str) -> Any | None:
        own = self.find(name)
        return own and own.find(resource)

    def expect(self, name: str, resource: str) -> Any:
        if (found := self.read(name, resource)) is None:
            raise MissingResource(f"no resource {resource!r} in {name!r}")
        return found

    def write(self, name: str, resource: str, value: Any) -> bool:
        own = self.find(name)
        if not isinstance(own, AppPhysics) or own.find(resource) is None:
            return False
        own.app.world.put(resource, value)
        return True

    def tick(self, name: str, n: int = 1) -> None:
        """n steps of a participant, which is prepared before its first; one that is done goes on."""
        own = self._held[name]
        if name not in self._ready:
            self._ready.add(name)
            own.prepare()
        for _ in range(n):
            own.step()

    def any_done(self) -> bool:
        return any(p.is_done() for p in self._held.values())

    def cleanup_all(self) -> None:
        for p in self._held.values():
            p.cleanup()

    def snapshot(self, name: str, resource: str) -> None:
        self._held[name].app.world.snapshot(resource)

    def restore(self, name: str, resource: str) -> bool:
        return self._held[name].app.world.restore(resource)


@dataclass
class OuterIterations:
    """Ends a parent's run after n iterations; asked after the body, so one runs at least."""

    n: int
    iteration: int = 0

    def step(self, app: App) -> None:
        from tidestep.plans.schedule import State

        self.iteration += 1
        if self.iteration >= self.n:
            app.control.state = State.END
