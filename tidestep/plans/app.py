"""Applications: a scheduler with its world, composed of plugins whose contracts are checked before anything runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import SparkSession

from tidestep.plans.schedule import Group, Node, RunControl, Scheduler, State
from tidestep.plans.states import StateMachine, check_stage_advance
from tidestep.plans.system import System
from tidestep.plans.world import World


class ContractError(ValueError):
    pass


class Plugin:
    """name; is_unique: a second of the name is refused; dependencies: plugins added before; provides, requires: capabilities, checked at the start."""

    name: str = ""
    is_unique: bool = True
    dependencies: tuple[str, ...] = ()
    provides: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    default_config: str | None = None

    def build(self, app: App) -> None:
        raise NotImplementedError


class FunctionPlugin(Plugin):
    is_unique = False

    def __init__(self, function: Callable[[App], None]) -> None:
        self.name, self.function = function.__name__, function

    def build(self, app: App) -> None:
        self.function(app)


class PluginGroup:
    """Plugins in order. Disabling a name leaves out those that are added later, and none that is there."""

    def __init__(self, plugins: Iterable[Any] = ()) -> None:
        self.plugins: list[Plugin] = []
        self.disabled: set[str] = set()
        for p in plugins:
            self.add(p)

    def add(self, plugin: Any) -> PluginGroup:
        own = plugin if isinstance(plugin, Plugin) else FunctionPlugin(plugin)
        if own.name not in self.disabled:
            self.plugins.append(own)
        return self

    def disable(self, name: str) -> PluginGroup:
        self.disabled.add(name)
        return self

    def finish(self) -> list[Plugin]:
        return list(self.plugins)


class App:
    def __init__(self, spark: SparkSession | None = None, namespace: str = "") -> None:
        self.world = World(spark, namespace)
        self.scheduler = Scheduler(self.world)
        self.world.put("run_control", self.scheduler.control)
        self.plugins: list[Plugin] = []
        self.snippets: list[str] = []
        self.generate_config = False
        self.printed: str | None = None
        self._cleanups: list[tuple[bool, Callable]] = []
        self._prepared = False

    def add_plugins(self, *plugins: Any) -> App:
        for p in plugins:
            if isinstance(p, PluginGroup):
                self.add_plugins(*p.finish())
            elif isinstance(p, (list, tuple)):
                self.add_plugins(*p)
            else:
                self._add(p if isinstance(p, Plugin) else FunctionPlugin(p))
        return self

    def _add(self, plugin: Plugin) -> None:
        have = {p.name for p in self.plugins}
        if plugin.is_unique and plugin.name in have:
            raise ContractError(f"plugin {plugin.name!r} is added twice")
        if lost := [d for d in plugin.dependencies if d not in have]:
            raise ContractError(f"plugin {plugin.name!r} needs {', '.join(lost)} before it")
        self.plugins.append(plugin)
        if plugin.default_config:
            self.snippets.append(plugin.default_config)
        plugin.build(self)

    def validate_contracts(self) -> None:
        provided = {c for p in self.plugins for c in p.provides}
        if lost := [f"{p.name!r} requires {c!r}" for p in self.plugins for c in p.requires if c not in provided]:
            raise ContractError("; ".join(lost))

    def put(self, name: str, value: Any) -> App:
        self.world.put(name, value)
        return self

    def add_systems(self, *systems: System | Group) -> App:
        self.scheduler.add(*systems)
        return self

    def add_setup_systems(self, *systems: System) -> App:
        self.scheduler.add_setup(*systems)
        return self

    def set_schedule(self, tree: Node) -> App:
        self.scheduler.set_schedule(tree)
        return self

    def on_cleanup(self, function: Callable, with_app: bool = False) -> App:
        self._cleanups.append((with_app, function))
        return self

    def cleanup(self) -> None:
        """Those that take the app first, then the others, each kind in the order in which they came; each once."""
        held, self._cleanups = self._cleanups, []
        for wants in (True, False):
            for with_app, function in held:
                if with_app == wants:
                    function(self) if with_app else function()

    def prepare(self) -> App:
        if not self._prepared:
            self._prepared = True
            self.validate_contracts()
            self.scheduler.prepare()
        return self

    def run(self) -> App:
        self.scheduler.run()
        return self

    @property
    def control(self) -> RunControl:
        return self.scheduler.control

    def is_done(self) -> bool:
        return self.control.state is State.END

    def start(self, most_steps: int | None = None) -> App:
        if self.generate_config:
            self.printed = "\n\n".join(x.strip() for x in self.snippets)
            print(f"# The defaults of all plugins\n\n{self.printed}\n")
            self.cleanup()
            return self
        self.validate_contracts()
        self.scheduler.start(most_steps)
        self.cleanup()
        return self


class StatesPlugin(Plugin):
    """A state machine that a phase's system moves on."""

    is_unique = False

    def __init__(self, name: str, start: Any, phase: Any = None) -> None:
        self.name, self.start, self.phase = name, start, phase

    def build(self, app: App) -> None:
        machine = StateMachine(self.start)
        app.put(self.name, machine)
        app.add_systems(System(f"apply_{self.name}", lambda: None if machine.apply() else None, self.phase))


class StageAdvancePlugin(Plugin):
    is_unique = False

    def __init__(self, machine: str, stages: list[Any], phase: Any = None) -> None:
        self.name, self.machine, self.stages, self.phase = f"stages_of_{machine}", machine, stages, phase
        self.dependencies = (machine,)

    def build(self, app: App) -> None:
        app.add_systems(System(f"advance_{self.machine}", lambda: check_stage_advance(app.world.get(self.machine), app.control, self.stages), self.phase))
