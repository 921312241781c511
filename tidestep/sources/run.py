"""Staged runs: the [run] stages, the step clock, and the walk through them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidestep.plans.app import App, Plugin
from tidestep.plans.ordering import RUN_END
from tidestep.plans.schedule import State
from tidestep.plans.system import System
from tidestep.sources.config import Config, ConfigError, command_line, deep_merge

#: A stage's own fields; anything else in it is an override.
STAGE_FIELDS = {"name", "steps", "dt", "skip", "save_at_end"}


@dataclass
class Stage:
    name: str | None = None
    steps: int = 1000
    dt: float = 0.0
    skip: bool = False
    save_at_end: bool = False
    overrides: dict = field(default_factory=dict)


@dataclass
class Clock:
    step: int = 0
    time: float = 0.0

    def advance(self, dt: float = 0.0) -> None:
        self.step, self.time = self.step + 1, self.time + dt


def stages_of(config: Config) -> list[Stage]:
    """[run] is one stage, [[run]] several; without either one of the default steps."""
    own = config.table.get("run", {})
    tables = own if isinstance(own, list) else [own]
    out = []
    for t in tables:
        known = {k: v for k, v in t.items() if k in STAGE_FIELDS}
        if not isinstance(known.get("steps", 0), int) or known.get("steps", 0) < 0:
            raise ConfigError(f"[run] steps = {known['steps']!r}")
        out.append(Stage(**known, overrides={k: v for k, v in t.items() if k not in STAGE_FIELDS}))
    return out or [Stage()]


def stage_config(config: Config, stage: Stage) -> Config:
    """The configuration without `run`, with the stage's overrides laid over it."""
    return Config(deep_merge({k: v for k, v in config.table.items() if k != "run"}, stage.overrides))


def stage_frame(spark: SparkSession, stages: list[Stage]) -> DataFrame:
    """(i, name, steps, lo, occupied, ghost): a stage occupies steps [lo, lo + occupied). One that is skipped still runs a single ghost step."""
    rows, lo = [], 0
    for i, s in enumerate(stages):
        steps = 0 if s.skip else s.steps
        rows.append((i, s.name, steps, lo, max(steps, 1), steps == 0))
        lo += max(steps, 1)
    return spark.createDataFrame(rows, "i int, name string, steps long, lo long, occupied long, ghost boolean")


def first_stage_warnings(stages: list[Stage], sections: set[str]) -> list[tuple[int, str]]:
    """(stage, section) of overrides after the first stage in sections that only it reads."""
    return [(i, k) for i, s in enumerate(stages) if i > 0 for k in s.overrides if k in sections]


def validate_stages(stages: list[Stage], expected: list[str]) -> list[tuple[int, str | None, str | None]]:
    """(position, expected, actual) where the names differ."""
    names = [s.name for s in stages]
    n = max(len(names), len(expected))
    both = [(i, expected[i] if i < len(expected) else None, names[i] if i < len(names) else None) for i in range(n)]
    return [x for x in both if x[1] != x[2]]


class InputPlugin(Plugin):
    """Puts `config` and `input` from the command line; asked for it, the app gives its plugins' config snippets instead of running."""

    name = "input"

    def __init__(self, arguments: list[str]) -> None:
        self.arguments = arguments

    def build(self, app: App) -> None:
        config, own = command_line(self.arguments, app.world.find("config"))
        app.put("config", config).put("input", own)
        app.generate_config = app.generate_config or own.generate_config


class RunPlugin(Plugin):
    """Walks an app through its stages: a system at the end of each step counts, and goes on to the next stage or ends the run."""

    name = "run"

    def __init__(self, config: Config | None = None, expected: list[str] | None = None, phase: Any = None) -> None:
        self.config, self.expected, self.phase = config or Config(), expected, phase

    def build(self, app: App) -> None:
        stages = stages_of(self.config)
        if self.expected and (wrong := validate_stages(stages, self.expected)):
            raise ConfigError(f"stages differ from the expected names: {wrong}")
        clock, at = Clock(), {"done": 0}
        app.put("clock", clock)
        app.put("stage_config", stage_config(self.config, stages[0]))
        app.control.stage_name = stages[0].name or ""

        def cycle() -> None:
            stage = stages[min(app.control.index, len(stages) - 1)]
            clock.advance(stage.dt)
            at["done"] += 1
            if at["done"] >= (0 if stage.skip else stage.steps) or app.control.advance_requested:
                at["done"], app.control.advance_requested = 0, False
                app.control.index += 1
                if app.control.index >= len(stages):
                    app.control.state = State.END
                else:
                    nxt = stages[app.control.index]
                    app.control.stage_name = nxt.name or ""
                    app.put("stage_config", stage_config(self.config, nxt))
                    app.control.state = State.SETUP

        class End:
            NAMESPACE = RUN_END

        from tidestep.plans.ordering import set_namespace

        set_namespace(End, RUN_END)
        app.add_systems(System("update_cycle", cycle, self.phase or End))
