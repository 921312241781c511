"""Frame sinks: tables by step, and raw payloads by path template."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidestep.functions.format import expand
from tidestep.plans.app import App, Plugin
from tidestep.plans.conditions import every_n_steps
from tidestep.plans.system import System


@dataclass
class DumpConfig:
    """[dump]: every so many steps (0: never), and where."""

    interval: int = 0
    path_template: str = "frame_{step:06}.bin"


def write_frames(df: DataFrame, path: str, step: str = "step", mode: str = "error", parts: int = 8) -> None:
    """One folder per step; a step's rows are dealt in turns over so many tasks, so each step is a few files and none is one task's alone."""
    dealt = df.repartition(F.col(step), F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    dealt.write.mode(mode).partitionBy(step).parquet(path)


def due(df: DataFrame, config: DumpConfig, step: str = "step") -> DataFrame | None:
    """The rows that the interval writes; None where nothing is ever written."""
    return df.filter(F.col(step) % config.interval == 0) if config.interval > 0 else None


class _Writer(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, rows: Iterator) -> WriterCommitMessage:
        for row in rows:
            target = os.path.join(self.folder, row["path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.part", "wb") as f:
                f.write(row["payload"])
            os.replace(f"{target}.part", target)
        return WriterCommitMessage()


class FrameFiles(DataSource):
    """Format `frames`: writes (path string, payload binary) rows as files below the folder in option `path`, which all executors share."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "path string, payload binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class DumpPlugin(Plugin):
    """Writes a frame of the world as one table per due step. An error is logged and the run goes on; an interval of 0 registers nothing."""

    name = "dump"
    is_unique = False
    default_config = '[dump]\ninterval = 0\npath_template = "frame_{step:06}"\n'

    def __init__(self, resource: str, folder: str, config: DumpConfig, phase: Any = None) -> None:
        self.resource, self.folder, self.config, self.phase = resource, folder, config, phase

    def build(self, app: App) -> None:
        if self.config.interval <= 0:
            return

        def write(clock, **frames) -> None:
            try:
                frames[self.resource].write.mode("overwrite").parquet(f"{self.folder}/{expand(self.config.path_template, clock.step, clock.time)}")
            except Exception:
                logging.getLogger("tidestep").exception("step %s wasn't dumped", clock.step)

        app.add_systems(System(f"dump_{self.resource}", write, self.phase, ("clock", self.resource)).run_if(every_n_steps(self.config.interval)))
