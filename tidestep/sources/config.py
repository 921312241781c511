"""Configuration: TOML tables, their sections, overlays and leaf paths."""

from __future__ import annotations

import argparse
import json
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    pass


def deep_merge(base: dict, over: dict) -> dict:
    """Tables merge; anything else of `over` replaces, arrays as a whole."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def leaves(table: dict, prefix: str = "") -> dict[str, Any]:
    """Leaf values by dotted path."""
    out: dict[str, Any] = {}
    for k, v in table.items():
        if isinstance(v, dict) and v:
            out |= leaves(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = v
    return out


@dataclass
class Config:
    table: dict = field(default_factory=dict)
    loaded: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> Config:
        try:
            return Config(tomllib.loads(text))
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(str(e)) from e

    @staticmethod
    def read(path: str) -> Config:
        if Path(path).suffix != ".toml":
            raise ConfigError(f"{path} isn't a .toml file")
        return Config.parse(Path(path).read_text())

    def section(self, name: str, kind: Any = dict) -> Any:
        """A section as a dataclass (or dict), its defaults where nothing is said; malformed fields are an error, and unknown ones if the type says DENY_UNKNOWN."""
        own = self.table.get(name, {})
        if not isinstance(own, dict):
            raise ConfigError(f"[{name}] isn't a table")
        return self._of(kind, own, name)

    def _of(self, kind: Any, own: dict, name: str) -> Any:
        if not is_dataclass(kind):
            return kind(own)
        known = {f.name: f for f in fields(kind)}
        if (odd := sorted(set(own) - set(known))) and getattr(kind, "DENY_UNKNOWN", False):
            raise ConfigError(f"[{name}] has unknown fields: {', '.join(odd)}")
        own = {k: v for k, v in own.items() if k in known}
        for k, v in own.items():
            want = {"int": int, "float": (int, float), "str": str, "bool": bool, "list": list}.get(getattr(known[k].type, "__name__", str(known[k].type)).split("[")[0])
            if want and (not isinstance(v, want) or isinstance(v, bool) and want is not bool):
                raise ConfigError(f"[{name}] {k} = {v!r} should be {known[k].type}")
        return kind(**own)

    def load(self, name: str, kind: Any = dict) -> Any:
        self.loaded[name] = self.section(name, kind)
        return self.loaded[name]

    def array(self, name: str, kind: Any = dict) -> list:
        """The tables of [[name]]; none if it is missing or no array."""
        own = self.table.get(name, [])
        return [self._of(kind, x, name) for x in own] if isinstance(own, list) else []

    def for_subapp(self, name: str, base: dict | None = None) -> Config:
        """The base with the [name.*] tables laid over it."""
        return Config(deep_merge(base or {}, self.table.get(name, {})))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(path, value as JSON) of every leaf."""
        return spark.createDataFrame([(p, json.dumps(v, default=str)) for p, v in leaves(self.table).items()], "path string, value string")


@dataclass
class Input:
    path: str | None
    output_dir: str
    generate_config: bool = False


def command_line(arguments: list[str], have: Config | None = None) -> tuple[Config, Input]:
    """`config.toml [--generate-config]`; a Config that exists already stays. Output goes to [output].dir, else beside the file."""
    parser = argparse.ArgumentParser()
    parser.add_argument("config", nargs="?")
    parser.add_argument("--generate-config", action="store_true")
    own = parser.parse_args(arguments)
    config = have or (Config.read(own.config) if own.config else Config())
    output = config.table.get("output", {}).get("dir") or (str(Path(own.config).parent) if own.config else ".")
    return config, Input(own.config, output, own.generate_config)


def parsed_arrays(texts: DataFrame, key: str, text: str, name: str, schema: str) -> DataFrame:
    """(key, i, fields): the elements of the array of tables `name` in each config text, in order from 0; a field that isn't said is null. Texts are parsed in the tasks; a malformed one is an error."""
    fields = [f.split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, i, *(element.get(f) for f in fields)) for k, t in zip(frame[key], frame[text], strict=True) for i, element in enumerate(Config.parse(t or "").array(name))]
            yield pd.DataFrame(found, columns=[key, "i", *fields])

    return texts.select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, i int, {schema}")
