"""A world: the named state that systems read and replace.

Frames are immutable, so writing is binding a name to another DataFrame, and a snapshot costs nothing but the reference.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidestep.storage import cut


class MissingResource(KeyError):
    pass


class World:
    def __init__(self, spark: SparkSession | None = None, namespace: str = "") -> None:
        self.spark, self.namespace = spark, namespace
        self._held: dict[str, Any] = {}
        self._saved: dict[str, Any] = {}
        self._order: list[str] = []

    def put(self, name: str, value: Any, same_schema: bool = False) -> World:
        """Binds a DataFrame or a driver value; an existing name keeps its place. same_schema: refuse a frame of other columns."""
        if same_schema and isinstance(self._held.get(name), DataFrame) and self._held[name].schema != value.schema:
            raise TypeError(f"{name} changes its schema")
        if name not in self._held:
            self._order.append(name)
        self._held[name] = value
        return self

    def get(self, name: str) -> Any:
        if name not in self._held:
            raise MissingResource(f"no resource {name!r}" + (f" in {self.namespace!r}" if self.namespace else ""))
        return self._held[name]

    def find(self, name: str) -> Any | None:
        return self._held.get(name)

    def update(self, name: str, change) -> World:
        return self.put(name, change(self.get(name)))

    def remove(self, name: str) -> Any | None:
        if name in self._held:
            self._order.remove(name)
        return self._held.pop(name, None)

    def names(self) -> list[str]:
        return list(self._order)

    def __contains__(self, name: str) -> bool:
        return name in self._held

    def view(self, name: str) -> str:
        """Registers a frame for SQL as namespace_name."""
        view = f"{self.namespace}_{name}" if self.namespace else name
        self.get(name).createOrReplaceTempView(view)
        return view

    def pin(self, name: str) -> World:
        """Cuts the lineage of a frame."""
        return self.put(name, cut(self.get(name)))

    def snapshot(self, name: str) -> None:
        """Keeps the present value; an earlier snapshot is replaced."""
        self._saved[name] = self.get(name)

    def restore(self, name: str) -> bool:
        """Puts the snapshot back and empties its slot; without one nothing happens."""
        if name not in self._saved:
            return False
        self.put(name, self._saved.pop(name))
        return True
