"""Driver-side state machines and their tie to run stages."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from tidestep.plans.schedule import RunControl


@dataclass
class StateMachine:
    """A current state and a pending one, which `apply` makes current."""

    current: Any
    pending: Any = None
    has_pending: bool = False
    #: What the last check saw; no check yet: no index, and `seen` says nothing.
    seen_index: int | None = None
    seen: Any = None

    def set(self, state: Any) -> None:
        self.pending, self.has_pending = state, True

    def clear(self) -> None:
        self.pending, self.has_pending = None, False

    def apply(self) -> bool:
        if not self.has_pending:
            return False
        self.current = self.pending
        self.clear()
        return True


def check_stage_advance(machine: StateMachine, control: RunControl, stages: list[Any]) -> None:
    """A new stage sets the machine's state, if it differs, and cancels what is pending then; a state that the user changed asks for the next stage.

    An index without a stage leaves the state as it is. The first check only notes where things stand.
    """
    first = machine.seen_index is None
    if control.index != machine.seen_index:
        if not first and 0 <= control.index < len(stages) and machine.current != stages[control.index]:
            machine.current = machine.seen = stages[control.index]
            machine.clear()
        machine.seen_index = control.index
    if not first and machine.seen != machine.current:
        control.advance_requested = True
    machine.seen = machine.current
