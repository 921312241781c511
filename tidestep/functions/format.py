"""Number formats and path templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below and from these magnitudes a number is written in powers of ten.
SMALL, LARGE = 1e-3, 1e6


def format_value(value: Column, width: int = 14, large: float = LARGE, small: float = SMALL) -> Column:
    """Six decimals, or powers of ten as 1.5e10 and 1.5e-7, right-aligned; null stays null."""
    power = F.regexp_replace(F.format_string("%.6e", value), r"e[+]?(-?)0*([0-9]+)", "e$1$2")
    plain = F.format_string("%.6f", value)
    text = F.when((value != 0) & ((F.abs(value) < small) | (F.abs(value) >= large)), power).otherwise(plain)
    return F.when(value.isNotNull(), F.format_string(f"%{width}s", text))


_FIELD = re.compile(r"\{([^{}]*)\}")


def dump_path(template: str, step: Column, time: Column | None = None) -> Column:
    """A path template over columns: {step}, {step:0N}, {time}; other fields and braces that don't close stay as they are."""
    parts: list[Column] = []
    at = 0
    for m in _FIELD.finditer(template):
        name, _, spec = m[1].partition(":")
        if name == "step" and not spec:
            own = step.cast("string")
        elif name == "step" and re.fullmatch(r"0\d+", spec):
            own = F.format_string(f"%0{int(spec)}d", step)
        elif name == "time" and not spec and time is not None:
            own = time.cast("string")
        else:
            continue
        parts += [F.lit(template[at : m.start()]), own]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def expand(template: str, step: int, time: float) -> str:
    """The same on the driver."""

    def one(m: re.Match) -> str:
        name, _, spec = m[1].partition(":")
        if name == "step" and (not spec or re.fullmatch(r"0\d+", spec)):
            return f"{step:0{int(spec)}d}" if spec else str(step)
        return str(time) if name == "time" and not spec else m[0]

    return _FIELD.sub(one, template)
