"""Display names and condition texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: conditions that name a state or stage.
STAGE = r"^in_st(?:ate|age)[(](.*)[)]$"


def short_name(name: Column) -> Column:
    """The last two segments of a path a::b::c."""
    return F.substring_index(name, "::", -2)


def condition_stage(text: Column) -> Column:
    """The state or stage that a condition's text names, in lower case; '' for others."""
    return F.lower(F.regexp_extract(text, STAGE, 1))


def stage_of_condition(text: str) -> str | None:
    m = re.match(STAGE, text)
    return m[1].lower() if m else None
