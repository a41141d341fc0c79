"""Small filter languages, parsed on the driver into columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EQUAL_WITHIN

_CONFIDENCE = re.compile(r"\s*(<=|>=|<|>|=)\s*(\S+)\s*")

# What a section's condition may look at.
STATE_PATHS = (
    "constraints.frozen_count", "constraints.restricted_count", "constraints.approval_count", "constraints.tests_required_count",
    "constraints.docs_required_count", "constraints.protected_count", "domains.count", "layers.count", "entry_points.count",
    "variables.count", "attempts.active_count", "hacks.count", "hacks.expired_count",
)


def confidence(text: str, column: Column) -> Column:
    """``<0.7``, ``>=0.9``, ``=0.5`` and so on; equality allows for a thousandth."""
    found = _CONFIDENCE.fullmatch(text)
    if not found:
        raise ValueError(f"not a confidence filter: {text!r}")
    value = float(found[2])
    return {
        "<": column < value,
        "<=": column <= value,
        ">": column > value,
        ">=": column >= value,
        "=": F.abs(column - value) < EQUAL_WITHIN,
    }[found[1]]


def state(text: str, row: dict[str, Column]) -> Column:
    """``path op integer`` over the project's state; anything else is false."""
    parts = text.split()
    if len(parts) != 3 or parts[0] not in row or not re.fullmatch(r"-?\d+", parts[2]):
        return F.lit(False)
    left, right = row[parts[0]], int(parts[2])
    made = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "==": left == right, "!=": left != right}
    return made.get(parts[1], F.lit(False))
