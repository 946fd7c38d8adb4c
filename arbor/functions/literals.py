"""Arrays of driver values as single literals of a plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_literal(values: Iterable[float | int], kind: str) -> Column:
    """An array constant. One string is parsed and folded by the optimizer, so its length doesn't cost calls or plan nodes."""
    text = ",".join(map(repr, values))
    return F.split(F.lit(text), ",").cast(f"array<{kind}>") if text else F.array().cast(f"array<{kind}>")
