"""Severity ladders, usable on a Python number and on a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ladder:
    """Ordered rungs ``(grade, comparison, bound)``; the first that holds wins."""

    rungs: tuple[tuple[str, str, float], ...]
    top: str = "high"
    when_null: str | None = None

    def grade(self, value: float | None) -> str | None:
        if value is None:
            return self.when_null
        for name, comparison, bound in self.rungs:
            if _holds(value, comparison, bound):
                return name
        return self.top

    def column(self, value: Column) -> Column:
        ladder = F.when(value.isNull(), F.lit(self.when_null))
        for name, comparison, bound in self.rungs:
            ladder = ladder.when(_holds(value, comparison, bound), F.lit(name))
        return ladder.otherwise(F.lit(self.top))


def _holds(value, comparison: str, bound: float):
    if comparison == "=":
        return value == bound
    if comparison == "<":
        return value < bound
    return value <= bound


# The grade borders every report is read against.
MISSINGNESS = Ladder((("none", "=", 0.0), ("low", "<", 0.10), ("medium", "<=", 0.40)))
DUPLICATES = Ladder((("none", "=", 0.0), ("low", "<=", 0.02), ("medium", "<=", 0.15)))
OUTLIERS = Ladder((("none", "=", 0.0), ("low", "<", 0.05)))
SKEW = Ladder((("low", "<=", 5.0), ("medium", "<=", 10.0)), when_null="unknown")
LABEL_NOISE = Ladder((("none", "=", 0.0), ("low", "<", 0.03), ("medium", "<=", 0.10)))
