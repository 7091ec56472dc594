"""Global aggregates that merge in two levels.

A global aggregate sends every task's partial result to one task. That is fine
for counts, but with sketches of tens of kilobytes, many columns and a hundred
thousand tasks it is a lot for one. Here partial results first meet in a fixed
number of groups of tasks, and the results of the groups meet in the last task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GROUPS = 128
_GROUP = "__task_group"
SKETCH_SIZE = 4_000


class Merge(Enum):
    SUM = "sum"
    SKETCH = "sketch"
    VALUES = "values"


@dataclass(frozen=True)
class Measure:
    """An aggregate over rows, and how its results combine."""

    partial: Column
    merge: Merge = Merge.SUM

    def merged(self, name: str) -> Column:
        if self.merge is Merge.SKETCH:
            return F.kll_merge_agg_double(name, F.lit(SKETCH_SIZE))
        if self.merge is Merge.VALUES:
            return F.array_sort(F.flatten(F.collect_list(name)))
        return F.coalesce(F.sum(name), F.lit(0))


def count_where(condition: Column) -> Measure:
    return Measure(F.count_if(condition))


def sketch(value: Column) -> Measure:
    """A quantile sketch of a double column."""
    return Measure(F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE)), Merge.SKETCH)


def values(value: Column) -> Measure:
    """All non-null values in order; for columns known to hold few."""
    return Measure(F.collect_list(value), Merge.VALUES)


def summarise(df: DataFrame, measures: Mapping[str, Measure]) -> DataFrame:
    """One row with every measure, from one scan."""
    grouped = df.withColumn(_GROUP, F.pmod(F.spark_partition_id(), F.lit(_GROUPS)))
    partial = grouped.groupBy(_GROUP).agg(*[m.partial.alias(n) for n, m in measures.items()])
    return partial.agg(*[m.merged(n).alias(n) for n, m in measures.items()])
