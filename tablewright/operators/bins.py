"""Numbers as bins, as many as a forest tells apart: rows of equal bins are one row to it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import inf, nextafter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.storage import COPIES, MARK

#: Bins a feature, as the library's forests have them.
BINS = 32
#: Different rows whose values say where the bins lie; rows that hold a thousandth of all are always among them.
_PLACED_BY, _HOT_SHARE = 100_000, 1_000


@dataclass(frozen=True)
class Bins:
    """For each column the values at which a new bin begins, in order."""

    edges: dict[str, tuple[float, ...]]

    @property
    def names(self) -> dict[str, str]:
        return {c: f"__bin_{i}" for i, c in enumerate(self.edges)}

    def add_to(self, df: DataFrame) -> DataFrame:
        """Add the number of each column's bin; values are neither null nor NaN."""
        numbers = df.withColumns({f"__of{n}": col(c).cast("double") for c, n in self.names.items()})
        split = [c for c, edges in self.edges.items() if edges]
        if split:
            places = Bucketizer(
                splitsArray=[[-inf, *self.edges[c], inf] for c in split],
                inputCols=[f"__of{self.names[c]}" for c in split], outputCols=[self.names[c] for c in split])
            numbers = places.transform(numbers)
        whole = {self.names[c]: F.lit(0.0) for c, edges in self.edges.items() if not edges}
        return numbers.withColumns(whole).drop(*[f"__of{n}" for n in self.names.values()])


def find_bins(distinct: DataFrame, columns: Sequence[str], rows: int) -> Bins:
    """Bins of like numbers of rows, or one for each value where there are no more values than bins.

    ``distinct`` has different rows with their hash and number. Bounds come from
    the rows with the lowest hashes, ten times as many as the library's forests
    take, weighted by their copies, so they do not depend on the layout.
    """
    share = min(1.0, _PLACED_BY / max(1, distinct.count()))
    low = F.col(MARK) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))
    chosen = distinct.filter(low | (F.col(COPIES) * _HOT_SHARE >= rows))
    pairs = [F.struct(F.lit(i).alias("i"), col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    values = chosen.select(COPIES, F.inline(F.array(*pairs))).groupBy("i", "v").agg(F.sum(COPIES).alias("n"))
    shares = ", ".join(f"{k / BINS}D" for k in range(1, BINS))
    # a row a column; a task holds the values of a column, at most about 101,000
    found = values.groupBy("i").agg(
        F.count(F.lit(1)).alias("values"), F.expr(f"percentile(v, array({shares}), n)").alias("quantiles"),
        F.slice(F.array_sort(F.collect_list("v")), 1, BINS).alias("first")).collect()
    edges = {r["i"]: _between(r["first"]) if r["values"] <= BINS else _beyond(r["quantiles"]) for r in found}
    return Bins({c: edges.get(i, ()) for i, c in enumerate(columns)})


def _between(values: Sequence[float]) -> tuple[float, ...]:
    middles = (max(a + (b - a) / 2, nextafter(a, inf)) for a, b in zip(values, values[1:]))
    return _rising(middles)


def _beyond(quantiles: Sequence[float]) -> tuple[float, ...]:
    """A value that holds a bin's rows or more, found as two quantiles, is a bin of its own."""
    again = {q for q, following in zip(quantiles, quantiles[1:]) if q == following}
    return _rising([*quantiles, *(nextafter(q, inf) for q in again)])


def _rising(values) -> tuple[float, ...]:
    return tuple(sorted({v for v in values if -inf < v < inf}))
