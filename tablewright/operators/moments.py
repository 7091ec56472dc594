"""Least squares for many splits of a table at once, from sums of products.

The sums of all products of two features decide a linear fit, and they add up
over parts of the table. So one scan gives the matrices of every split, each is
solved on the driver, and one more scan scores all fits on the rows they have
not seen. Rows with the same text values and splits are one group of sums; text
features are spread into one-hot products only after that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .categories import CategoryIndex, with_ranks

#: Matrices of more features are not brought to the driver.
MOST_FEATURES = 512
#: Sums in one aggregate; more are taken in several scans.
SUMS_AT_ONCE = 200
SPLITS = "__splits"


@dataclass(frozen=True)
class LinearFit:
    """Coefficients on numbers less their means, and on values by rank."""

    intercept: float
    means: dict[str, float]
    numeric: dict[str, float]
    text: dict[str, tuple[float, ...]]

    @property
    def raw_intercept(self) -> float:
        """The intercept for numbers as they are."""
        return self.intercept - sum(b * self.means[c] for c, b in self.numeric.items())

    def prediction(self, ranks: dict[str, str]) -> Column:
        value = F.lit(self.intercept)
        for c, slope in self.numeric.items():
            value = value + F.lit(slope) * (col(c) - F.lit(self.means[c]))
        for c, slopes in self.text.items():
            if slopes:
                place = (F.col(ranks[c]) + 1).cast("int")
                value = value + F.coalesce(F.try_element_at(F.lit(list(slopes)), place), F.lit(0.0))
        return value


def split_mask(training: Sequence[Column]) -> Column:
    """One number whose bit f tells whether a row trains split f. There can be 62 splits."""
    if len(training) > 62:
        raise ValueError("At most 62 splits are fitted at once.")
    bits = [F.when(t, F.lit(1 << f)).otherwise(F.lit(0)).cast("bigint") for f, t in enumerate(training)]
    return sum(bits, F.lit(0).cast("bigint"))


def trains(split: int) -> Column:
    """Whether a row with ``SPLITS`` trains the split; else it tests it."""
    return F.col(SPLITS).bitwiseAND(F.lit(1 << split).cast("bigint")) != 0


def split_sums(rows: DataFrame, label: str, numeric: Sequence[str], splits: int) -> dict:
    """Rows in all and in the training part of each split, and the means of numbers and label; one scan."""
    found = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(trains(f)).alias(f"n{f}") for f in range(splits)],
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate([*numeric, label])]).first()
    means = {c: found[f"m{i}"] for i, c in enumerate([*numeric, label])}
    return {"rows": found["rows"], "training": [found[f"n{f}"] for f in range(splits)], "means": means}


def _products(ranked: DataFrame, dense: list[Column], ranks: Sequence[tuple[str, int]], last: int, splits: int) -> DataFrame:
    """split, i, j, v: sums of products of features i and j over the training rows of each split.

    ``dense`` is one, the numbers and the label, of place ``last``; ``ranks`` has the rank columns with their first place.
    """
    place = [*range(len(dense) - 1), last]
    pairs = sorted(combinations_with_replacement(range(len(dense)), 2), key=lambda p: p[0] != 0)
    parts = [pairs[k : k + SUMS_AT_ONCE] for k in range(0, len(pairs), SUMS_AT_ONCE)]
    if len(dense) > SUMS_AT_ONCE:  # what text features need stays together
        parts = [pairs[: len(dense)], *(pairs[k : k + SUMS_AT_ONCE] for k in range(len(dense), len(pairs), SUMS_AT_ONCE))]
    found = None
    keys = [name for name, _ in ranks]

    def entry(i: Column, j: Column, v: Column) -> Column:
        known = i.isNotNull() & j.isNotNull()  # a value that the index lacks has no place
        return F.struct(F.when(known, F.least(i, j)).alias("i"), F.greatest(i, j).alias("j"), v.alias("v"))

    for number, part in enumerate(parts):
        sums = ranked.groupBy(SPLITS, *(keys if number == 0 else [])).agg(
            *[F.sum(dense[a] * dense[b]).alias(f"s{a}_{b}") for a, b in part])
        entries = [entry(F.lit(place[a]), F.lit(place[b]), F.col(f"s{a}_{b}")) for a, b in part]
        if number == 0:
            at = [(F.col(name) + first).cast("int") for name, first in ranks]
            entries += [entry(slot, F.lit(place[a]), F.col(f"s0_{a}")) for slot in at for a in range(len(dense))]
            entries += [entry(x, y, F.col("s0_0")) for x, y in combinations_with_replacement(at, 2)]
        spread = sums.select(SPLITS, F.inline(F.array(*entries))).filter("i IS NOT NULL AND v IS NOT NULL")
        bit = lambda f: F.call_function("shiftleft", F.lit(1).cast("bigint"), f)
        of_split = F.filter(F.sequence(F.lit(0), F.lit(splits - 1)), lambda f: F.col(SPLITS).bitwiseAND(bit(f)) != 0)
        counted = spread.select(F.explode(of_split).alias("split"), "i", "j", "v").groupBy("split", "i", "j").agg(F.sum("v").alias("v"))
        found = counted if found is None else found.unionByName(counted)
    return found


def solve(products: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The least-squares coefficients of least norm, features scaled alike; features that are always zero get zero."""
    scale = np.sqrt(np.diag(products))
    used = scale > 0
    result = np.zeros(len(target))
    if used.any():
        s = scale[used]
        result[used] = np.linalg.lstsq(products[np.ix_(used, used)] / np.outer(s, s), target[used] / s, rcond=1e-11)[0] / s
    return result


def linear_fits(
    ranked: DataFrame, label: str, numeric: Sequence[str], index: CategoryIndex, ranks: dict[str, str], sums: dict
) -> list[LinearFit]:
    """A fit for each split of the rows, whose numbers and ``SPLITS`` are there, from one scan."""
    splits, means = len(sums["training"]), sums["means"]
    firsts, size = [], 1 + len(numeric)
    for c in ranks:
        firsts.append((ranks[c], size))
        size += index.sizes[c]
    if size > MOST_FEATURES + 1:
        raise ValueError(f"{size - 1} features are more than {MOST_FEATURES}.")
    dense = [F.lit(1.0), *(col(c) - F.lit(means[c]) for c in [*numeric, label])]
    matrices = np.zeros((splits, size + 1, size + 1))
    for split, i, j, v in _products(ranked, dense, firsts, size, splits).collect():
        matrices[split, i, j] = matrices[split, j, i] = v
    fits = []
    for m in matrices:
        b = solve(m[:size, :size], m[:size, size])
        text = {c: tuple(b[first : first + index.sizes[c]].tolist()) for c, (_, first) in zip(ranks, firsts)}
        slopes = {c: float(b[1 + k]) for k, c in enumerate(numeric)}
        fits.append(LinearFit(float(b[0]) + means[label], {c: means[c] for c in numeric}, slopes, text))
    return fits


def held_out_scores(ranked: DataFrame, label: str, fits: Sequence[LinearFit], ranks: dict[str, str]) -> list[dict]:
    """RMSE, MAE and R squared of each fit on the rows that its split does not train on; one scan for all."""
    aggregates = []
    for f, fit in enumerate(fits):
        error = F.when(~trains(f), col(label) - fit.prediction(ranks))
        held = F.when(~trains(f), col(label))
        aggregates += [F.avg(error * error).alias(f"mse{f}"), F.avg(F.abs(error)).alias(f"mae{f}"), F.var_pop(held).alias(f"var{f}")]
    row = ranked.agg(*aggregates).first()
    found = []
    for f in range(len(fits)):
        mse, mae, variance = row[f"mse{f}"], row[f"mae{f}"], row[f"var{f}"]
        found.append({"rmse": mse**0.5, "mae": mae, "r2": 1 - mse / variance if variance else None} if mse is not None else
                     {"rmse": None, "mae": None, "r2": None})
    return found


def fit_splits(
    rows: DataFrame, label: str, numeric: Sequence[str], index: CategoryIndex, splits: int
) -> tuple[list[LinearFit], list[dict], dict]:
    """Fits, test scores, and counts of every split in ``SPLITS``. The rows are read three times, whatever the number of splits."""
    ranks = {c: f"__rank_{i}" for i, c in enumerate(index.sizes)}
    sums = split_sums(rows, label, numeric, splits)
    ranked = with_ranks(rows, index, ranks)
    fits = linear_fits(ranked, label, numeric, index, ranks, sums)
    return fits, held_out_scores(ranked, label, fits, ranks), sums
