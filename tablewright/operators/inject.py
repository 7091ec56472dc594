"""Controlled damage: each injector turns a share of rows into a known issue.

Every injector takes a DataFrame and returns one, as a column expression over a
draw that depends on the row's identity only. Seeds keep the issues independent.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.draws import row_identity, uniform
from .schemas import cast_to

# Fixed offsets added to the base seed, one per kind of damage.
MISSING, MISSING_SECOND = 10, 11
OUTLIER, SKEW, LABEL_NOISE, LABEL_NULL, DUPLICATE = 20, 30, 40, 50, 60


def _hit(df: DataFrame, seed: int, rate: float, ids: Sequence[str] | None) -> Column:
    return uniform(seed, *row_identity(df, ids)) < F.lit(float(rate))


def replace_where(
    df: DataFrame, column: str, value: Column, rate: float, seed: int, ids: Sequence[str] | None = None
) -> DataFrame:
    """Replace a column's value in a share of the rows, keeping its type."""
    if rate == 0:
        return df
    data_type = df.schema[column].dataType
    damaged = F.when(_hit(df, seed, rate, ids), value.cast(data_type)).otherwise(col(column))
    return df.withColumn(column, damaged)


def missing_values(df, column, rate, seed=MISSING, ids=None) -> DataFrame:
    return replace_where(df, column, F.lit(None), rate, seed, ids)


def constant_outliers(df, column, value, rate, seed=OUTLIER, ids=None) -> DataFrame:
    return replace_where(df, column, F.lit(value), rate, seed, ids)


def heavy_key(df, column, value, rate, seed=SKEW, ids=None) -> DataFrame:
    return replace_where(df, column, F.lit(value), rate, seed, ids)


def flipped_labels(df, column, first, second, rate, seed=LABEL_NOISE, ids=None) -> DataFrame:
    """Swap a binary label; a value that is neither becomes ``first``."""
    other = F.when(col(column) == F.lit(first), F.lit(second)).otherwise(F.lit(first))
    return replace_where(df, column, other, rate, seed, ids)


def target_noise(df, column, error, rate, seed=LABEL_NOISE, ids=None) -> DataFrame:
    return replace_where(df, column, col(column) + F.lit(error), rate, seed, ids)


def missing_labels(df, column, rate, seed=LABEL_NULL, ids=None) -> DataFrame:
    return replace_where(df, column, F.lit(None), rate, seed, ids)


def drifted_schema(
    df: DataFrame, types: Mapping[str, str], added: Mapping[str, object] | None = None
) -> DataFrame:
    """Change column types and add constant columns, in one projection."""
    changed = {c: cast_to(col(c), t) for c, t in types.items()}
    return df.withColumns(changed | {c: F.lit(v) for c, v in (added or {}).items()})


def duplicate_rows(df, rate, seed=DUPLICATE, ids=None) -> DataFrame:
    """Append exact copies of a share of the rows."""
    return df if rate == 0 else df.unionByName(df.filter(_hit(df, seed, rate, ids)))
