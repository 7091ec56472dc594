"""Interquartile-range outliers and deviations from a dominant value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grades, quantiles
from ..functions.columns import Snapshot, col, is_numeric, parse_type, present, ratio, rows_from_structs

IQR, ZERO_IQR = "iqr", "zero_iqr_deviation"
ZERO_IQR_MESSAGE = (
    "Q1 and Q3 are equal. Deviations from that value are counted, but capping "
    "would overwrite them all, so it is left out."
)


@dataclass(frozen=True)
class Fence:
    """The quartiles of a column and the bounds they give."""

    q1: float
    q3: float
    multiplier: float = 1.5

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1

    @property
    def repairable(self) -> bool:
        return self.iqr != 0

    @property
    def method(self) -> str:
        return IQR if self.repairable else ZERO_IQR

    @property
    def lower(self) -> float | None:
        return self.q1 - self.multiplier * self.iqr if self.repairable else None

    @property
    def upper(self) -> float | None:
        return self.q3 + self.multiplier * self.iqr if self.repairable else None

    def breaks(self, value: Column) -> Column:
        if self.repairable:
            return (value < self.lower) | (value > self.upper)
        return value != self.q1


def numeric_values(df: DataFrame, reference: Snapshot | None = None) -> dict[str, Column]:
    """Numeric columns as doubles without NaN.

    With a reference schema, a text column that used to be numeric is read as
    the number it holds, so drift does not hide its outliers.
    """
    values = {}
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            values[f.name] = present(col(f.name), f.dataType).cast("double")
        elif drifted_from_number(f.name, f.dataType, reference):
            number = col(f.name).try_cast("double")
            values[f.name] = F.when(~F.isnan(number), number)
    return values


def drifted_from_number(name, data_type, reference: Snapshot | None) -> bool:
    if reference is None or name not in reference or data_type.typeName() != "string":
        return False
    return is_numeric(parse_type(str(reference[name]["data_type"])))


def find_fences(
    df: DataFrame, values: Mapping[str, Column], multiplier: float = 1.5, exact: bool = True
) -> dict[str, Fence]:
    """Quartile fences of many columns; columns without values have none."""
    quartiles = (quantiles.exact if exact else quantiles.approximate)(df, values, [0.25, 0.75])
    return as_fences(quartiles, multiplier)


def as_fences(quartiles: Mapping[str, Sequence[float | None]], multiplier: float) -> dict[str, Fence]:
    return {
        name: Fence(q1, q3, multiplier) for name, (q1, q3) in quartiles.items() if q1 is not None
    }


def outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    multiplier: float = 1.5,
    exact: bool = True,
    reference: Snapshot | None = None,
) -> DataFrame:
    """One row per numeric column with its fences and the rows beyond them.

    The ratio is over all rows, missing ones included; ``valid_count`` gives the
    rows that have a value. All columns are counted in one scan.
    """
    values = numeric_values(df, reference)
    if columns is not None:
        values = {c: values[c] for c in columns}
    return count_outliers(df, values, find_fences(df, values, multiplier, exact))


def count_outliers(df: DataFrame, values: Mapping[str, Column], fences: Mapping[str, Fence]) -> DataFrame:
    if not fences:
        return df.sparkSession.createDataFrame([], _TABLE)
    names = list(fences)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(fences[n].breaks(values[n])).alias(f"out_{i}") for i, n in enumerate(names)],
        *[F.count(values[n]).alias(f"valid_{i}") for i, n in enumerate(names)],
    )
    entries = [
        F.struct(
            F.lit(n).alias("column"),
            F.lit(fences[n].q1).cast("double").alias("q1"),
            F.lit(fences[n].q3).cast("double").alias("q3"),
            F.lit(fences[n].iqr).cast("double").alias("iqr"),
            F.lit(fences[n].lower).cast("double").alias("lower_bound"),
            F.lit(fences[n].upper).cast("double").alias("upper_bound"),
            F.col(f"out_{i}").alias("outlier_count"),
            F.col(f"valid_{i}").alias("valid_count"),
            F.col("rows").alias("row_count"),
            F.lit(fences[n].method).alias("method"),
            F.lit(fences[n].repairable).alias("repairable"),
        )
        for i, n in enumerate(names)
    ]
    share = ratio(F.col("outlier_count"), F.col("row_count"))
    return (
        rows_from_structs(counted, entries)
        .withColumn("outlier_ratio", share)
        .withColumn("severity", grades.OUTLIERS.column(F.col("outlier_ratio")))
    )


_TABLE = (
    "column string, q1 double, q3 double, iqr double, lower_bound double, "
    "upper_bound double, outlier_count bigint, valid_count bigint, row_count bigint, "
    "method string, repairable boolean, outlier_ratio double, severity string"
)
