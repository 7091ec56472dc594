"""Capping values to bounds and dropping rows outside a range."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_present, present

_INTEGER_BITS = {"byte": 8, "short": 16, "integer": 32, "long": 64}


def bound_in_type(bound: float, data_type: T.DataType, up: bool):
    """The bound as a value of the column's type, or None if no value can pass it.

    A lower bound rounds up and an upper one down, so a capped value is within
    the bounds and the column keeps its type.
    """
    name = data_type.typeName()
    if name in _INTEGER_BITS:
        edge = Decimal(bound).to_integral_value(ROUND_CEILING if up else ROUND_FLOOR)
        top = 2 ** (_INTEGER_BITS[name] - 1)
        if (up and edge <= -top) or (not up and edge >= top - 1):
            return None
        return int(max(-top, min(top - 1, edge)))
    if isinstance(data_type, T.DecimalType):
        step = Decimal(1).scaleb(-data_type.scale)
        top = Decimal(10) ** (data_type.precision - data_type.scale) - step
        exact = Decimal(bound)
        if (up and exact <= -top) or (not up and exact >= top):
            return None
        return max(-top, min(top, exact)).quantize(step, ROUND_CEILING if up else ROUND_FLOOR)
    return float(bound)


def capped(value: Column, data_type: T.DataType, lower: float | None, upper: float | None) -> Column:
    """The value moved to the nearer bound; nulls and NaN stay as they are."""
    result = value
    known = present(value, data_type)
    low = bound_in_type(lower, data_type, True) if lower is not None else None
    high = bound_in_type(upper, data_type, False) if upper is not None else None
    if high is not None:
        result = F.when(known > high, F.lit(high).cast(data_type)).otherwise(result)
    if low is not None:
        result = F.when(known < low, F.lit(low).cast(data_type)).otherwise(result)
    return result


def cap(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Cap several columns in one projection, each keeping its type."""
    return df.select(
        *[
            capped(col(f.name), f.dataType, *bounds[f.name]).alias(f.name)
            if f.name in bounds
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def within(name: str, data_type: T.DataType, low: float | None, high: float | None) -> Column:
    """Whether the column has a value inside the range.

    Plain comparisons joined by AND, so that a Parquet scan can skip row groups
    by them. Null where there is no value, which a filter takes for false.
    """
    value = col(name)
    kept = is_present(value, data_type)
    if low is not None:
        kept = kept & (value >= low)
    if high is not None:
        kept = kept & (value <= high)
    return kept


def keep_within(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Keep rows whose columns all hold a value in their range."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for name, (low, high) in ranges.items():
        df = df.filter(within(name, types[name], low, high))
    return df
