"""Replacement values for missing cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quantiles
from ..functions.columns import SETS_AT_ONCE, col, present


def medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, float | int | Decimal]:
    """Medians of many columns; columns without values are left out.

    The median is a value of its column, also where doubles cannot tell its
    neighbours apart: integers beyond 2^53 and long decimals.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    values = {c: present(col(c), types[c]).cast("double") for c in columns}
    found = (quantiles.exact if exact else quantiles.approximate)(df, values, [0.5])
    middle = {c: q[0] for c, q in found.items() if q[0] is not None}
    if exact:
        middle |= {c: _own_median(df, c, types[c], m) for c, m in middle.items() if _is_finer(types[c], m)}
    return middle


def _is_finer(data_type: T.DataType, near: float) -> bool:
    """Whether the type may hold several values that are one double near a number."""
    if isinstance(data_type, T.DecimalType):
        return data_type.precision > 15
    return isinstance(data_type, T.LongType) and abs(near) >= 2**53


def _own_median(df: DataFrame, column: str, data_type: T.DataType, near: float) -> int | Decimal:
    """The median in the column's own type, among the values whose double is ``near``.

    Its rank among them is known by counting the values below. Their distances
    from an anchor are small, and so are doubles again; what is still one double
    after that is told apart in the same way.
    """
    scale = data_type.scale if isinstance(data_type, T.DecimalType) else 0
    wide = T.DecimalType(38, scale)
    value = col(column).cast(wide)
    with localcontext(prec=60):
        counts = df.agg(F.count(col(column)).alias("n"), F.count_if(col(column).cast("double") < near).alias("below")).first()
        rank = (counts["n"] + 1) // 2 - counts["below"]
        ties = df.filter(col(column).cast("double") == near).select(value.alias("v"))
        step = Decimal(1).scaleb(-scale)
        anchor = Decimal(near).quantize(step)
        while True:
            limit = Decimal(10**38 - 1).scaleb(-scale)
            rest = (F.col("v") - F.lit(max(-limit, min(limit, anchor))).cast(wide)).cast(wide)
            size = ties.count()
            [gap] = quantiles.exact(ties, {"gap": rest.cast("double")}, [(rank - 0.5) / size])["gap"]
            same = ties.filter(rest.cast("double") == gap)
            span = same.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
            if span["low"] == span["high"]:
                return int(span["low"]) if scale == 0 and not isinstance(data_type, T.DecimalType) else span["low"]
            rank -= ties.filter(rest.cast("double") < gap).count()
            ties, anchor = same, anchor + Decimal(gap).quantize(step)


def means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | Decimal]:
    types = {f.name: f.dataType for f in df.schema.fields}
    found = {}
    for part in quantiles.in_parts({c: F.avg(present(col(c), types[c])) for c in columns}):
        row = df.agg(*[mean.alias(f"m{i}") for i, mean in enumerate(part.values())]).first()
        found |= {c: row[f"m{i}"] for i, c in enumerate(part) if row[f"m{i}"] is not None}
    return found


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most frequent value of each column, the smallest one among equals.

    Sixteen columns at a time are counted in one shuffle by GROUPING SETS, which
    copy each row once a column. Nothing holds all distinct values of a column in
    one place, unlike the ``mode`` aggregate.
    """
    columns = list(dict.fromkeys(columns))
    parts = [columns[i : i + SETS_AT_ONCE] for i in range(0, len(columns), SETS_AT_ONCE)]
    return {c: mode for part in parts for c, mode in _modes(df, part).items()}


def _modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    types = {f.name: f.dataType for f in df.schema.fields}
    named = df.select(*[present(col(c), types[c]).alias(f"k{i}") for i, c in enumerate(columns)])
    keys = [F.col(f"k{i}") for i in range(len(columns))]
    if len(columns) == 1:
        counted, marks = named.groupBy(*keys).agg(F.lit(0).alias("mark"), F.count(F.lit(1)).alias("n")), [0]
    else:
        counted = named.groupingSets([[k] for k in keys], *keys).agg(
            F.grouping_id().alias("mark"), F.count(F.lit(1)).alias("n")
        )
        everything = (1 << len(columns)) - 1
        marks = [everything - (1 << (len(columns) - 1 - i)) for i in range(len(columns))]
    best = counted.agg(
        *[
            F.min(
                F.when((F.col("mark") == mark) & k.isNotNull(), F.struct((-F.col("n")).alias("n"), k.alias("v")))
            ).alias(f"b{i}")
            for i, (mark, k) in enumerate(zip(marks, keys))
        ]
    ).first()
    return {c: best[f"b{i}"]["v"] for i, c in enumerate(columns) if best[f"b{i}"] is not None}


def filled(value: Column, data_type: T.DataType, replacement: object) -> Column:
    """The value, or the replacement in the column's own type where it is missing."""
    return F.coalesce(present(value, data_type), typed(replacement, data_type))


def typed(replacement: object, data_type: T.DataType) -> Column:
    return F.lit(replacement).try_cast(data_type)


def fill(df: DataFrame, replacements: Mapping[str, object]) -> DataFrame:
    """Fill missing cells of several columns in one projection."""
    return df.select(
        *[
            filled(col(f.name), f.dataType, replacements[f.name]).alias(f.name)
            if f.name in replacements
            else col(f.name)
            for f in df.schema.fields
        ]
    )
