"""Missing values per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grades
from ..functions.columns import col, has_nan, ratio, rows_from_structs


def missing_tests(df: DataFrame) -> dict[str, Column]:
    """Conditions ``null_i`` and, for float columns, ``nan_i``, by column number."""
    tests = {}
    for i, f in enumerate(df.schema.fields):
        tests[f"null_{i}"] = col(f.name).isNull()
        if has_nan(f.dataType):
            tests[f"nan_{i}"] = F.isnan(col(f.name))
    return tests


def missingness(df: DataFrame) -> DataFrame:
    """One row per column: nulls, NaNs, their ratio to all rows, and the grade.

    All columns are counted in one scan without a shuffle of rows. An empty
    table has no missingness rows.
    """
    counts = [F.count_if(test).alias(name) for name, test in missing_tests(df).items()]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    entries = []
    for i, f in enumerate(df.schema.fields):
        nans = F.col(f"nan_{i}") if has_nan(f.dataType) else F.lit(0).cast("bigint")
        entries.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.col("rows").alias("row_count"),
                F.col(f"null_{i}").alias("null_count"),
                nans.alias("nan_count"),
                (F.col(f"null_{i}") + nans).alias("missing_count"),
            )
        )
    missing_ratio = ratio(F.col("missing_count"), F.col("row_count"))
    return (
        rows_from_structs(counted, entries)
        .filter(F.col("row_count") > 0)
        .withColumn("missing_ratio", missing_ratio)
        .withColumn("severity", grades.MISSINGNESS.column(F.col("missing_ratio")))
    )
