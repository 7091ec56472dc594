"""Test tables, dirty versions of them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import inject
from tablewright.sources.storage import materialise

ORDER_ID = ["o_orderkey"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with missing values, outliers, a heavy key, noisy and missing labels, copies."""
    df = table(spark, folder, "orders")
    df = inject.missing_values(df, "o_totalprice", 0.05, 10, ORDER_ID)
    df = inject.constant_outliers(df, "o_totalprice", 9999999.0, 0.03, 20, ORDER_ID)
    df = inject.missing_values(df, "o_orderpriority", 0.05, 11, ORDER_ID)
    df = inject.heavy_key(df, "o_custkey", 1, 0.30, 30, ORDER_ID)
    df = inject.flipped_labels(df, "o_orderstatus", "F", "O", 0.05, 40, ORDER_ID)
    df = inject.missing_labels(df, "o_orderstatus", 0.02, 50, ORDER_ID)
    return inject.duplicate_rows(df, 0.02, 60, ORDER_ID)


def stored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The dirty orders as a table on disk, for queries that scan them often."""
    return materialise(dirty_orders(spark, folder), "dirty").df


def drifted_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty orders whose price became text and which lost and gained a column."""
    df = inject.drifted_schema(
        dirty_orders(spark, folder), {"o_totalprice": "string"}, {"source_system": "v2"}
    )
    return df.drop("o_orderdate")


def events_with_nan(spark: SparkSession, folder: str) -> DataFrame:
    return inject.replace_where(
        table(spark, folder, "events"), "value", F.lit(float("nan")), 0.03, 70, ["event_id"]
    )


# --- the same in SQL -------------------------------------------------------


def u(seed: int, key: str = "o_orderkey") -> str:
    """The uniform draw of a row."""
    digits = f"substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)"
    return f"(CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE)"


DIRTY = f"""
once AS (
  SELECT o_orderkey,
         CASE WHEN {u(30)} < 0.30 THEN 1 ELSE o_custkey END AS o_custkey,
         CASE WHEN {u(50)} < 0.02 THEN NULL
              WHEN {u(40)} < 0.05 THEN CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'F' END
              ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN {u(20)} < 0.03 THEN 9999999.0::DOUBLE
              WHEN {u(10)} < 0.05 THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN {u(11)} < 0.05 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders),
dirty AS (
  SELECT * FROM once UNION ALL SELECT * FROM once WHERE {u(60)} < 0.02)
"""
ORDER_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
)
ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


def with_dirty(body: str, *more: str) -> str:
    return "WITH " + ", ".join([DIRTY, *more]) + " " + body


def fence(name: str, source: str, column: str) -> str:
    """CTE ``name`` with the discrete quartiles of a column and its bounds."""
    return f"""
{name}_q AS (
  SELECT CAST(quantile_disc({column}, 0.25) AS DOUBLE) AS q1,
         CAST(quantile_disc({column}, 0.75) AS DOUBLE) AS q3 FROM {source}),
{name} AS (
  SELECT q1, q3, q3 - q1 AS iqr,
         CASE WHEN q3 <> q1 THEN q1 - 1.5::DOUBLE * (q3 - q1) END AS lower_bound,
         CASE WHEN q3 <> q1 THEN q3 + 1.5::DOUBLE * (q3 - q1) END AS upper_bound FROM {name}_q)"""


def beyond(column: str, fence_name: str) -> str:
    """Condition for a value to be counted as an outlier."""
    bounds = {b: f"(SELECT {b} FROM {fence_name})" for b in ("q1", "iqr", "lower_bound", "upper_bound")}
    return (
        f"(CASE WHEN {bounds['iqr']} = 0 THEN {column} <> {bounds['q1']} "
        f"ELSE {column} < {bounds['lower_bound']} OR {column} > {bounds['upper_bound']} END)"
    )


def capped(column: str, fence_name: str) -> str:
    low, high = (f"(SELECT {b} FROM {fence_name})" for b in ("lower_bound", "upper_bound"))
    return f"CASE WHEN {column} < {low} THEN {low} WHEN {column} > {high} THEN {high} ELSE {column} END"


def grade(ladder: str, value: str) -> str:
    steps = {
        "missingness": "WHEN {v} = 0 THEN 'none' WHEN {v} < 0.10::DOUBLE THEN 'low' WHEN {v} <= 0.40::DOUBLE THEN 'medium'",
        "duplicates": "WHEN {v} = 0 THEN 'none' WHEN {v} <= 0.02::DOUBLE THEN 'low' WHEN {v} <= 0.15::DOUBLE THEN 'medium'",
        "outliers": "WHEN {v} = 0 THEN 'none' WHEN {v} < 0.05::DOUBLE THEN 'low'",
        "skew": "WHEN {v} IS NULL THEN 'unknown' WHEN {v} <= 5 THEN 'low' WHEN {v} <= 10 THEN 'medium'",
    }[ladder]
    return f"CASE {steps.format(v=value)} ELSE 'high' END"


def div(part: str, whole: str) -> str:
    return f"(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE))"


def n(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"
