"""Before/after comparison of profile tables.

Profile tables have one row per column or key, so these joins are of small
tables whatever the size of the data they describe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio


def _paired(raw: DataFrame, cleaned: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    before = raw.select(key, F.lit(True).alias("in_raw"), *[F.col(v).alias(f"raw_{n}") for n, v in values.items()])
    after = cleaned.select(
        key, F.lit(True).alias("in_cleaned"), *[F.col(v).alias(f"cleaned_{n}") for n, v in values.items()]
    )
    return before.join(after, key, "full_outer")


def reduction(raw: Column, cleaned: Column) -> list[Column]:
    return [
        (raw - cleaned).alias("reduction"),
        ratio(raw - cleaned, raw).alias("reduction_ratio"),
    ]


def row_count_change(raw_rows: DataFrame, cleaned_rows: DataFrame) -> DataFrame:
    """From two one-row tables with ``row_count``: the change and its ratio."""
    raw, cleaned = F.col("raw"), F.col("cleaned")
    return (
        raw_rows.select(F.lit(1).alias("k"), F.col("row_count").alias("raw"))
        .join(cleaned_rows.select(F.lit(1).alias("k"), F.col("row_count").alias("cleaned")), "k")
        .select(raw, cleaned, (cleaned - raw).alias("change"), ratio(cleaned - raw, raw).alias("change_ratio"))
    )


def missingness_change(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Per column: missing before and after. ``scope`` tells shared columns from
    added and removed ones, whose missing cells stay out of the total."""
    pairs = _paired(raw, cleaned, "column", {"missing": "missing_count"})
    scope = (
        F.when(F.col("in_raw").isNull(), F.lit("added"))
        .when(F.col("in_cleaned").isNull(), F.lit("removed"))
        .otherwise(F.lit("shared"))
    )
    before, after = (F.coalesce(F.col(c), F.lit(0)) for c in ("raw_missing", "cleaned_missing"))
    return pairs.select(
        "column", scope.alias("scope"), before.alias("raw"), after.alias("cleaned"), *reduction(before, after)
    )


def missingness_total(change: DataFrame) -> DataFrame:
    return _total(change.filter(F.col("scope") == "shared"))


def outlier_change(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Per column of either side: outliers before and after, absent meaning none."""
    pairs = _paired(raw, cleaned, "column", {"outliers": "outlier_count"})
    before, after = (F.coalesce(F.col(c), F.lit(0)) for c in ("raw_outliers", "cleaned_outliers"))
    return pairs.select("column", before.alias("raw"), after.alias("cleaned"), *reduction(before, after))


def outlier_total(change: DataFrame) -> DataFrame:
    return _total(change)


def _total(change: DataFrame) -> DataFrame:
    sums = change.agg(
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_total"),
        F.coalesce(F.sum("cleaned"), F.lit(0)).alias("cleaned_total"),
    )
    return sums.select("*", *reduction(F.col("raw_total"), F.col("cleaned_total")))


def duplicate_change(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    before = raw.select(F.lit(1).alias("k"), F.col("duplicate_count").alias("raw"))
    after = cleaned.select(F.lit(1).alias("k"), F.col("duplicate_count").alias("cleaned"))
    return before.join(after, "k").select("raw", "cleaned", *reduction(F.col("raw"), F.col("cleaned")))


def skew_change(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Per key: skew ratio and grade before and after."""
    pairs = _paired(raw, cleaned, "key", {"skew_ratio": "skew_ratio", "severity": "severity"})
    return pairs.select(
        "key",
        "raw_skew_ratio",
        "cleaned_skew_ratio",
        (F.col("raw_skew_ratio") - F.col("cleaned_skew_ratio")).alias("reduction"),
        "raw_severity",
        "cleaned_severity",
    )


def skew_balance(change: DataFrame) -> DataFrame:
    """Average skew over keys known on both sides, and keys whose skew fell."""
    both = F.col("reduction").isNotNull()
    return change.agg(
        F.avg(F.when(both, F.col("raw_skew_ratio"))).alias("average_raw_skew_ratio"),
        F.avg(F.when(both, F.col("cleaned_skew_ratio"))).alias("average_cleaned_skew_ratio"),
        F.avg("reduction").alias("average_reduction"),
        F.count_if(F.coalesce(F.col("reduction"), F.lit(0.0)) > 0).alias("keys_reduced"),
    )


def schema_change(raw_drift: DataFrame, cleaned_drift: DataFrame) -> DataFrame:
    before = raw_drift.agg(F.count(F.lit(1)).alias("raw_issue_count")).withColumn("k", F.lit(1))
    after = cleaned_drift.agg(F.count(F.lit(1)).alias("cleaned_issue_count")).withColumn("k", F.lit(1))
    return before.join(after, "k").select(
        (F.col("raw_issue_count") > 0).alias("raw_drift_detected"),
        (F.col("cleaned_issue_count") > 0).alias("cleaned_drift_detected"),
        "raw_issue_count",
        "cleaned_issue_count",
    )


def actions_by_issue(actions: DataFrame) -> DataFrame:
    return actions.groupBy(F.coalesce(F.col("issue"), F.lit("unknown")).alias("issue")).agg(
        F.count(F.lit(1)).alias("actions")
    )
