"""Questions over logged runs: the latest one, two compared, all side by side.

A run log has one row per metric: ``run_id, run_name, created_at, artifact,
path, value, text``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which logged metrics make up each comparison and summary table.
QUALITY_METRICS = {
    "missingness_raw": "evaluation.missingness.raw_total",
    "missingness_cleaned": "evaluation.missingness.cleaned_total",
    "missingness_reduction": "evaluation.missingness.reduction",
    "duplicates_raw": "evaluation.duplicates.raw",
    "duplicates_cleaned": "evaluation.duplicates.cleaned",
    "duplicates_reduction": "evaluation.duplicates.reduction",
    "outliers_raw": "evaluation.outliers.raw_total",
    "outliers_cleaned": "evaluation.outliers.cleaned_total",
    "outliers_reduction": "evaluation.outliers.reduction",
    "schema_raw_issue_count": "evaluation.schema_drift.raw_issue_count",
    "schema_cleaned_issue_count": "evaluation.schema_drift.cleaned_issue_count",
}
#: Besides the figures that two runs are compared by, for the table of all runs.
SHAPE_METRICS = {
    "row_count_raw": "evaluation.row_count.raw",
    "row_count_cleaned": "evaluation.row_count.cleaned",
    "skew_columns_reduced": "summary.skew_columns_reduced",
    "schema_drift_detected": "raw_profile.schema_drift.drift_detected",
}
CLASSIFICATION_METRICS = {
    f"{m}_{side}": f"ml_metrics.{place}.{m}"
    for m in ("accuracy", "f1", "auc")
    for side, place in (("raw", "raw_metrics"), ("cleaned", "cleaned_metrics"), ("delta", "delta"))
} | {"ml_row_count_delta": "ml_metrics.delta.ml_row_count"}
REGRESSION_METRICS = {
    f"{m}_{side}": f"ml_metrics.{place}.{m}"
    for m in ("rmse", "mae", "r2")
    for side, place in (("raw", "raw_metrics"), ("cleaned", "cleaned_metrics"), ("delta", "delta"))
} | {"ml_row_count_delta": "ml_metrics.delta.ml_row_count"}
EFFORT_METRICS = {
    "cycle_seconds": "opex_metrics.total_time_seconds",
    "seconds_per_1000_rows": "opex_metrics.seconds_per_1000_input_rows",
    "repair_seconds": "opex_metrics.repair_time_seconds",
    "repair_actions": "opex_metrics.repair_action_count",
    "code_lines_reduced": (
        "report.process_efficiency_metrics."
        "reduction_in_dataset_specific_cleaning_code.estimated_lines_reduced"
    ),
    "manual_baseline_steps": (
        "report.process_efficiency_metrics."
        "reduction_in_manual_cleaning_steps.baseline_steps"
    ),
    "seconds_saved": (
        "report.process_efficiency_metrics."
        "time_saved_per_cleaning_cycle.estimated_seconds_saved"
    ),
}
DETECTION_METRICS = {
    "missingness_accuracy": "metadata.detection_accuracy.missingness.mean_accuracy",
    "outlier_accuracy": "metadata.detection_accuracy.outliers.accuracy",
    "duplicate_accuracy": "metadata.detection_accuracy.duplicates.accuracy",
    "label_noise_accuracy": "metadata.detection_accuracy.label_noise.accuracy",
    "mean_accuracy": "metadata.detection_accuracy.mean_accuracy",
}
def _stability(metrics: Sequence[str]) -> dict[str, str]:
    return {
        f"{m}_{part}_{side}": f"ml_metrics.{side}_metrics.fold_stability.summary.{m}.{part}"
        for m in metrics for part in ("mean", "stddev") for side in ("raw", "cleaned")
    }


SUMMARY_TABLES = {
    "data_quality": QUALITY_METRICS | SHAPE_METRICS,
    "classification": CLASSIFICATION_METRICS | _stability(("accuracy", "f1", "auc")),
    "regression": REGRESSION_METRICS | _stability(("rmse", "mae", "r2")),
    "detection": DETECTION_METRICS,
    "effort": EFFORT_METRICS,
}


def latest_runs(runs: DataFrame, name: str = "run_name", time: str = "created_at", run: str = "run_id") -> DataFrame:
    """The newest run of each name, the largest id among equals.

    A max over (time, id), which combines before the shuffle: one very busy name
    costs no more than a quiet one.
    """
    newest = F.max(F.struct(F.col(time).alias("t"), F.col(run).alias("r"))).alias("newest")
    return runs.groupBy(name).agg(newest).select(
        name, F.col("newest.t").alias(time), F.col("newest.r").alias(run)
    )


def latest_run_like(runs: DataFrame, suffix: str) -> DataFrame:
    """The newest run whose name ends with the suffix."""
    matching = runs.filter(F.col("run_name").endswith(suffix)).withColumn("suffix", F.lit(suffix))
    return latest_runs(matching, name="suffix")


def compare_runs(
    metrics: DataFrame, first: str, second: str, run: str = "run_id", metric: str = "metric", value: str = "value"
) -> DataFrame:
    """Per metric: its value in two runs, the difference, and whether they agree."""
    sides = metrics.groupBy(metric).agg(
        F.max(F.when(F.col(run) == first, F.col(value))).alias("first_value"),
        F.max(F.when(F.col(run) == second, F.col(value))).alias("second_value"),
        F.count_if(F.col(run).isin(first, second)).alias("present"),
    )
    return sides.filter(F.col("present") > 0).select(
        metric,
        "first_value",
        "second_value",
        (F.col("second_value") - F.col("first_value")).alias("difference"),
        F.col("first_value").eqNullSafe(F.col("second_value")).alias("same"),
    )


#: The question of each verdict, and the metrics that answer it.
OUTCOMES = {"quality": QUALITY_METRICS, "classification": CLASSIFICATION_METRICS, "regression": REGRESSION_METRICS}


def _own_metrics(outcome: str) -> set[str]:
    """Metrics that only this kind of result has; those of several kinds do not tell which kind was logged."""
    others = {m for o, metrics in OUTCOMES.items() if o != outcome for m in metrics}
    return OUTCOMES[outcome].keys() - others


def same_outcome(metrics: Iterable[str]) -> Column:
    """Over the rows of a comparison: whether all of these metrics agree; null if none was logged."""
    return F.bool_and(F.when(F.col("metric").isin(*metrics), F.col("same")))


def outcome_verdicts(comparison: DataFrame) -> DataFrame:
    """outcome, same, metrics: whether two runs came to the same result, by kind of result.

    A kind without a metric of its own was not logged: null, and no metrics.
    """
    counted = comparison.agg(
        *[same_outcome(m).alias(f"same_{o}") for o, m in OUTCOMES.items()],
        *[F.count_if(F.col("metric").isin(*m)).alias(f"n_{o}") for o, m in OUTCOMES.items()],
        *[F.count_if(F.col("metric").isin(*_own_metrics(o))).alias(f"own_{o}") for o in OUTCOMES],
    )
    logged = lambda o, value: F.when(F.col(f"own_{o}") > 0, value)
    verdicts = [
        F.struct(
            F.lit(o).alias("outcome"),
            logged(o, F.col(f"same_{o}")).alias("same"),
            F.coalesce(logged(o, F.col(f"n_{o}")), F.lit(0)).alias("metrics"),
        )
        for o in OUTCOMES
    ]
    return counted.select(F.inline(F.array(*verdicts)))


def pivot_runs(
    metrics: DataFrame, names: Sequence[str], run: str = "run_id", metric: str = "metric", value: str = "value"
) -> DataFrame:
    """One row per run, one column per named metric.

    The names are given, so the pivot needs no extra pass to find them and is a
    single aggregate with one conditional max per metric.
    """
    return metrics.groupBy(run).agg(
        *[F.max(F.when(F.col(metric) == n, F.col(value))).alias(n) for n in names]
    )


def named_metrics(log: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    """Log rows of the wanted paths, under their short names."""
    names = F.create_map(*[F.lit(x) for name, path in paths.items() for x in (path, name)])
    full = F.concat_ws(".", "artifact", "path")
    return (
        log.withColumn("metric", F.try_element_at(names, full))
        .filter(F.col("metric").isNotNull())
        .select("run_id", "run_name", "created_at", "metric", "value")
    )


def summary(log: DataFrame, table: str) -> DataFrame:
    """One of the side-by-side tables of all runs; see ``SUMMARY_TABLES``."""
    paths = SUMMARY_TABLES[table]
    return pivot_runs(named_metrics(log, paths), list(paths))
