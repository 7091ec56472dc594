"""Logged runs with models: verdicts, summary tables and reports whose every score has an exact value.

Least squares is exact, and a logistic fit on one text column predicts each
group's majority, so SQL knows what a log must hold. The numbers to clean are the
quantities of ``lineitem`` of which one in twenty is replaced by 1000.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright import (
    CleaningCycle, EvaluationReportBuilder, ExperimentLogger, RepairPolicy, SparkMLClassificationEvaluator, SparkMLRegressionEvaluator,
)
from tablewright.operators import inject
from tablewright.plans.models import compare_conditions
from tablewright.plans.verify import compute_detection_accuracy
from tablewright.sources.storage import materialise, shared_folder

from .tables import beyond, capped, fence, table, u

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


_IDS = ["l_orderkey", "l_linenumber", "l_partkey"]
_KEY = " || ':' || ".join(_IDS)
_RATE, _SEED, _WRONG = 0.05, 42, 1000.0
_Y, _X = "l_extendedprice", "l_quantity"
_KEPT = RepairPolicy(outlier_strategy="none")
_BASELINE = (5, 60, 30.0)  # steps, lines and seconds that the same work takes by hand


# --- regression --------------------------------------------------------------


def _damaged(spark, folder):
    lines = table(spark, folder, "lineitem").select(*_IDS, _X, _Y)
    return materialise(inject.constant_outliers(lines, _X, _WRONG, _RATE, ids=_IDS), "lines").df


def _cycle(df: DataFrame, label: str, policy: RepairPolicy | None = None, raw_profile: Mapping | None = None):
    return CleaningCycle(repair_policy=policy or RepairPolicy()).run(df, label_col=label, raw_profile=raw_profile)


def _log_regressions(log: ExperimentLogger, df: DataFrame, policies: Mapping[str, RepairPolicy | None]) -> list[str]:
    """A run for each policy: a cycle, a line fitted on both sides of it, what it found of the damage, and a report.

    All are over one stored table, whose profile and scores are those of the first run.
    """
    logged, raw, scores = [], None, None
    for name, policy in policies.items():
        with _cycle(df, _Y, policy, raw) as result:
            evaluator = SparkMLRegressionEvaluator(seed=_SEED, validation_folds=2, id_columns=_IDS)
            models = evaluator.evaluate_linear_regression(df, result.cleaned_df, _Y, [_X], [], scores)
            raw, scores = result.raw_profile, models.raw_metrics
            report = EvaluationReportBuilder().build(result, models, *_BASELINE)
            found = compute_detection_accuracy({"outliers": {"column": _X, "rate": _RATE}}, raw)
            logged.append(log.log_run(name, result, result.repair_policy, {"detection_accuracy": found}, models, report))
    return logged


def _new_log(spark) -> ExperimentLogger:
    return ExperimentLogger(f"{shared_folder(spark)}/runs-{uuid4().hex}", spark)


def _summary_rows(log: ExperimentLogger, name: str) -> DataFrame:
    """A summary table in long form: run_name, summary, metric, value, without what was not logged."""
    names = log.read().select("run_id", "run_name").distinct()
    wide = log.summary(name).join(names, "run_id")
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in wide.columns if m not in ("run_id", "run_name")]
    return wide.select("run_name", F.lit(name).alias("summary"), F.inline(F.array(*cells))).filter("value IS NOT NULL")


def _trains(seed: int) -> str:
    return f"{u(seed, _KEY)} < 0.8"


_DAMAGED = f"""damaged AS (SELECT {', '.join(_IDS)}, {_Y} AS y,
    CASE WHEN {u(20, _KEY)} < {_RATE} THEN {_WRONG}::DOUBLE ELSE {_X} END AS x FROM lineitem)"""
_CLEANED = f"""cleaned AS (SELECT DISTINCT {', '.join(_IDS)}, y, {capped('x', 'f')} AS x FROM damaged),
    kept AS (SELECT DISTINCT * FROM damaged), manual AS (SELECT * FROM damaged WHERE x < {_WRONG})"""
_LINES = f"WITH {_DAMAGED}, {fence('f', 'damaged', 'x')}, {_CLEANED}"


def _errors(source: str, seed: int) -> str:
    fit = f"(SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {source} WHERE {_trains(seed)})"
    return f"(SELECT y, y - (m.a + m.b * x) AS e FROM {source}, {fit} m WHERE NOT {_trains(seed)})"


def _line_scores(name: str, source: str, seed: int = _SEED) -> str:
    return f"{name} AS (SELECT sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y) AS r2 FROM {_errors(source, seed)})"


_PLACES = {"rmse": 2, "mae": 2, "r2": 3}
_SOURCES = ("damaged", "cleaned", "kept", "manual")
_SCORED = ", ".join(_line_scores(f"s_{s}", s) for s in _SOURCES)
_FOLDS = ", ".join(_line_scores(f"s_{s}_{k}", s, _SEED + k) for s in _SOURCES[:3] for k in (1, 2))
_SPREADS = ", ".join(
    f"t_{s} AS (SELECT " + ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_stddev" for m in _PLACES)
    + f" FROM (SELECT * FROM s_{s}_1 UNION ALL SELECT * FROM s_{s}_2))" for s in _SOURCES[:3]
)
#: Actions of a repair: one for outliers if it caps them, one for copies if there are any or capping may have made some.
_COPIES = "(SELECT count(*) FROM damaged) > (SELECT count(*) FROM kept)"
_OUTLIERS = f"(SELECT count(*) FROM damaged WHERE {beyond('x', 'f')})"
_ACTIONS = {"cleaned": f"CAST({_OUTLIERS} > 0 AS INTEGER) + CAST({_OUTLIERS} > 0 OR {_COPIES} AS INTEGER)", "kept": f"CAST({_COPIES} AS INTEGER)"}
_POLICY_LINES = {"cleaned": 5, "kept": 6}
_FOUND = f"greatest(0, 1 - abs({_OUTLIERS} / (SELECT count(*) FROM damaged) - {_RATE}::DOUBLE) / {_RATE}::DOUBLE) * 100"
_RUNS = {"lines_auto": "cleaned", "lines_kept": "kept"}
_ROWS = "(SELECT count(*) FROM {s} WHERE x IS NOT NULL AND y IS NOT NULL)"


def _places(metric: str) -> int:
    return next((p for m, p in _PLACES.items() if metric.startswith(m + "_")), 3)


def _summary_values(source: str) -> dict[tuple[str, str], str]:
    """What the three tables must hold of a run, by table and metric."""
    values = {}
    for m in _PLACES:
        raw, cleaned = f"(SELECT {m} FROM s_damaged)", f"(SELECT {m} FROM s_{source})"
        values |= {("regression", f"{m}_raw"): raw, ("regression", f"{m}_cleaned"): cleaned, ("regression", f"{m}_delta"): f"{cleaned} - {raw}"}
        for part in ("mean", "stddev"):
            for side, s in (("raw", "damaged"), ("cleaned", source)):
                values["regression", f"{m}_{part}_{side}"] = f"(SELECT {m}_{part} FROM t_{s})"
    values["regression", "ml_row_count_delta"] = f"{_ROWS.format(s=source)} - {_ROWS.format(s='damaged')}"
    values |= {("detection", "outlier_accuracy"): f"round({_FOUND}, 1)", ("detection", "mean_accuracy"): f"round({_FOUND}, 1)"}
    return values | {
        ("effort", "repair_actions"): _ACTIONS[source],
        ("effort", "manual_baseline_steps"): str(_BASELINE[0]),
        ("effort", "code_lines_reduced"): str(_BASELINE[1] - _POLICY_LINES[source]),
        ("effort", "seconds_saved_and_spent"): str(_BASELINE[2]),
    }


def _rounded(value, metric) -> F.Column:
    by_places = [F.when(metric.startswith(m + "_"), F.round(value, p)) for m, p in _PLACES.items()]
    return F.coalesce(*by_places, F.round(value, 3))


@query(
    f"{_LINES}, {_SCORED}, {_FOLDS}, {_SPREADS} "
    + " UNION ALL ".join(
        f"SELECT '{run}' AS run_name, '{t}' AS summary, '{m}' AS metric, round(CAST({sql} AS DOUBLE), {_places(m)}) AS value"
        for run, source in _RUNS.items() for (t, m), sql in _summary_values(source).items()
    )
)
def logged_model_summaries(spark, folder):
    """The regression, detection and effort tables of a log with a run that caps outliers and one that keeps them."""
    log, damaged = _new_log(spark), _damaged(spark, folder)
    _log_regressions(log, damaged, {"lines_auto": None, "lines_kept": _KEPT})
    rows = reduce(DataFrame.unionByName, [_summary_rows(log, t) for t in ("regression", "detection", "effort")])
    seconds = F.col("metric").isin("seconds_saved", "cycle_seconds")
    balance = rows.filter(seconds).groupBy("run_name", "summary").agg(F.sum("value").alias("value"))
    balance = balance.withColumn("metric", F.lit("seconds_saved_and_spent"))
    rows = rows.filter(~seconds & ~F.col("metric").isin("seconds_per_1000_rows", "repair_seconds")).unionByName(balance)
    return rows.withColumn("value", _rounded(F.col("value"), F.col("metric")))


_SAME_SCORES = " AND ".join(f"(SELECT round({m}, 4) FROM s_cleaned) = (SELECT round({m}, 4) FROM s_kept)" for m in _PLACES)
_LEFT = f"(SELECT count(*) FROM cleaned WHERE {beyond('x', 'h')}) = (SELECT count(*) FROM kept WHERE {beyond('x', 'k')})"


@query(
    f"""{_LINES}, {fence('h', 'cleaned', 'x')}, {fence('k', 'kept', 'x')}, {_SCORED}
        SELECT 'lines_kept' AS against, 'quality' AS outcome, {_LEFT} AND (SELECT count(*) FROM cleaned) = (SELECT count(*) FROM kept) AS same
        UNION ALL SELECT 'lines_kept', 'regression', {_SAME_SCORES} UNION ALL SELECT 'lines_kept', 'classification', NULL
        UNION ALL SELECT 'lines_again', 'quality', true UNION ALL SELECT 'lines_again', 'regression', true
        UNION ALL SELECT 'lines_again', 'classification', NULL"""
)
def logged_model_verdicts(spark, folder):
    """A run against one by another policy and against its own repetition: the same quality, the same models?"""
    log, damaged = _new_log(spark), _damaged(spark, folder)
    first, *others = _log_regressions(log, damaged, {"lines_auto": None, "lines_kept": _KEPT, "lines_again": None})
    named = zip(("lines_kept", "lines_again"), others)
    found = [log.verdicts(first, run).select(F.lit(name).alias("against"), "outcome", "same") for name, run in named]
    return reduce(DataFrame.unionByName, found)


def _report_values() -> dict[tuple[str, str], str]:
    actions = _ACTIONS["cleaned"]
    steps, code = "reduction_in_manual_cleaning_steps", "reduction_in_dataset_specific_cleaning_code"
    values = {
        ("ml_metrics", f"{m}.{side}"): sql
        for m in _PLACES for side, sql in (
            ("raw", f"(SELECT {m} FROM s_damaged)"), ("cleaned", f"(SELECT {m} FROM s_cleaned)"),
            ("delta", f"(SELECT {m} FROM s_cleaned) - (SELECT {m} FROM s_damaged)"))
    }
    return values | {
        ("process_efficiency_metrics", f"{steps}.baseline_steps"): str(_BASELINE[0]),
        ("process_efficiency_metrics", f"{steps}.automated_repair_actions"): actions,
        ("process_efficiency_metrics", f"{steps}.remaining_manual_steps_estimate"): f"greatest({_BASELINE[0]} - ({actions}), 0)",
        ("process_efficiency_metrics", f"{steps}.estimated_steps_avoided"): actions,
        ("process_efficiency_metrics", f"{code}.baseline_lines"): str(_BASELINE[1]),
        ("process_efficiency_metrics", f"{code}.policy_lines_estimate"): str(_POLICY_LINES["cleaned"]),
        ("process_efficiency_metrics", f"{code}.estimated_lines_reduced"): str(_BASELINE[1] - _POLICY_LINES["cleaned"]),
        ("process_efficiency_metrics", "time_saved_per_cleaning_cycle.manual_baseline_seconds"): str(_BASELINE[2]),
    }


@query(
    f"{_LINES}, {_SCORED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS category, '{m}' AS metric, round(CAST({sql} AS DOUBLE), {_PLACES.get(m.partition('.')[0], 3)}) AS value"
        for (c, m), sql in _report_values().items()
    )
)
def grouped_report_models(spark, folder):
    """The model and process sections of a report, with what the same work takes by hand."""
    damaged = _damaged(spark, folder)
    with _cycle(damaged, _Y) as result:
        evaluator = SparkMLRegressionEvaluator(seed=_SEED, id_columns=_IDS)
        models = evaluator.evaluate_linear_regression(damaged, result.cleaned_df, _Y, [_X], [])
        report = EvaluationReportBuilder().build(result, models, *_BASELINE).to_frame(spark)
    wanted = [(F.col("category") == c) & (F.col("metric") == m) for c, m in _report_values()]
    places = [F.when(F.col("metric").startswith(m + "."), F.round("value", p)) for m, p in _PLACES.items()]
    return report.filter(reduce(lambda a, b: a | b, wanted)).withColumn("value", F.coalesce(*places, F.round("value", 3)))


_CONDITIONS = {"raw": "damaged", "detection_only": "damaged", "policy": "cleaned", "manual": "manual"}


@query(
    f"{_LINES}, {_SCORED} " + " UNION ALL ".join(
        f"SELECT '{name}' AS condition, (SELECT count(*) FROM {s}) AS ml_row_count, "
        + ", ".join(
            f"(SELECT round({m}, {p}) FROM s_{s}) AS {m}, round((SELECT {m} FROM s_{s}) - (SELECT {m} FROM s_damaged), {p}) AS {m}_delta"
            for m, p in _PLACES.items())
        for name, s in _CONDITIONS.items()
    )
)
def four_conditions_regression(spark, folder):
    """Raw, detection only, policy and by hand, with the scores of a line and their distance from those of the raw table."""
    damaged = _damaged(spark, folder)
    with _cycle(damaged, _Y) as result:
        conditions = {
            "raw": damaged, "detection_only": damaged, "policy": result.cleaned_df, "manual": damaged.filter(F.col(_X) < _WRONG)}
        found = compare_conditions(SparkMLRegressionEvaluator(seed=_SEED, id_columns=_IDS), conditions, _Y, [_X], [])
    return found.withColumns({c: F.round(c, p) for m, p in _PLACES.items() for c in (m, f"{m}_delta")})


# --- classification ----------------------------------------------------------

_SIZE = f"CASE WHEN {_X} > CASE WHEN l_returnflag IN ('A', 'R') THEN 5 ELSE 35 END THEN 'large' ELSE 'small' END"
_GAPS = 0.2
_FLAGS = f"""WITH raw AS (SELECT {', '.join(_IDS)}, {_SIZE} AS size, CASE WHEN {u(10, _KEY)} < {_GAPS} THEN NULL ELSE l_returnflag END AS flag
      FROM lineitem),
    cleaned AS (SELECT DISTINCT {', '.join(_IDS)}, size, coalesce(flag, 'unknown') AS flag FROM raw),
    complete AS (SELECT * FROM raw WHERE flag IS NOT NULL)"""


def _class_scores(name: str, source: str) -> str:
    """Each group's majority in the training rows is the prediction; its share there is the score that ranks."""
    return f"""{name}_shares AS (SELECT flag, avg(CAST(size = 'large' AS INTEGER)) AS p FROM {source} WHERE {_trains(_SEED)} GROUP BY flag),
    {name}_test AS (SELECT size, CASE WHEN p > 0.5 THEN 'large' ELSE 'small' END AS guess, p
                    FROM {source} JOIN {name}_shares USING (flag) WHERE NOT {_trains(_SEED)}),
    {name}_classes AS (SELECT c, count(*) FILTER (WHERE size = c) AS a, count(*) FILTER (WHERE guess = c) AS g,
                       count(*) FILTER (WHERE size = c AND guess = c) AS t FROM {name}_test, (VALUES ('large'), ('small')) v(c) GROUP BY c),
    {name}_ranks AS (SELECT p, count(*) FILTER (WHERE size = 'large') AS pos, count(*) FILTER (WHERE size = 'small') AS neg
                     FROM {name}_test GROUP BY p),
    {name}_below AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
                     FROM {name}_ranks),
    {name} AS (SELECT (SELECT sum(t) / sum(a) FROM {name}_classes) AS accuracy,
      (SELECT sum(a * (2 * t / (a + g))) / sum(a) FROM {name}_classes) AS f1,
      (SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) FROM {name}_below) AS auc)"""


_CLASS_VALUES = {
    f"{m}_{side}": sql
    for m in ("accuracy", "f1", "auc")
    for side, sql in (("raw", f"(SELECT {m} FROM c_raw)"), ("cleaned", f"(SELECT {m} FROM c_clean)"),
                      ("delta", f"(SELECT {m} FROM c_clean) - (SELECT {m} FROM c_raw)"))
} | {"ml_row_count_delta": "(SELECT count(*) FROM cleaned) - (SELECT count(*) FROM complete)"}


@query(
    f"{_FLAGS}, {_class_scores('c_raw', 'complete')}, {_class_scores('c_clean', 'cleaned')} " + " UNION ALL ".join(
        f"SELECT 'flags_auto' AS run_name, 'classification' AS summary, '{m}' AS metric, round(CAST({sql} AS DOUBLE), 3) AS value"
        for m, sql in _CLASS_VALUES.items())
)
def logged_classification(spark, folder):
    """The classification table of a run that fills gaps in a text column, the only feature of a logistic fit."""
    lines = table(spark, folder, "lineitem").select(*_IDS, "l_returnflag", F.expr(_SIZE).alias("size"))
    gaps = materialise(inject.missing_values(lines, "l_returnflag", _GAPS, 10, _IDS), "flags").df
    log = _new_log(spark)
    with _cycle(gaps, "size") as result:
        evaluator = SparkMLClassificationEvaluator(seed=_SEED, id_columns=_IDS, iterations=100, tolerance=1e-7)
        models = evaluator.evaluate_logistic_regression(gaps, result.cleaned_df, "size", [], ["l_returnflag"])
        log.log_run("flags_auto", result, ml_metrics=models)
    return _summary_rows(log, "classification").withColumn("value", F.round("value", 3))
