"""Before/after comparison, whole cycles, the repair loop, and logged runs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tablewright import (
    CleaningCycle, DataProfiler, EvaluationReportBuilder, ExperimentLogger, PDSAConfig, PDSALoop,
    RepairEngine, RepairPolicy,
)
from tablewright.functions.columns import snapshot
from tablewright.operators import changes, completeness, duplicates, outliers, runs, schemas
from tablewright.plans.loop import compute_residuals, failed_issues
from tablewright.plans.repair import actions_frame
from tablewright.sources.storage import materialise, shared_folder

from .repairing import MEDIAN, mode_of
from .tables import (
    ORDER_COLUMNS, ORDER_NUMBERS, beyond, capped, dirty_orders, div, drifted_orders, fence,
    grade, n, stored_orders, table, with_dirty,
)

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


POLICY = RepairPolicy()
EXACT = DataProfiler()


def _cleaned(spark, folder):
    df = stored_orders(spark, folder)
    repaired = RepairEngine(POLICY).repair(df, EXACT.profile(df), label_col="o_orderstatus")
    return df, materialise(repaired.cleaned_df, "cleaned").df, repaired.actions


CLEAN = (
    fence("f", "dirty", "o_totalprice")
    + f""", cleaned AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus,
    {capped(f'coalesce(o_totalprice, {MEDIAN})', 'f')} AS o_totalprice, o_orderdate,
    coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM dirty)"""
)


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE {div(part, whole)} END"


def _reduced(raw: str, cleaned: str) -> str:
    return f"{raw} - {cleaned} AS reduction, {_share(f'({raw} - {cleaned})', raw)} AS reduction_ratio"


_MISSING_PAIRS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT count(*) - count({c}) FROM dirty) AS raw,
        (SELECT count(*) - count({c}) FROM cleaned) AS cleaned"""
    for c in ORDER_COLUMNS
)


@query(
    with_dirty(
        f"""SELECT "column", 'shared' AS scope, raw, cleaned, {_reduced('raw', 'cleaned')} FROM ({_MISSING_PAIRS})
            UNION ALL SELECT 'source_system', 'added', 0, 0, 0, 0.0""",
        CLEAN,
    )
)
def eval_missingness_change(spark, folder):
    raw, cleaned, _ = _cleaned(spark, folder)
    added = cleaned.withColumn("source_system", F.lit("v2"))
    return changes.missingness_change(completeness.missingness(raw), completeness.missingness(added))


@query(
    with_dirty(
        f"""SELECT {n('sum(raw)')} AS raw_total, {n('sum(cleaned)')} AS cleaned_total,
            {n('sum(raw) - sum(cleaned)')} AS reduction,
            {_share('(sum(raw) - sum(cleaned))', 'sum(raw)')} AS reduction_ratio FROM ({_MISSING_PAIRS})""",
        CLEAN,
    )
)
def eval_missingness_total(spark, folder):
    raw, cleaned, _ = _cleaned(spark, folder)
    return changes.missingness_total(
        changes.missingness_change(completeness.missingness(raw), completeness.missingness(cleaned))
    )


_CLEAN_FENCES = [fence(f"r_{c}", "dirty", c) for c in ORDER_NUMBERS] + [
    fence(f"c_{c}", "cleaned", c) for c in ORDER_NUMBERS
]
_OUTLIER_PAIRS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT count(*) FROM dirty WHERE {beyond(c, f'r_{c}')}) AS raw,
        (SELECT count(*) FROM cleaned WHERE {beyond(c, f'c_{c}')}) AS cleaned"""
    for c in ORDER_NUMBERS
)


@query(
    with_dirty(f'SELECT "column", raw, cleaned, {_reduced("raw", "cleaned")} FROM ({_OUTLIER_PAIRS})', CLEAN, *_CLEAN_FENCES)
)
def eval_outlier_change(spark, folder):
    raw, cleaned, _ = _cleaned(spark, folder)
    return changes.outlier_change(outliers.outliers(raw), outliers.outliers(cleaned))


KEYS = ["o_custkey", "o_orderpriority"]


def _skew(source: str, key: str) -> str:
    return (
        f"(SELECT {div('max(c)', 'quantile_disc(c, 0.5)')} FROM "
        f"(SELECT count(*) AS c FROM {source} GROUP BY {key}))"
    )


_SKEW_PAIRS = " UNION ALL ".join(
    f"SELECT '{k}' AS key, {_skew('dirty', k)} AS raw_skew_ratio, {_skew('cleaned', k)} AS cleaned_skew_ratio"
    for k in KEYS
)


@query(
    with_dirty(
        f"""SELECT *, raw_skew_ratio - cleaned_skew_ratio AS reduction,
            {grade('skew', 'raw_skew_ratio')} AS raw_severity,
            {grade('skew', 'cleaned_skew_ratio')} AS cleaned_severity FROM ({_SKEW_PAIRS})""",
        CLEAN,
    )
)
def eval_skew_change(spark, folder):
    raw, cleaned, _ = _cleaned(spark, folder)
    return changes.skew_change(duplicates.key_skew(raw, KEYS), duplicates.key_skew(cleaned, KEYS))


@query(
    with_dirty(
        f"""SELECT round(avg(raw_skew_ratio), 6) AS average_raw_skew_ratio,
            round(avg(cleaned_skew_ratio), 6) AS average_cleaned_skew_ratio,
            round(avg(raw_skew_ratio - cleaned_skew_ratio), 6) AS average_reduction,
            count(*) FILTER (WHERE raw_skew_ratio - cleaned_skew_ratio > 0) AS keys_reduced FROM ({_SKEW_PAIRS})""",
        CLEAN,
    )
)
def eval_skew_balance(spark, folder):
    raw, cleaned, _ = _cleaned(spark, folder)
    balance = changes.skew_balance(
        changes.skew_change(duplicates.key_skew(raw, KEYS), duplicates.key_skew(cleaned, KEYS))
    )
    averages = [c for c in balance.columns if c.startswith("average")]
    return balance.withColumns({c: F.round(c, 6) for c in averages})


_ROWS = "(SELECT count(*) AS raw FROM dirty), (SELECT count(*) AS cleaned FROM cleaned)"


@query(
    with_dirty(
        f"SELECT raw, cleaned, cleaned - raw AS change, {_share('(cleaned - raw)', 'raw')} AS change_ratio FROM {_ROWS}",
        CLEAN,
    )
)
def eval_row_change(spark, folder):
    raw, cleaned, _ = _cleaned(spark, folder)
    count = F.count(F.lit(1)).alias("row_count")
    return changes.row_count_change(raw.agg(count), cleaned.agg(count))


_RAW_COPIES = "(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS raw FROM dirty)"


@query(with_dirty(f"SELECT raw, CAST(0 AS BIGINT) AS cleaned, {_reduced('raw', '0')} FROM {_RAW_COPIES}"))
def eval_duplicate_change(spark, folder):
    raw, cleaned, _ = _cleaned(spark, folder)
    return changes.duplicate_change(duplicates.exact_duplicates(raw), duplicates.exact_duplicates(cleaned))


@query(
    """SELECT count(*) > 0 AS raw_drift_detected, false AS cleaned_drift_detected,
       CAST(3 AS BIGINT) AS raw_issue_count, CAST(0 AS BIGINT) AS cleaned_issue_count FROM orders"""
)
def eval_schema_change(spark, folder):
    reference = snapshot(table(spark, folder, "orders").schema)
    drifted = drifted_orders(spark, folder)
    aligned = schemas.align(drifted, reference, drop_added=True)
    return changes.schema_change(schemas.schema_drift(drifted, reference), schemas.schema_drift(aligned, reference))


@query(
    with_dirty(
        """SELECT 'missingness' AS issue,
             (SELECT CAST(count(*) > count(o_totalprice) AS BIGINT) + CAST(count(*) > count(o_orderpriority) AS BIGINT)
              FROM dirty) AS actions
           UNION ALL SELECT 'outliers', CAST(1 AS BIGINT) UNION ALL SELECT 'duplicates', CAST(1 AS BIGINT)"""
    )
)
def eval_actions_by_issue(spark, folder):
    _, _, actions = _cleaned(spark, folder)
    return changes.actions_by_issue(actions_frame(spark, actions))


def _residual_facts(source: str, prefix: str) -> str:
    cells = " + ".join(f"(count(*) - count({c}))" for c in ORDER_COLUMNS)
    found = " + ".join(f"count(*) FILTER (WHERE {beyond(c, f'{prefix}_{c}')})" for c in ORDER_NUMBERS)
    copies = f"(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})))"
    return f"""round({div(f'({cells})', f'(count(*) * {len(ORDER_COLUMNS)})')}, 6) AS missingness,
        round({div(f'({found})', 'count(*)')}, 6) AS outliers, round({div(copies, 'count(*)')}, 6) AS duplicates,
        round(greatest({', '.join(f"round({_skew(source, k)}, 4)" for k in KEYS)}), 6) AS skew FROM {source}"""


_RAW_FENCES = [fence(f"r_{c}", "dirty", c) for c in ORDER_NUMBERS]


@query(with_dirty(f"SELECT {_residual_facts('dirty', 'r')}", *_RAW_FENCES))
def residuals(spark, folder):
    left = compute_residuals(EXACT.profile(dirty_orders(spark, folder), KEYS))
    return spark.createDataFrame(
        [tuple(left.values())], "missingness double, outliers double, duplicates double, skew double"
    )


_LIMITS = {"missingness": 0.01, "outliers": 0.01, "duplicates": 0.0, "skew": 10.0}


@query(
    with_dirty(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{issue}' AS issue, {issue} AS residual, {limit}::DOUBLE AS threshold,
                {'true' if issue in ('outliers', 'skew') else 'false'} AS retried FROM left_over"""
            for issue, limit in _LIMITS.items()
        )
        + ") WHERE residual > threshold",
        *_RAW_FENCES,
        f"left_over AS (SELECT {_residual_facts('dirty', 'r')})",
    )
)
def failed_thresholds(spark, folder):
    """Which issue types are over their limit, and which of them a next cycle tries again."""
    config = PDSAConfig(max_skew_ratio=_LIMITS["skew"])
    left = compute_residuals(EXACT.profile(stored_orders(spark, folder), KEYS))
    rows = [
        (issue, left[issue], config.limits()[issue], issue in config.iterative_issue_types)
        for issue in failed_issues(left, config)
    ]
    return spark.createDataFrame(rows, "issue string, residual double, threshold double, retried boolean")


LABEL = "o_orderstatus"


def _run(plan, spark, folder):
    """A cycle or loop over all columns, with label and reference schema."""
    return plan.run(stored_orders(spark, folder), KEYS, table(spark, folder, "orders").schema, LABEL)


# Two turns of the loop in SQL: the second caps what is still outside the fences
# of the first turn's result.
_TURNS = (
    fence("t1", "slim", "o_totalprice")
    + f""", turn1 AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus,
      {capped("coalesce(o_totalprice, (SELECT quantile_disc(o_totalprice, 0.5) FROM slim))", 't1')} AS o_totalprice,
      o_orderdate, coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM slim), """
    + fence("t2", "turn1", "o_totalprice")
    + f""", turn2 AS (SELECT o_orderkey, o_custkey, o_orderstatus, {capped('o_totalprice', 't2')} AS o_totalprice,
      o_orderdate, o_orderpriority FROM turn1), """
    + fence("t3", "turn2", "o_totalprice")
)
_SLIM = "slim AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM dirty)"


def _left(source: str, name: str) -> str:
    return f"""(SELECT round({div(f"count(*) FILTER (WHERE {beyond('o_totalprice', name)})", 'count(*)')}, 6) FROM {source})"""


@query(
    with_dirty(
        f"""SELECT 'outliers' AS issue, {_left('turn1', 't2')} AS residual, 0.01::DOUBLE AS "limit", true AS retried
            WHERE {_left('turn1', 't2')} > 0.01""",
        _SLIM,
        _TURNS,
    )
)
def act_log_rows(spark, folder):
    """What the first turn of the loop decides on the issue types over their limits."""
    loop = PDSALoop(POLICY, PDSAConfig(max_iterations=2), EXACT)
    first = _run(loop, spark, folder).iterations_frame().filter("iteration = 1")
    return first.select(F.inline("policy_adjustments"))


@query(
    with_dirty(
        f"""SELECT 1 AS iteration, {_left('turn1', 't2')} AS residual_outlier_ratio, {_left('turn1', 't2')} <= 0.01 AS thresholds_met
            UNION ALL SELECT 2, {_left('turn2', 't3')}, {_left('turn2', 't3')} <= 0.01
            WHERE {_left('turn1', 't2')} > 0.01""",
        _SLIM,
        _TURNS,
    )
)
def pdsa_loop(spark, folder):
    loop = PDSALoop(POLICY, PDSAConfig(max_iterations=2), EXACT)
    turns = _run(loop, spark, folder).iterations_frame()
    return turns.select("iteration", "residual_outlier_ratio", "thresholds_met")


_CYCLE = {
    "row_count.raw": "(SELECT count(*) FROM slim)",
    "row_count.cleaned": "(SELECT count(*) FROM turn1)",
    "missingness.raw_total": "(SELECT 3 * count(*) - count(o_totalprice) - count(o_orderpriority) - count(o_orderstatus) FROM slim)",
    "missingness.cleaned_total": "(SELECT count(*) - count(o_orderstatus) FROM turn1)",
    "duplicates.raw": "(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM slim)) FROM slim)",
    "duplicates.cleaned": "0",
    "outliers.by_column.o_totalprice.raw": f"(SELECT count(*) FROM slim WHERE {beyond('o_totalprice', 't1')})",
    "outliers.by_column.o_totalprice.cleaned": f"(SELECT count(*) FROM turn1 WHERE {beyond('o_totalprice', 't2')})",
}


def _facts(paths: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{path}' AS metric, CAST({sql} AS DOUBLE) AS value" for path, sql in paths.items()
    )


def _pick(report: dict, path: str) -> float:
    for step in path.split("."):
        report = report[step]
    return float(report)


def _cycle(spark, folder, policy=POLICY):
    return _run(CleaningCycle(EXACT, repair_policy=policy), spark, folder)


# One action for each column with gaps, for outliers and for copies, where there are any.
_ACTIONS = f"""(SELECT CAST(count(*) > count(o_totalprice) AS INTEGER) + CAST(count(*) > count(o_orderpriority) AS INTEGER) FROM slim)
    + CAST({_CYCLE['outliers.by_column.o_totalprice.raw']} > 0 AS INTEGER) + CAST({_CYCLE['duplicates.raw']} > 0 AS INTEGER)"""


@query(with_dirty(_facts(_CYCLE), _SLIM, _TURNS))
def cleaning_cycle(spark, folder):
    evaluation = _cycle(spark, folder).evaluation
    return spark.createDataFrame([(p, _pick(evaluation, p)) for p in _CYCLE], "metric string, value double")


@query(
    with_dirty(
        _facts(
            {
                "input_row_count": "(SELECT count(*) FROM slim)",
                "output_row_count": "(SELECT count(*) FROM turn1)",
                "input_column_count": "6",
                "output_column_count": "6",
                "row_count_delta": "(SELECT count(*) FROM turn1) - (SELECT count(*) FROM slim)",
                "column_count_delta": "0",
                "repair_action_count": _ACTIONS,
                "automated_repair_actions": _ACTIONS,
            }
        ),
        _SLIM,
        _TURNS,
    )
)
def effort_metrics(spark, folder):
    effort = _cycle(spark, folder).opex_metrics
    counts = {k: v for k, v in effort.items() if isinstance(v, int) and k != "manual_steps_avoided_estimate"}
    return spark.createDataFrame([(k, float(v)) for k, v in counts.items()], "metric string, value double")


_SECTION = "data_quality_metrics"
_GROUPED = {
    "change_in_missingness.raw_total": _CYCLE["missingness.raw_total"],
    "change_in_missingness.cleaned_total": _CYCLE["missingness.cleaned_total"],
    "reduction_in_duplicates.raw": _CYCLE["duplicates.raw"],
    "outlier_reduction.by_column.o_totalprice.raw": _CYCLE["outliers.by_column.o_totalprice.raw"],
    "outlier_reduction.by_column.o_totalprice.cleaned": _CYCLE["outliers.by_column.o_totalprice.cleaned"],
    "schema_consistency_measures.raw_issue_count": "0",
}


@query(with_dirty(_facts(_GROUPED), _SLIM, _TURNS))
def grouped_report(spark, folder):
    report = EvaluationReportBuilder().build(_cycle(spark, folder), None, 5, 60, 30.0).to_frame(spark)
    wanted = report.filter((F.col("category") == _SECTION) & F.col("metric").isin(*_GROUPED))
    return wanted.select("metric", "value")


# --- logged runs ------------------------------------------------------------

_BY_HAND = RepairPolicy(numeric_imputation="mode", outlier_strategy="none")
_HAND = f""", hand AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus,
      coalesce(o_totalprice, {mode_of('o_totalprice', 'slim')}) AS o_totalprice,
      o_orderdate, coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM slim), """ + fence("th", "hand", "o_totalprice")
_HAND_LEFT = "(SELECT count(*) - count(o_orderstatus) FROM hand)"
_COMPARED = {
    "missingness_raw": (_CYCLE["missingness.raw_total"],) * 2,
    "missingness_cleaned": (_CYCLE["missingness.cleaned_total"], _HAND_LEFT),
    "missingness_reduction": tuple(f"({_CYCLE['missingness.raw_total']} - {x})" for x in (_CYCLE["missingness.cleaned_total"], _HAND_LEFT)),
    "duplicates_raw": (_CYCLE["duplicates.raw"],) * 2,
    "duplicates_cleaned": ("0", "0"),
    "duplicates_reduction": (_CYCLE["duplicates.raw"],) * 2,
    "schema_raw_issue_count": ("0", "0"),
    "schema_cleaned_issue_count": ("0", "0"),
}


def _logged(spark, folder, policies):
    """A log and the ids of its runs, one cycle a policy; all are over one stored table, which is profiled once."""
    log = ExperimentLogger(f"{shared_folder(spark)}/runs-{uuid4().hex}", spark)
    df, schema = stored_orders(spark, folder), table(spark, folder, "orders").schema
    runs_of, raw = [], None
    for name, policy in policies.items():
        with CleaningCycle(EXACT, repair_policy=policy).run(df, KEYS, schema, LABEL, raw) as result:
            raw = result.raw_profile
            runs_of.append(log.log_run(name, result))
    return log, *runs_of


def _logged_pair(spark, folder):
    return _logged(spark, folder, {"orders_auto": POLICY, "orders_manual": _BY_HAND})


@query(
    with_dirty(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, CAST({a} AS DOUBLE) AS first_value, CAST({b} AS DOUBLE) AS second_value,
                CAST({b} AS DOUBLE) - CAST({a} AS DOUBLE) AS difference, {a} = {b} AS same"""
            for m, (a, b) in _COMPARED.items()
        ),
        _SLIM,
        _TURNS + _HAND,
    )
)
def run_compare(spark, folder):
    log, first, second = _logged_pair(spark, folder)
    return log.compare(first, second).filter(F.col("metric").isin(*_COMPARED))


@query(
    with_dirty(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS run_name, CAST({_CYCLE['missingness.raw_total']} AS DOUBLE) AS missingness_raw,
                CAST({_CYCLE['duplicates.raw']} AS DOUBLE) AS duplicates_raw,
                CAST((SELECT count(*) FROM slim WHERE {beyond('o_totalprice', 't1')}) AS DOUBLE) AS price_outliers_raw,
                CAST((SELECT count(*) FROM {source} WHERE {beyond('o_totalprice', f)}) AS DOUBLE) AS price_outliers_cleaned"""
            for name, source, f in (("orders_auto", "turn1", "t2"), ("orders_manual", "hand", "th"))
        ),
        _SLIM,
        _TURNS + _HAND,
    )
)
def run_pivot(spark, folder):
    log, _, _ = _logged_pair(spark, folder)
    wanted = {
        "missingness_raw": "evaluation.missingness.raw_total",
        "duplicates_raw": "evaluation.duplicates.raw",
        "price_outliers_raw": "evaluation.outliers.by_column.o_totalprice.raw",
        "price_outliers_cleaned": "evaluation.outliers.by_column.o_totalprice.cleaned",
    }
    return runs.pivot_runs(runs.named_metrics(log.read(), wanted), list(wanted), run="run_name")


_PRICE_LEFT = {
    name: f"(SELECT count(*) FROM {source} WHERE {beyond('o_totalprice', f)})" for name, source, f in (("auto", "turn1", "t2"), ("hand", "hand", "th"))
}


@query(
    with_dirty(
        f"""SELECT 'quality' AS outcome, {_PRICE_LEFT['auto']} = {_PRICE_LEFT['hand']} AND (SELECT count(*) FROM turn1) = (SELECT count(*) FROM hand)
              AND {_CYCLE['missingness.cleaned_total']} = {_HAND_LEFT} AS same, true AS any_metric
            UNION ALL SELECT 'classification', NULL, false UNION ALL SELECT 'regression', NULL, false""",
        _SLIM,
        _TURNS + _HAND,
    )
)
def run_verdicts(spark, folder):
    """Whether an automatic run and one by hand came to the same result; no models were logged."""
    log, first, second = _logged_pair(spark, folder)
    return log.verdicts(first, second).select("outcome", "same", (F.col("metrics") > 0).alias("any_metric"))


@query(
    with_dirty(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS run_name, CAST({_CYCLE['missingness.raw_total']} AS DOUBLE) AS missingness_raw,
                CAST({left} AS DOUBLE) AS missingness_cleaned, CAST((SELECT count(*) FROM slim) AS DOUBLE) AS row_count_raw,
                CAST((SELECT count(*) FROM {source}) AS DOUBLE) AS row_count_cleaned, 0.0::DOUBLE AS schema_drift_detected"""
            for name, source, left in (
                ("orders_auto", "turn1", _CYCLE["missingness.cleaned_total"]), ("orders_manual", "hand", _HAND_LEFT),
                ("orders_again", "turn1", _CYCLE["missingness.cleaned_total"]))
        ),
        _SLIM,
        _TURNS + _HAND,
    )
)
def run_summary(spark, folder):
    """The quality table of a log with three runs, the last one a repetition of the first."""
    log, *_ = _logged(spark, folder, {"orders_auto": POLICY, "orders_manual": _BY_HAND, "orders_again": POLICY})
    names = log.read().select("run_id", "run_name").distinct()
    return log.summary("data_quality").join(names, "run_id").select(
        "run_name", "missingness_raw", "missingness_cleaned", "row_count_raw", "row_count_cleaned", "schema_drift_detected")


@query(
    with_dirty(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS DOUBLE) AS missing_count FROM dirty"
            for c in ORDER_COLUMNS
        )
    )
)
def run_log_rows(spark, folder):
    log = ExperimentLogger(f"{shared_folder(spark)}/log-{uuid4().hex}", spark)
    profile = DataProfiler().profile(dirty_orders(spark, folder))
    run_id = log.append("orders_profile", {"raw_profile": profile})
    entries = log.read().filter(
        (F.col("run_id") == run_id)
        & F.col("path").startswith("missingness.")
        & F.col("path").endswith(".missing_count")
    )
    return entries.select(F.split("path", r"\.")[1].alias("column"), F.col("value").alias("missing_count"))


@query(
    """SELECT event_type AS run_name, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at, event_id AS run_id
       FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events)
       WHERE place = 1"""
)
def latest_run(spark, folder):
    log = table(spark, folder, "events").select(
        F.col("event_type").alias("run_name"), F.col("ts").alias("created_at"), F.col("event_id").alias("run_id")
    )
    newest = runs.latest_runs(log)
    return newest.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
