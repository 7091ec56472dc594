"""Repair in two steps: decide on the driver, then apply in one projection.

Deciding looks only at the profile and at a few aggregates. Applying builds one
expression per column (cast, fill, cap), so however many issues a table has, its
rows are read and rewritten once. Deduplication and layout follow where needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import Snapshot, as_snapshot, col, is_numeric, is_text, parse_type, present
from ..operators import duplicates as dup
from ..operators import fills, labels, layout
from ..operators.bounds import capped, within
from ..operators.schemas import cast_to
from .policy import RepairPolicy

Action = dict[str, Any]


@dataclass
class RepairResult:
    cleaned_df: DataFrame
    actions: list[Action] = field(default_factory=list)
    rewritten: frozenset[str] = frozenset()

    def actions_frame(self, spark: SparkSession | None = None) -> DataFrame:
        """The actions as a table: what was done, to which column, with what."""
        return actions_frame(spark or self.cleaned_df.sparkSession, self.actions)


def actions_frame(spark: SparkSession, actions: Sequence[Action]) -> DataFrame:
    rows = [
        (
            i,
            a.get("issue"),
            a.get("strategy"),
            a.get("column") or a.get("label_col"),
            {str(k): str(v) for k, v in a.items() if k not in ("issue", "strategy", "column")},
        )
        for i, a in enumerate(actions)
    ]
    return spark.createDataFrame(
        rows, "step int, issue string, strategy string, column string, details map<string,string>"
    )


@dataclass
class _Plan:
    """The per-column expressions in the making, and what they stand for."""

    columns: dict[str, Column]
    types: dict[str, T.DataType]
    actions: list[Action] = field(default_factory=list)
    rewritten: set[str] = field(default_factory=set)
    filters: dict[str, Column] = field(default_factory=dict)

    def frame(self, df: DataFrame) -> DataFrame:
        chosen = df.select(*[c.alias(n) for n, c in self.columns.items()])
        for condition in self.filters.values():
            chosen = chosen.filter(condition)
        return chosen


class RepairEngine:
    """Applies a policy to a profiled table, in a fixed order: schema, row
    filters, missing values, outliers, labels, duplicates, layout."""

    def __init__(self, policy: RepairPolicy | None = None):
        self.policy = policy or RepairPolicy()

    def repair(
        self,
        df: DataFrame,
        profile_report: Mapping[str, Any],
        reference_schema: T.StructType | Mapping | None = None,
        key_columns: Sequence[str] | None = None,
        label_col: str | None = None,
    ) -> RepairResult:
        policy = self.policy
        policy.validate()
        plan = _Plan({c: col(c) for c in df.columns}, {f.name: f.dataType for f in df.schema.fields})
        if policy.align_schema and reference_schema:
            _plan_schema(plan, policy, profile_report.get("schema_drift", {}), as_snapshot(reference_schema))
        _plan_row_filters(plan, policy)
        facts = _Facts(plan, df, profile_report)
        facts.gather(policy, label_col)
        _report_lost_values(plan, facts)
        if not policy.skip_imputation:
            _plan_fills(plan, policy, facts, label_col)
        _plan_caps(plan, policy, profile_report.get("outliers", {}), label_col)
        cleaned = plan.frame(df)
        actions = plan.actions
        if policy.label_imputation == "model":
            cleaned, done = _repair_labels(cleaned, policy, label_col, profile_report.get("label_noise", {}))
            actions = actions + done
            plan.rewritten |= {label_col} if done and label_col is not None else set()
        cleaned, done = _repair_duplicates(cleaned, policy, profile_report, key_columns, plan)
        actions = actions + done
        cleaned, done = _repair_layout(
            cleaned, policy, profile_report.get("skew", {}), facts.plan.frame(df),
            None if plan.filters else profile_report.get("row_count"),
        )
        return RepairResult(cleaned, actions + done, frozenset(plan.rewritten))


def _plan_schema(plan: _Plan, policy: RepairPolicy, drift: Mapping[str, Any], reference: Snapshot) -> None:
    for name in drift.get("removed_columns", []):
        if name in plan.columns:
            continue
        data_type = str(reference[name]["data_type"])
        plan.types[name] = parse_type(data_type)
        plan.columns[name] = F.lit(None).cast(plan.types[name])
        plan.rewritten.add(name)
        plan.actions.append(
            {"issue": "schema_drift", "column": name, "strategy": "add_missing_column", "data_type": data_type}
        )
    for change in drift.get("type_changes", []):
        name, wanted = change["column"], change["reference_type"]
        if name not in plan.columns:
            continue
        plan.columns[name] = cast_to(plan.columns[name], wanted)
        plan.types[name] = parse_type(wanted)
        plan.rewritten.add(name)
        plan.actions.append(
            {
                "issue": "schema_drift",
                "column": name,
                "strategy": "cast",
                "from_type": change["current_type"],
                "to_type": wanted,
            }
        )
    if policy.drop_added_columns:
        dropped = [c for c in drift.get("added_columns", []) if c in plan.columns]
        for name in dropped:
            del plan.columns[name], plan.types[name]
        if dropped:
            plan.actions.append(
                {"issue": "schema_drift", "columns": dropped, "strategy": "drop_added_columns"}
            )


def _plan_row_filters(plan: _Plan, policy: RepairPolicy) -> None:
    for name, (low, high) in policy.row_filters.items():
        if name in plan.columns:
            plan.filters[name] = within(name, plan.types[name], low, high)


class _Facts:
    """What deciding needs beyond the profile, from as few scans as can be.

    Columns the plan has cast or added are counted again, because casting can
    create missing values the profile has not seen. Fill values are taken from
    the aligned and filtered table, all numeric ones in one scan, all modes in
    one shuffle.
    """

    def __init__(self, plan: _Plan, df: DataFrame, profile: Mapping[str, Any]):
        self.plan, self.df, self.profile = plan, df, profile
        self.rows = profile.get("row_count", 0) or 0
        self.aligned = plan.frame(df)
        self.missing: dict[str, int] = {
            c: s.get("missing_count", 0) for c, s in profile.get("missingness", {}).items()
        }
        self.lost: dict[str, int] = {}
        self.removed_rows: int | None = None
        self.fill: dict[str, Any] = {}

    def ratio(self, name: str) -> float:
        return self.missing.get(name, 0) / self.rows if self.rows else 0.0

    def wanting(self, policy: RepairPolicy, label: str | None) -> list[str]:
        return [
            c
            for c in self.plan.columns
            if c != label and self.ratio(c) > policy.missingness_threshold
        ]

    def gather(self, policy: RepairPolicy, label: str | None) -> None:
        self._recount(policy)
        if policy.skip_imputation:
            return
        wanting = self.wanting(policy, label)
        numeric = [c for c in wanting if is_numeric(self.plan.types[c])]
        text = [c for c in wanting if is_text(self.plan.types[c])]
        by_mode = []
        if policy.numeric_imputation == "median":
            self.fill |= fills.medians(self.aligned, numeric, policy.exact_quantiles)
        elif policy.numeric_imputation == "mean":
            self.fill |= fills.means(self.aligned, numeric)
        else:
            by_mode += numeric
        if policy.categorical_imputation == "constant":
            self.fill |= dict.fromkeys(text, policy.categorical_fill_value)
        else:
            by_mode += text
        self.fill |= fills.modes(self.aligned, by_mode)

    def _recount(self, policy: RepairPolicy) -> None:
        """One scan for rewritten columns and filtered rows, if there are any."""
        fresh = [c for c in self.plan.columns if c in self.plan.rewritten]
        if not fresh and not self.plan.filters:
            return
        raw_names = set(self.df.columns)
        base = self.df.select(
            *[c.alias(n) for n, c in self.plan.columns.items()],
            *[col(c).alias(f"__raw_{i}") for i, c in enumerate(fresh) if c in raw_names],
        )
        kept = F.lit(True)
        for condition in self.plan.filters.values():
            kept = kept & condition
        wanted = [F.count_if(kept).alias("kept"), F.count(F.lit(1)).alias("all")]
        for i, name in enumerate(fresh):
            value = present(col(name), self.plan.types[name])
            wanted.append(F.count_if(kept & value.isNull()).alias(f"missing_{i}"))
            if name in raw_names:
                lost = F.col(f"__raw_{i}").isNotNull() & col(name).isNull()
                wanted.append(F.count_if(lost).alias(f"lost_{i}"))
        row = base.agg(*wanted).first()
        for i, name in enumerate(fresh):
            if self.profile.get("missingness"):
                self.missing[name] = row[f"missing_{i}"]
            if name in raw_names:
                self.lost[name] = row[f"lost_{i}"]
        self.rows = row["kept"]
        if self.plan.filters:
            self.removed_rows = row["all"] - row["kept"]


def _report_lost_values(plan: _Plan, facts: _Facts) -> None:
    for action in plan.actions:
        if action["strategy"] == "cast":
            action["lost_values"] = facts.lost.get(action["column"], 0)
    if facts.removed_rows:
        plan.actions.append(
            {
                "issue": "outliers",
                "columns": list(plan.filters),
                "strategy": "drop_rows_outside_range",
                "rows_removed": facts.removed_rows,
            }
        )


def _plan_fills(plan: _Plan, policy: RepairPolicy, facts: _Facts, label: str | None) -> None:
    for name in facts.wanting(policy, label):
        replacement = facts.fill.get(name)
        if replacement is None:
            continue
        data_type = plan.types[name]
        plan.columns[name] = fills.filled(plan.columns[name], data_type, replacement)
        plan.rewritten.add(name)
        numeric = is_numeric(data_type)
        plan.actions.append(
            {
                "issue": "missingness",
                "column": name,
                "strategy": policy.numeric_imputation if numeric else policy.categorical_imputation,
                "fill_value": replacement,
                "missing_ratio": round(facts.ratio(name), 4),
            }
        )


def _plan_caps(plan: _Plan, policy: RepairPolicy, report: Mapping[str, Any], label: str | None) -> None:
    for name, found in report.items():
        if name not in plan.columns or not is_numeric(plan.types[name]):
            continue
        if name == label and not policy.cap_label:
            continue
        strategy = policy.outlier_column_strategies.get(name, policy.outlier_strategy)
        counts = {
            "outlier_count": found.get("outlier_count", 0),
            "outlier_ratio": found.get("outlier_ratio", 0.0),
        }
        if strategy == "none":
            if name in policy.outlier_column_strategies and counts["outlier_count"] > 0:
                plan.actions.append(
                    {"issue": "outliers", "column": name, "strategy": "none", **counts,
                     "message": "The policy leaves this column as it is."}
                )
            continue
        if found.get("severity") not in policy.repair_outlier_severities:
            continue
        if not found.get("repairable", True):
            plan.actions.append(
                {
                    "issue": "outliers",
                    "column": name,
                    "strategy": "skip_non_repairable",
                    "method": found.get("method"),
                    "outlier_count": counts["outlier_count"],
                    "message": found.get("message"),
                }
            )
            continue
        lower, upper = found.get("lower_bound"), found.get("upper_bound")
        if lower is None or upper is None:
            continue
        floor, ceiling = policy.cap_limits.get(name, (None, None))
        lower = lower if floor is None else max(lower, floor)
        upper = upper if ceiling is None else min(upper, ceiling)
        plan.columns[name] = capped(plan.columns[name], plan.types[name], lower, upper)
        plan.rewritten.add(name)
        plan.actions.append(
            {"issue": "outliers", "column": name, "strategy": "cap", "lower_bound": lower,
             "upper_bound": upper, **counts}
        )


def _repair_labels(
    df: DataFrame, policy: RepairPolicy, label: str | None, report: Mapping[str, Any]
) -> tuple[DataFrame, list[Action]]:
    nulls = report.get("label_null_count", 0)
    if label is None or label not in df.columns or nulls <= 0:
        return df, []
    done = labels.impute_labels(
        df, label, policy.label_confidence_threshold, policy.label_min_training_rows,
        policy.label_encoding, policy.max_label_classes,
    )
    if done.reason is not None:
        action: Action = {"issue": "label_noise", "strategy": "skip_model_imputation", "reason": done.reason}
        if done.reason != labels.NO_FEATURES:
            action |= {
                "label_null_count": nulls,
                "training_row_count": done.training_rows,
                "minimum_training_rows": policy.label_min_training_rows,
            }
        return df, [action]
    return done.df, [
        {
            "issue": "label_noise",
            "strategy": "model_label_imputation",
            "label_col": label,
            "label_null_count": nulls,
            "candidate_count": done.candidates,
            "imputed_count": done.imputed,
            "training_row_count": done.training_rows,
            "confidence_threshold": policy.label_confidence_threshold,
        }
    ]


def _repair_duplicates(
    df: DataFrame, policy: RepairPolicy, profile: Mapping[str, Any], keys: Sequence[str] | None, plan: _Plan
) -> tuple[DataFrame, list[Action]]:
    if not policy.drop_duplicates:
        return df, []
    if policy.duplicate_strategy == "key":
        known = [k for k in dict.fromkeys(keys or []) if k in df.columns]
        if not known:
            return df, []
        repeated = dup.group_census(df, {"key": known}).first()
        if repeated is None or repeated["duplicate_row_count"] == 0:
            return df, []
        return dup.drop_duplicates_by_key(df, known), [
            {
                "issue": "duplicates",
                "strategy": "dropDuplicates_by_key",
                "key_columns": known,
                "duplicate_row_count": repeated["duplicate_row_count"],
            }
        ]
    report = profile.get("duplicates", {})
    if not report:
        return df, []
    count = report.get("exact", {}).get("duplicate_count", report.get("duplicate_count", 0))
    if count == 0 and _rows_stay_distinct(report, policy, plan):
        return df, []
    action = {
        "issue": "duplicates",
        "strategy": "dropDuplicates",
        "duplicate_count": count,
        "duplicate_ratio": report.get("duplicate_ratio", 0.0),
    }
    if count == 0:
        action["message"] = "No duplicates before the repair; rows the repair made equal are merged."
    return dup.drop_duplicates(df), [action]


def _rows_stay_distinct(report: Mapping[str, Any], policy: RepairPolicy, plan: _Plan) -> bool:
    """Whether a table without duplicates provably has none after the repair.

    True if no value was rewritten and no column or label changed, or if an
    untouched key is unique. It saves shuffling the whole table for nothing.
    """
    dropped = any(a["strategy"] == "drop_added_columns" for a in plan.actions)
    if not plan.rewritten and not dropped and policy.label_imputation == "none":
        return True
    unique = [
        k for k, found in report.get("by_key", {}).items() if found.get("duplicate_group_count") == 0
    ]
    return any(k in plan.columns and k not in plan.rewritten for k in unique)


def _repair_layout(
    df: DataFrame, policy: RepairPolicy, report: Mapping[str, Any], before: DataFrame, rows: int | None
) -> tuple[DataFrame, list[Action]]:
    """Spread the worst key. Its hot values are read off ``before``, the table
    as it was ahead of deduplication, where only the key column is scanned.
    ``rows`` is its row count, where the profile has told it."""
    if policy.skew_strategy == "none":
        return df, []
    candidates = [
        (found["skew_ratio"], name)
        for name, found in report.items()
        if name in df.columns
        and found.get("severity") in policy.repair_skew_severities
        and found.get("skew_ratio") is not None
    ]
    if not candidates:
        return df, []
    skew, name = max(candidates)
    partitions = policy.skew_target_partitions
    if partitions is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = layout.hot_values(before.select(col(name)), name, partitions, rows)
    return layout.spread_values(df, name, partitions, hot), [
        {
            "issue": "skew",
            "column": name,
            "strategy": "repartition",
            "skew_ratio": skew,
            "severity": report[name].get("severity"),
            "max_count": report[name].get("max_count"),
            "median_count": report[name].get("median_count"),
            "target_partitions": partitions,
            "message": "Only the placement of rows changes; values and key frequencies stay.",
        }
    ]
