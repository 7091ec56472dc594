"""Before/after evaluation of two profile reports, and the effort it took.

The reports hold one entry per column or key. The same comparisons over profile
tables are in ``operators.changes``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Any

Report = dict[str, Any]


@dataclass
class DataQualityEvaluation:
    metrics: Report


def safe_ratio(part: float, whole: float) -> float:
    return round(part / whole, 4) if whole else 0.0


def _drop(raw: int, cleaned: int, raw_name: str = "raw", cleaned_name: str = "cleaned") -> Report:
    return {
        raw_name: raw,
        cleaned_name: cleaned,
        "reduction": raw - cleaned,
        "reduction_ratio": safe_ratio(raw - cleaned, raw),
    }


def _drop_by_column(raw: Mapping, cleaned: Mapping, columns: Iterable[str], count: str) -> Report:
    pairs = {
        c: (raw.get(c, {}).get(count, 0), cleaned.get(c, {}).get(count, 0)) for c in columns
    }
    before, after = (sum(p[side] for p in pairs.values()) for side in (0, 1))
    return _drop(before, after, "raw_total", "cleaned_total") | {
        "by_column": {c: _drop(*p) for c, p in pairs.items()}
    }


def skew_pairs(raw: Mapping, cleaned: Mapping) -> Report:
    by_column = {}
    for key in sorted(raw.keys() | cleaned.keys()):
        before, after = raw.get(key, {}), cleaned.get(key, {})
        was, now = before.get("skew_ratio"), after.get("skew_ratio")
        by_column[key] = {
            "raw_skew_ratio": was,
            "cleaned_skew_ratio": now,
            "reduction": None if was is None or now is None else round(was - now, 4),
            "raw_severity": before.get("severity"),
            "cleaned_severity": after.get("severity"),
        }
    return by_column


def skew_keys_reduced(by_column: Mapping[str, Report]) -> int | None:
    """How many keys are less skewed than before; None without keys."""
    if not by_column:
        return None
    return sum(1 for e in by_column.values() if (e["reduction"] or 0) > 0)


def drift_issues(drift: Mapping[str, Any]) -> int:
    return sum(len(drift.get(part, [])) for part in ("added_columns", "removed_columns", "type_changes"))


class DataQualityEvaluator:
    """Compares the profile of the raw table with that of the cleaned one."""

    def evaluate(
        self,
        raw_profile: Mapping[str, Any],
        cleaned_profile: Mapping[str, Any],
        repair_actions: Sequence[Mapping[str, Any]] | None = None,
    ) -> DataQualityEvaluation:
        actions = list(repair_actions or [])
        sections = {
            name: (raw_profile.get(name, {}), cleaned_profile.get(name, {}))
            for name in ("missingness", "duplicates", "outliers", "skew", "schema_drift")
        }
        rows = raw_profile.get("row_count", 0), cleaned_profile.get("row_count", 0)
        drift = sections["schema_drift"]
        return DataQualityEvaluation(
            {
                "row_count": {
                    "raw": rows[0],
                    "cleaned": rows[1],
                    "change": rows[1] - rows[0],
                    "change_ratio": safe_ratio(rows[1] - rows[0], rows[0]),
                },
                "missingness": _missingness(*sections["missingness"]),
                "duplicates": _drop(*(d.get("duplicate_count", 0) for d in sections["duplicates"])),
                "outliers": _drop_by_column(
                    *sections["outliers"],
                    sorted(sections["outliers"][0].keys() | sections["outliers"][1].keys()),
                    "outlier_count",
                ),
                "skew": {"by_column": skew_pairs(*sections["skew"])},
                "schema_drift": {
                    "raw_drift_detected": drift[0].get("drift_detected", False),
                    "cleaned_drift_detected": drift[1].get("drift_detected", False),
                    "raw_issue_count": drift_issues(drift[0]),
                    "cleaned_issue_count": drift_issues(drift[1]),
                },
                "repair_action_count": len(actions),
                "repair_actions_by_issue": dict(Counter(a.get("issue", "unknown") for a in actions)),
            }
        )


def _missingness(raw: Mapping, cleaned: Mapping) -> Report:
    """Totals cover the columns both tables have; the others are listed apart."""
    shared = sorted(raw.keys() & cleaned.keys())

    def only(one: Mapping, other: Mapping) -> dict[str, int]:
        return {c: one[c].get("missing_count", 0) for c in sorted(one.keys() - other.keys())}

    return _drop_by_column(raw, cleaned, shared, "missing_count") | {
        "scope": "shared_columns",
        "added_columns": only(cleaned, raw),
        "removed_columns": only(raw, cleaned),
    }


def summarize_quality(evaluation: Mapping[str, Any]) -> Report:
    """The headline reductions of one evaluation."""
    return {
        "missingness_reduction": evaluation["missingness"]["reduction"],
        "duplicate_reduction": evaluation["duplicates"]["reduction"],
        "outlier_reduction": evaluation["outliers"]["reduction"],
        "skew_columns_reduced": skew_keys_reduced(evaluation["skew"]["by_column"]),
        "schema_raw_issue_count": evaluation["schema_drift"]["raw_issue_count"],
        "schema_cleaned_issue_count": evaluation["schema_drift"]["cleaned_issue_count"],
        "repair_actions_by_issue": evaluation["repair_actions_by_issue"],
    }


@dataclass
class OPEXMetrics:
    """What one cleaning cycle cost and did."""

    raw_profile_time_seconds: float
    repair_time_seconds: float
    cleaned_profile_time_seconds: float
    evaluation_time_seconds: float
    total_time_seconds: float
    input_row_count: int
    output_row_count: int
    input_column_count: int
    output_column_count: int
    row_count_delta: int
    column_count_delta: int
    repair_action_count: int
    repair_actions_by_issue: dict[str, int]
    seconds_per_1000_input_rows: float | None
    automated_repair_actions: int
    manual_steps_avoided_estimate: int

    def to_dict(self) -> Report:
        return asdict(self)


def build_opex_metrics(
    *,
    raw_profile: Mapping[str, Any],
    cleaned_profile: Mapping[str, Any],
    evaluation: Mapping[str, Any],
    raw_profile_time_seconds: float,
    repair_time_seconds: float,
    cleaned_profile_time_seconds: float,
    evaluation_time_seconds: float,
    total_time_seconds: float,
) -> Report:
    rows_in, rows_out = (int(p.get("row_count", 0)) for p in (raw_profile, cleaned_profile))
    columns_in, columns_out = (int(p.get("column_count", 0)) for p in (raw_profile, cleaned_profile))
    actions = int(evaluation.get("repair_action_count", 0))
    return OPEXMetrics(
        raw_profile_time_seconds=round(raw_profile_time_seconds, 6),
        repair_time_seconds=round(repair_time_seconds, 6),
        cleaned_profile_time_seconds=round(cleaned_profile_time_seconds, 6),
        evaluation_time_seconds=round(evaluation_time_seconds, 6),
        total_time_seconds=round(total_time_seconds, 6),
        input_row_count=rows_in,
        output_row_count=rows_out,
        input_column_count=columns_in,
        output_column_count=columns_out,
        row_count_delta=rows_out - rows_in,
        column_count_delta=columns_out - columns_in,
        repair_action_count=actions,
        repair_actions_by_issue=dict(evaluation.get("repair_actions_by_issue", {})),
        seconds_per_1000_input_rows=round(total_time_seconds / rows_in * 1000, 6) if rows_in else None,
        automated_repair_actions=actions,
        manual_steps_avoided_estimate=actions,
    ).to_dict()
