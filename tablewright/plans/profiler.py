"""The full profile of a table in a handful of Spark jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from copy import deepcopy
from dataclasses import dataclass
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grades, quantiles
from ..functions.columns import Snapshot, as_snapshot, has_nan, is_text, snapshot
from ..functions.summaries import Measure, count_where, sketch, summarise
from ..operators import duplicates as dup
from ..operators import labels
from ..operators.completeness import missing_tests
from ..operators.outliers import ZERO_IQR_MESSAGE, Fence, as_fences, numeric_values
from ..operators.schemas import find_drift

Report = dict[str, Any]

_KEY_NOTE = (
    "Rows that share a key value need not be duplicates; nothing is removed for "
    "it unless key-based deduplication is switched on."
)
_NOT_FITTED = {"evaluated": False, "message": "The forest has been left out for now."}
_QUARTILES = (0.25, 0.75)
#: Aggregates that share a scan; wider tables are scanned in parts.
_MEASURES = 300
_WHOLE_ROW, _LABEL, _COMPOSITE = "\0row", "\0label", "\0composite"


@dataclass(frozen=True)
class Carried:
    """An earlier profile of the same rows, and the columns whose values have changed since.

    It was made by a profiler of the same settings, with the same keys, label and
    reference schema. The rows themselves must be the same, in any order: what
    holds of a column that has not changed then still holds.
    """

    report: Mapping[str, Any]
    changed: frozenset[str] = frozenset()

    def same_columns(self, df: DataFrame) -> set[str]:
        """The columns of a table whose values and type are those of the earlier profile."""
        before, now = self.report["schema"], snapshot(df.schema)
        return {
            c for c, field in now.items()
            if c not in self.changed and c in before and before[c]["data_type"] == field["data_type"]
        }


class DataProfiler:
    """Measures six quality dimensions of a DataFrame without changing it.

    A profile takes one scan for row count, missing values and quantile sketches,
    and a few that narrow the sketches down to exact quartiles; one scan for
    outliers; and one scan with a single shuffle for exact duplicates, keys, the
    composite key and the label together. Beyond a hundred columns or sixteen keys
    each of these is done in parts. A text label adds a forest fit.

    ``label_encoding`` ("index" or "hash") says how text becomes features of that
    forest, ``max_label_classes`` bounds its classes, and ``label_noise_folds``
    above one has rows scored by forests that have not seen them.

    ``restore_drifted_types`` reads numbers that drifted to text as numbers when
    looking for outliers. Without ``exact_quantiles`` the sketched quartiles are
    taken as they are: fewer scans, but values that may vary between runs.
    """

    def __init__(
        self,
        outlier_iqr_multiplier: float = 1.5,
        label_noise_min_rows: int = 30,
        label_noise_confidence_threshold: float = 0.65,
        exact_quantiles: bool = True,
        restore_drifted_types: bool = True,
        strict: bool = False,
        label_encoding: str = "index",
        max_label_classes: int = labels.MAX_LABEL_CLASSES,
        label_noise_folds: int = 1,
    ):
        self.outlier_iqr_multiplier = outlier_iqr_multiplier
        self.label_noise_min_rows = label_noise_min_rows
        self.label_noise_confidence_threshold = label_noise_confidence_threshold
        self.exact_quantiles = exact_quantiles
        self.restore_drifted_types = restore_drifted_types
        self.strict = strict
        self.label_encoding = label_encoding
        self.max_label_classes = max_label_classes
        self.label_noise_folds = label_noise_folds

    def profile(
        self,
        df: DataFrame,
        key_columns: Sequence[str] | None = None,
        reference_schema: T.StructType | Mapping | None = None,
        label_col: str | None = None,
        carried: Carried | None = None,
        fit_labels: bool = True,
    ) -> Report:
        """The nested report: sizes, schema, and one section per dimension.

        With ``carried`` only columns that changed are scanned, and keys, labels and
        whole rows that hold one of them; the report is that of a profile without it.
        Without ``fit_labels`` the forest of the label section is left to
        ``complete_labels``.
        """
        reference = as_snapshot(reference_schema)
        keys = list(key_columns or [])
        same = carried.same_columns(df) if carried and carried.report["row_count"] else set()
        earlier = carried.report if same else {}
        values = numeric_values(df, reference if self.restore_drifted_types else None)
        known = {n: earlier["outliers"][n] for n in values if n in same and n in earlier["outliers"]}
        fresh = {n: v for n, v in values.items() if n not in known}
        basics = self._scan_basics(df, fresh, self._known_basics(df, same, earlier))
        rows = basics["rows"]
        fences = self._fences(df, fresh, basics) if rows else {}
        census = self._census(df, keys, label_col, self._known_groups(df, same, earlier)) if rows else {}
        found = self._outliers(df, rows, fresh, fences) | deepcopy(known)
        current = snapshot(df.schema)
        return {
            "row_count": rows,
            "column_count": len(df.columns),
            "schema": current,
            "missingness": self._missingness(df, basics) if rows else {},
            "duplicates": self._duplicates(df, rows, keys, census),
            "outliers": {n: found[n] for n in values if n in found},
            "skew": self._skew(df, keys, census),
            "schema_drift": drift_report(current, reference),
            "label_noise": deepcopy(earlier["label_noise"])
            if earlier and _is_whole(df, same, earlier) and earlier["label_noise"].get("label_col") == label_col
            else self._labels(df, label_col, basics, census, reference, fit_labels),
        }

    def complete_labels(
        self, df: DataFrame, report: Report, reference_schema: T.StructType | Mapping | None = None, **_: Any
    ) -> None:
        """Fit the forest that a profile of this table has left out, if it has."""
        found = report["label_noise"]
        if found.get("confidence_noise") == _NOT_FITTED:
            labelled, classes = report["row_count"] - found["label_null_count"], found["distinct_label_count"]
            found["confidence_noise"] = self._noise(df, found["label_col"], labelled, classes, as_snapshot(reference_schema))

    @staticmethod
    def _known_basics(df: DataFrame, same: set[str], earlier: Mapping[str, Any]) -> dict[str, Any]:
        """Row count and missing counts of the columns that are the same."""
        if not same:
            return {}
        known = {"rows": earlier["row_count"]}
        for i, f in enumerate(df.schema.fields):
            if f.name in same:
                entry = earlier["missingness"][f.name]
                nans = entry.get("nan_count", 0)
                known |= {f"null_{i}": entry["missing_count"] - nans, f"nan_{i}": nans}
        return known

    @staticmethod
    def _known_groups(df: DataFrame, same: set[str], earlier: Mapping[str, Any]) -> dict[str, Any]:
        """Group counts of keys, label and whole rows that hold same columns only."""
        if not same:
            return {}
        groups: dict[str, Any] = {}
        of_keys, composite = earlier["duplicates"]["by_key"], earlier["duplicates"]["composite_key"]
        for key, entry in of_keys.items():
            if key in same:
                groups[key] = {**entry, **earlier["skew"][key]}
        together = composite.get("valid_key_columns", [])
        if "duplicate_group_count" in composite and set(together) <= same:
            groups[_COMPOSITE, tuple(dict.fromkeys(together))] = composite
        label = earlier["label_noise"]
        if label.get("label_col") in same:
            groups[_LABEL, label["label_col"]] = {"group_count": label["distinct_label_count"]}
        if _is_whole(df, same, earlier):
            groups[_WHOLE_ROW] = earlier["duplicates"]["exact"]["duplicate_count"]
        return groups

    def _scan_basics(self, df: DataFrame, values: Mapping[str, Column], known: Mapping[str, Any]) -> dict[str, Any]:
        """Row count, missing counts and quantile sketches from one scan, but for what is known."""
        shares = quantiles.around(_QUARTILES) if self.exact_quantiles else _QUARTILES
        measures = {"rows": Measure(F.count(F.lit(1)))}
        measures |= {name: count_where(test) for name, test in missing_tests(df).items()}
        measures = {name: m for name, m in measures.items() if name not in known}
        counts = {name: [F.col(name)] for name in measures}
        for i, value in enumerate(values.values()):
            measures[f"s{i}"] = sketch(value)
            counts[f"s{i}"] = [
                F.kll_sketch_get_n_double(f"s{i}").alias(f"n{i}"),
                quantiles.from_sketch(f"s{i}", shares).alias(f"q{i}"),
            ]
        names, basics = list(measures), dict(known)
        for k in range(0, len(names), _MEASURES):
            part = names[k : k + _MEASURES]
            chosen = [c for name in part for c in counts[name]]
            basics |= summarise(df, {name: measures[name] for name in part}).select(*chosen).first().asDict()
        return basics

    def _missingness(self, df: DataFrame, basics: Mapping[str, Any]) -> Report:
        rows, report = basics["rows"], {}
        for i, f in enumerate(df.schema.fields):
            nans = basics[f"nan_{i}"] if has_nan(f.dataType) else 0
            missing = basics[f"null_{i}"] + nans
            report[f.name] = {
                "missing_count": missing,
                "missing_ratio": round(missing / rows, 4),
                "severity": grades.MISSINGNESS.grade(missing / rows),
            } | ({"nan_count": nans} if has_nan(f.dataType) else {})
        return report

    def _fences(self, df: DataFrame, values: Mapping[str, Column], basics: Mapping[str, Any]) -> dict[str, Fence]:
        if self.exact_quantiles:
            found, number = {}, {name: i for i, name in enumerate(values)}
            for part in quantiles.in_parts(values):
                names = {name: f"v{number[name]}" for name in part}
                sketched = {a: (basics[f"n{number[n]}"], basics[f"q{number[n]}"]) for n, a in names.items()}
                data = df.select(*[part[name].alias(a) for name, a in names.items()])
                found |= quantiles.search(data, names, sketched, _QUARTILES)
        else:
            found = {name: basics[f"q{i}"] or (None, None) for i, name in enumerate(values)}
        return as_fences(found, self.outlier_iqr_multiplier)

    def _outliers(self, df: DataFrame, rows: int, values, fences: Mapping[str, Fence]) -> Report:
        if not fences:
            return {}
        beyond = {n: F.count_if(f.breaks(values[n])) for n, f in fences.items()}
        counts: dict[str, int] = {}
        for part in quantiles.in_parts(beyond):
            row = df.agg(*[c.alias(f"o_{i}") for i, c in enumerate(part.values())]).first()
            counts |= dict(zip(part, row))
        report = {}
        for name, fence in fences.items():
            count = counts[name]
            report[name] = {
                "q1": fence.q1,
                "q3": fence.q3,
                "iqr": fence.iqr,
                "lower_bound": fence.lower,
                "upper_bound": fence.upper,
                "outlier_count": count,
                "outlier_ratio": round(count / rows, 4),
                "severity": grades.OUTLIERS.grade(count / rows),
                "method": fence.method,
                "repairable": fence.repairable,
            } | ({} if fence.repairable else {"message": ZERO_IQR_MESSAGE})
        return report

    def _census(self, df: DataFrame, keys: Sequence[str], label: str | None, carried: Mapping[Any, Any]) -> dict[str, Any]:
        """All group counts the report needs, from one job, but for those that are carried over."""
        known = [k for k in dict.fromkeys(keys) if k in df.columns]
        sets = {k: [k] for k in known if k not in carried}
        kept = {k: carried[k] for k in known if k in carried}
        if len(known) >= 2:
            if (_COMPOSITE, tuple(known)) in carried:
                kept[_COMPOSITE] = carried[_COMPOSITE, tuple(known)]
            else:
                sets[_COMPOSITE] = known
        if label is not None and label in df.columns:
            if (_LABEL, label) in carried:
                kept[_LABEL] = carried[_LABEL, label]
            else:
                sets[_LABEL] = [label]
        if _WHOLE_ROW in carried:
            kept[_WHOLE_ROW] = carried[_WHOLE_ROW]
            return kept | ({r["key_set"]: r for r in dup.group_census(df, sets).collect()} if sets else {})
        table = df
        by_fingerprint = dup.can_fingerprint(df)
        if by_fingerprint:
            sets[_WHOLE_ROW] = list(dup.FINGERPRINT)
            table = df.select("*", *dup.fingerprint(df))
        counted = {r["key_set"]: r for r in dup.group_census(table, sets).collect()} if sets else {}
        if by_fingerprint:
            suspects = counted[_WHOLE_ROW]["duplicate_group_count"]
            counted[_WHOLE_ROW] = dup.exact_duplicate_count(df, suspects)
        else:
            counted[_WHOLE_ROW] = dup.exact_duplicates(df).first()["duplicate_count"]
        return kept | counted

    def _duplicates(self, df: DataFrame, rows: int, keys: Sequence[str], census) -> Report:
        exact = _duplicate_entry(census.get(_WHOLE_ROW, 0), rows)
        report = {**exact, "exact": dict(exact), "by_key": {}, "composite_key": {}}
        if rows == 0 or not keys:
            return report
        known = [k for k in keys if k in df.columns]
        lacking = [k for k in keys if k not in df.columns]
        for key in lacking:
            report["by_key"][key] = {"error": dup.missing_column_message(key)}
        for key in known:
            report["by_key"][key] = _group_entry(census[key], rows) | {"message": _KEY_NOTE}
        composite = {
            "key_columns": list(keys),
            "valid_key_columns": known,
            "missing_key_columns": lacking,
        }
        if len(known) < 2:
            composite["message"] = (
                "A composite key takes two or more columns that the table has."
            )
        else:
            counts = census[_COMPOSITE] if len(set(known)) > 1 else census[known[0]]
            composite |= _group_entry(counts, rows) | {"message": _KEY_NOTE}
        report["composite_key"] = composite
        return report

    def _skew(self, df: DataFrame, keys: Sequence[str], census) -> Report:
        report: Report = {}
        for key in keys:
            if key not in df.columns:
                report[key] = {"error": dup.missing_column_message(key)}
                continue
            groups = census.get(key)
            largest = groups["max_count"] if groups else None
            median = float(groups["median_count"]) if groups else None
            skew = largest / median if median else None
            report[key] = {
                "max_count": largest,
                "median_count": median,
                "skew_ratio": round(skew, 4) if skew is not None else None,
                "severity": grades.SKEW.grade(skew),
            }
        return report

    def _labels(self, df: DataFrame, label: str | None, basics, census, reference: Snapshot | None, fit: bool) -> Report:
        rows = basics["rows"]
        if label is None:
            return {"evaluated": False, "message": "No label was named."}
        if label not in df.columns:
            return {"evaluated": False, "message": f"The table has no label column '{label}'."}
        nulls, classes = 0, 0
        if rows:
            nulls = basics[f"null_{df.columns.index(label)}"]
            classes = census[_LABEL]["group_count"]
        return {
            "evaluated": True,
            "label_col": label,
            "label_null_count": nulls,
            "label_null_ratio": round(nulls / rows, 4) if rows else 0.0,
            "distinct_label_count": classes,
            "confidence_noise": {"evaluated": False, "message": "The table is empty."}
            if not rows
            else self._noise(df, label, rows - nulls, classes, reference)
            if fit
            else dict(_NOT_FITTED),
        }

    def _noise(self, df: DataFrame, label: str, labelled: int, classes: int, reference) -> Report:
        least = self.label_noise_min_rows
        if not is_text(df.schema[label].dataType) or classes < 2 or labelled < least:
            return {
                "evaluated": False,
                "message": f"Left out: a forest needs a text label of two classes or more on {least} rows.",
            }
        threshold = self.label_noise_confidence_threshold
        try:
            found = labels.estimate_label_noise(
                df, label, threshold, least, reference, self.label_encoding, self.max_label_classes, self.label_noise_folds)
        except (ValueError, IllegalArgumentException) as failure:  # what Spark ML says of data it cannot fit
            if self.strict:
                raise
            return {
                "evaluated": False,
                "error_class": type(failure).__name__,
                "message": f"The forest could not be fitted: {failure}",
            }
        if found is None:
            return {"evaluated": False, "message": labels.NO_FEATURES}
        used = found.rows_used
        if used < least:
            return {
                "evaluated": False,
                "message": f"Only {used} labelled rows are complete; {least} are needed.",
            }
        if found.too_many_classes:
            return {"evaluated": False, "message": labels.MANY_CLASSES}
        average = found.average_confidence
        return {
            "evaluated": True,
            "method": "random_forest_self_evaluation" if self.label_noise_folds == 1 else "random_forest_out_of_fold",
            "confidence_threshold": threshold,
            "labeled_rows_used": used,
            "suspected_noise_count": found.suspected,
            "suspected_noise_ratio": round(found.suspected / used, 4),
            "average_prediction_confidence": None if average is None else round(average, 4),
            "low_confidence_ratio": round(found.low_confidence / used, 4),
            "severity": grades.LABEL_NOISE.grade(found.suspected / used),
            "type_restored_columns": list(found.features.restored),
            "note": "The forest scores its own training rows: a signal to look at, not a measurement."
            if self.label_noise_folds == 1
            else "Each row is scored by a forest fitted on the other folds.",
        }


def profile_after(
    profiler: DataProfiler, report: Mapping[str, Any], table: DataFrame, changed: frozenset[str], fit_labels: bool = True, **context: Any
) -> Report:
    """Profile a stored table that a repair has made of a profiled one.

    A repair rewrites the named columns and may drop rows, but makes no new ones. So
    if there are as many rows as before they are the same, and only those columns are
    scanned. Counting the rows of a stored table reads the footers of its files.
    """
    if report["row_count"] and table.count() == report["row_count"]:
        return profiler.profile(table, **context, carried=Carried(report, changed), fit_labels=fit_labels)
    return profiler.profile(table, **context, fit_labels=fit_labels)


def _is_whole(df: DataFrame, same: set[str], earlier: Mapping[str, Any]) -> bool:
    """Whether a table has the columns of the earlier one and all are the same."""
    return same == set(df.columns) == set(earlier["schema"])


def _duplicate_entry(count: int, rows: int) -> Report:
    share = count / rows if rows else 0.0
    return {
        "duplicate_count": count,
        "duplicate_ratio": round(share, 4),
        "severity": grades.DUPLICATES.grade(share),
    }


def _group_entry(groups, rows: int) -> Report:
    repeated, members = groups["duplicate_group_count"], groups["duplicate_row_count"]
    return {
        "duplicate_group_count": repeated,
        "duplicate_row_count": members,
        "duplicate_excess_count": members - repeated,
        "duplicate_ratio": round(members / rows, 4),
        "severity": grades.DUPLICATES.grade(members / rows),
    }


def drift_report(current: Snapshot, reference: Snapshot | None) -> Report:
    if reference is None:
        return {
            "evaluated": False,
            "message": "No schema to compare with was given.",
            "added_columns": [],
            "removed_columns": [],
            "type_changes": [],
            "drift_detected": False,
        }
    drift = find_drift(current, reference)
    return {
        "evaluated": True,
        "added_columns": list(drift.added),
        "removed_columns": list(drift.removed),
        "type_changes": [
            {"column": c, "reference_type": was, "current_type": now}
            for c, (was, now) in drift.changed.items()
        ],
        "drift_detected": drift.issue_count > 0,
    }


def flagged(report: Report) -> dict[str, Any]:
    """Detection only: how many columns or keys each dimension flags."""

    def graded(section: str, fine: set[str]) -> int:
        return sum(1 for entry in report[section].values() if entry.get("severity", "none") not in fine)

    return {
        "missingness_cols_flagged": graded("missingness", {"none"}),
        "duplicates_detected": report["duplicates"]["duplicate_count"],
        "outlier_cols_flagged": graded("outliers", {"none"}),
        "schema_drift_detected": report["schema_drift"]["drift_detected"],
        "skew_cols_flagged": graded("skew", {"none", "low", "unknown"}),
    }
