"""The repair policy: what to repair, and how. No dataset is named in it."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from ..operators.features import ENCODINGS
from ..operators.labels import MAX_LABEL_CLASSES

# The strategies a policy may name.
NUMERIC_FILLS = ("median", "mean", "mode")
CATEGORICAL_FILLS = ("constant", "mode")
OUTLIER_STRATEGIES = ("cap", "none")
DUPLICATE_STRATEGIES = ("exact", "key")
LABEL_STRATEGIES = ("none", "model")
SKEW_STRATEGIES = ("none", "repartition")


@dataclass(frozen=True)
class RepairPolicy:
    """Settings for one repair. All are plain values, so a policy can be logged.

    ``row_filters`` drops rows whose column is missing or outside (min, max).
    ``cap_limits`` tightens the outlier bounds of a column to (min, max). Either
    end may be None. The label is never capped unless ``cap_label`` is set.
    """

    missingness_threshold: float = 0.0
    numeric_imputation: str = "median"
    categorical_imputation: str = "constant"
    categorical_fill_value: str = "unknown"
    drop_duplicates: bool = True
    duplicate_strategy: str = "exact"
    outlier_strategy: str = "cap"
    outlier_column_strategies: dict[str, str] = field(default_factory=dict)
    repair_outlier_severities: tuple[str, ...] = ("low", "high")
    align_schema: bool = True
    drop_added_columns: bool = False
    label_imputation: str = "none"
    label_confidence_threshold: float = 0.0
    label_min_training_rows: int = 20
    label_encoding: str = "index"
    max_label_classes: int = MAX_LABEL_CLASSES
    skew_strategy: str = "none"
    repair_skew_severities: tuple[str, ...] = ("high",)
    skew_target_partitions: int | None = None
    skip_imputation: bool = False
    cap_label: bool = False
    exact_quantiles: bool = True
    row_filters: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    cap_limits: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def validate(self) -> None:
        choices = {
            "numeric_imputation": NUMERIC_FILLS,
            "categorical_imputation": CATEGORICAL_FILLS,
            "outlier_strategy": OUTLIER_STRATEGIES,
            "label_imputation": LABEL_STRATEGIES,
            "skew_strategy": SKEW_STRATEGIES,
            "label_encoding": ENCODINGS,
        }
        if self.drop_duplicates:
            choices["duplicate_strategy"] = DUPLICATE_STRATEGIES
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(map(repr, allowed))}.")
        odd = {c: s for c, s in self.outlier_column_strategies.items() if s not in OUTLIER_STRATEGIES}
        if odd:
            raise ValueError(
                "Unsupported outlier_column_strategies. Expected each column strategy to be "
                f"one of: {', '.join(map(repr, OUTLIER_STRATEGIES))}. Got: {odd}"
            )
        target = self.skew_target_partitions
        if self.skew_strategy != "none" and target is not None and target <= 0:
            raise ValueError("skew_target_partitions must be a positive integer.")

    def changed_fields(self) -> list[str]:
        """Names of the settings that differ from the defaults."""
        default = RepairPolicy()
        return [f.name for f in fields(self) if getattr(self, f.name) != getattr(default, f.name)]
