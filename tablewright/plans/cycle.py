"""One cleaning cycle: profile, repair, profile again, evaluate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from copy import deepcopy
from dataclasses import dataclass
from time import perf_counter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.storage import StoredTable, materialise
from .evaluation import DataQualityEvaluator, build_opex_metrics
from .policy import RepairPolicy
from .profiler import DataProfiler, profile_after
from .repair import RepairEngine


@dataclass
class CleaningResult:
    raw_profile: dict[str, Any]
    cleaned_profile: dict[str, Any]
    evaluation: dict[str, Any]
    opex_metrics: dict[str, Any]
    repair_actions: list[dict[str, Any]]
    cleaned_df: DataFrame
    repair_policy: RepairPolicy | None = None
    stored: StoredTable | None = None

    def close(self) -> None:
        """Delete the stored table behind ``cleaned_df``, which must not be used afterwards."""
        if self.stored is not None:
            self.stored.drop()
            self.stored = None

    def __enter__(self) -> CleaningResult:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class CleaningCycle:
    """Runs one policy over one table and reports what changed.

    The cleaned table is profiled and then used, so by default it is written to
    the shared checkpoint folder once: otherwise each of those scans would
    repeat the repair and its deduplication shuffle.
    """

    def __init__(
        self,
        profiler: DataProfiler | None = None,
        repair_engine: RepairEngine | None = None,
        repair_policy: RepairPolicy | None = None,
        evaluator: DataQualityEvaluator | None = None,
        materialise_cleaned: bool = True,
    ):
        self.profiler = profiler or DataProfiler()
        self.repair_engine = repair_engine or RepairEngine(repair_policy)
        self.evaluator = evaluator or DataQualityEvaluator()
        self.materialise_cleaned = materialise_cleaned

    def run(
        self,
        df: DataFrame,
        key_columns: Sequence[str] | None = None,
        reference_schema: T.StructType | Mapping | None = None,
        label_col: str | None = None,
        raw_profile: Mapping[str, Any] | None = None,
    ) -> CleaningResult:
        """Profile, repair, profile again, evaluate.

        ``raw_profile`` is a profile of this very table by the same profiler, keys,
        label and reference schema, as an earlier cycle over it has made one; the
        table is then not profiled again before the repair.
        """
        marks = [perf_counter()]

        def lap() -> float:
            marks.append(perf_counter())
            return marks[-1] - marks[-2]

        context = {
            "key_columns": key_columns,
            "reference_schema": reference_schema,
            "label_col": label_col,
        }
        raw = self.profiler.profile(df, **context) if raw_profile is None else deepcopy(dict(raw_profile))
        raw_seconds = lap()
        repaired = self.repair_engine.repair(df, raw, **context)
        stored = materialise(repaired.cleaned_df, "cleaned") if self.materialise_cleaned else None
        cleaned_df = stored.df if stored else repaired.cleaned_df
        repair_seconds = lap()
        try:
            if stored:
                cleaned = profile_after(self.profiler, raw, cleaned_df, repaired.rewritten, **context)
            else:
                cleaned = self.profiler.profile(cleaned_df, **context)
        except BaseException:
            if stored:
                stored.drop()
            raise
        cleaned_seconds = lap()
        evaluation = self.evaluator.evaluate(raw, cleaned, repaired.actions).metrics
        evaluation_seconds = lap()
        return CleaningResult(
            raw_profile=raw,
            cleaned_profile=cleaned,
            evaluation=evaluation,
            opex_metrics=build_opex_metrics(
                raw_profile=raw,
                cleaned_profile=cleaned,
                evaluation=evaluation,
                raw_profile_time_seconds=raw_seconds,
                repair_time_seconds=repair_seconds,
                cleaned_profile_time_seconds=cleaned_seconds,
                evaluation_time_seconds=evaluation_seconds,
                total_time_seconds=marks[-1] - marks[0],
            ),
            repair_actions=repaired.actions,
            cleaned_df=cleaned_df,
            repair_policy=self.repair_engine.policy,
            stored=stored,
        )
