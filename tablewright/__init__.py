"""Data quality for Spark tables: profile, repair, compare, repeat."""

from .plans.cycle import CleaningCycle, CleaningResult
from .plans.evaluation import (
    DataQualityEvaluation,
    DataQualityEvaluator,
    OPEXMetrics,
    build_opex_metrics,
)
from .plans.loop import PDSAConfig, PDSAIterationRecord, PDSALoop, PDSAResult
from .plans.models import (
    MLEvaluationResult,
    SparkMLClassificationEvaluator,
    SparkMLRegressionEvaluator,
)
from .plans.policy import RepairPolicy
from .plans.profiler import DataProfiler
from .plans.repair import RepairEngine, RepairResult
from .plans.report import EvaluationReport, EvaluationReportBuilder
from .plans.synthetic import SyntheticDataGenerator, SyntheticDataset, SyntheticIssueConfig
from .sources.runlog import ExperimentLogger

__all__ = [
    "CleaningCycle",
    "CleaningResult",
    "DataProfiler",
    "DataQualityEvaluation",
    "DataQualityEvaluator",
    "EvaluationReport",
    "EvaluationReportBuilder",
    "ExperimentLogger",
    "MLEvaluationResult",
    "OPEXMetrics",
    "PDSAConfig",
    "PDSAIterationRecord",
    "PDSALoop",
    "PDSAResult",
    "RepairEngine",
    "RepairPolicy",
    "RepairResult",
    "SparkMLClassificationEvaluator",
    "SparkMLRegressionEvaluator",
    "SyntheticDataGenerator",
    "SyntheticDataset",
    "SyntheticIssueConfig",
    "build_opex_metrics",
]
