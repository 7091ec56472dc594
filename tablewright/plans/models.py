"""Raw-versus-cleaned model comparison with Spark ML."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.draws import row_identity, uniform
from ..operators import moments, scores
from ..operators.categories import category_index, sparse_vectors
from ..operators.features import (
    FEATURES, HASH_BUCKETS, LABEL_INDEX, class_count, feature_stages, label_classes, label_indexer, split_label_indexers,
)
from ..operators.labels import MAX_LABEL_CLASSES
from ..sources.storage import StoredTable, materialise

Metrics = dict[str, Any]
_PREDICTION, _WEIGHT = "prediction", "__weight"
_MAX_ITERATIONS, _TOLERANCE = 50, 1e-6
_SPLITS_AT_ONCE = 60
#: Splits fitted side by side: a fit is many short jobs, which alone leave cores idle.
_FITS_AT_ONCE = 3


@dataclass
class MLEvaluationResult:
    raw_metrics: Metrics
    cleaned_metrics: Metrics
    delta: Metrics

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per metric: raw, cleaned, delta."""
        rows = [
            (m, *[None if side.get(m) is None else float(side[m]) for side in self._sides()])
            for m in self.delta
        ]
        return spark.createDataFrame(rows, "metric string, raw double, cleaned double, delta double")

    def _sides(self) -> tuple[Metrics, Metrics, Metrics]:
        return self.raw_metrics, self.cleaned_metrics, self.delta


def summarize_folds(folds: Sequence[Metrics], names: Iterable[str]) -> Metrics:
    """Mean, population deviation, minimum and maximum of each metric over repeats."""

    def summary(name: str) -> Metrics | None:
        values = [f[name] for f in folds if f.get(name) is not None]
        if not values:
            return None
        parts = {"mean": fmean(values), "stddev": pstdev(values), "min": min(values), "max": max(values)}
        return {k: round(v, 4) for k, v in parts.items()}

    return {"folds": list(folds), "summary": {n: summary(n) for n in names}}


class _Comparison:
    """What both comparisons share: complete rows, split, fit, score, repeat.

    Rows go to training or test by a hash of ``id_columns``, or of the whole row
    where none are given. ``encoding`` ("index" or "hash") says how text becomes
    features, the same for every table that is compared.
    """

    metric_names: tuple[str, ...] = ()
    stability_names: tuple[str, ...] = ()
    numeric_label = False

    def __init__(
        self,
        seed: int = 42,
        train_fraction: float = 0.8,
        validation_folds: int = 1,
        id_columns: Sequence[str] = (),
        encoding: str = "index",
        hash_buckets: int = HASH_BUCKETS,
        max_label_classes: int = MAX_LABEL_CLASSES,
        iterations: int = _MAX_ITERATIONS,
        tolerance: float = _TOLERANCE,
    ):
        if not 0 < train_fraction < 1:
            raise ValueError("A train_fraction lies strictly between 0 and 1.")
        if validation_folds < 1:
            raise ValueError("At least one of validation_folds is needed.")
        self.iterations, self.tolerance = iterations, tolerance
        self.encoding = encoding
        self.hash_buckets = hash_buckets
        self.max_label_classes = max_label_classes
        self.seed = seed
        self.train_fraction = train_fraction
        self.validation_folds = validation_folds
        self.id_columns = list(id_columns)

    def compare(
        self, raw_df: DataFrame, cleaned_df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str],
        raw_metrics: Metrics | None = None,
    ) -> MLEvaluationResult:
        """Scores of both tables; ``raw_metrics`` are those of this raw table from an earlier comparison with the same arguments."""
        raw = self.evaluate_one(raw_df, label, numeric, categorical) if raw_metrics is None else raw_metrics
        cleaned = raw if cleaned_df is raw_df else self.evaluate_one(cleaned_df, label, numeric, categorical)
        return MLEvaluationResult(raw, cleaned, metric_deltas(raw, cleaned, self.metric_names))

    def evaluate_one(
        self, df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str]
    ) -> Metrics:
        """Scores of one table, with fold stability when folds are asked for."""
        rows = scores.modelling_rows(
            df, numeric, categorical, label, self.numeric_label, self.id_columns
        )
        classes = None if self.numeric_label else class_count(rows, label, self.max_label_classes)
        if classes == 0 or self.numeric_label and rows.isEmpty():
            raise ValueError("The table has no complete row to train on.")
        if classes is not None and classes > self.max_label_classes:
            raise ValueError(f"Label {label!r} has more than {self.max_label_classes} values (max_label_classes).")
        seeds = [self.seed]
        if self.validation_folds > 1:
            seeds += [self.seed + fold for fold in range(1, self.validation_folds + 1)]
        identity = row_identity(rows, self.id_columns)
        found = []
        for k in range(0, len(seeds), _SPLITS_AT_ONCE):
            training = [uniform(seed, *identity) < self.train_fraction for seed in seeds[k : k + _SPLITS_AT_ONCE]]
            stored = self._stored(rows.withColumn(moments.SPLITS, moments.split_mask(training)), label, numeric, categorical)
            try:
                found += self._splits(stored.df, label, numeric, categorical, len(training))
            finally:
                stored.drop()
        metrics, again = found[0], found[1:]
        folds = [{"fold": i} | {n: m[n] for n in self.stability_names} for i, m in enumerate(again, 1)]
        metrics["fold_stability"] = summarize_folds(folds, self.stability_names) if folds else None
        return metrics

    def _stored(self, rows: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str]) -> StoredTable:
        """Rows with ``moments.SPLITS`` in the form that is fitted."""
        return materialise(rows, "training")

    def _splits(self, rows: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], splits: int) -> list[Metrics]:
        """Scores of each split of stored rows, which are vectors where text is numbered."""
        if self.numeric_label:
            sums, indexers = moments.split_sums(rows, label, [], splits), [None] * splits
        else:
            sums, indexers = split_label_indexers(rows, label, [moments.trains(f) for f in range(splits)])
        counts = self._counts(sums)

        def scored(split: int) -> Metrics:
            return self._fit_and_score(rows, label, numeric, categorical, split, indexers[split])

        with ThreadPool(min(_FITS_AT_ONCE, splits)) as pool:
            found = pool.map(inheritable_thread_target(rows.sparkSession)(scored), range(splits), chunksize=1)
        return [c | m for c, m in zip(counts, found)]

    def _counts(self, sums: dict) -> list[Metrics]:
        counts = [{"ml_row_count": sums["rows"], "train_row_count": n, "test_row_count": sums["rows"] - n} for n in sums["training"]]
        if any(c["train_row_count"] == 0 or c["test_row_count"] == 0 for c in counts):
            raise ValueError("The split leaves training or test without rows; more rows or another train_fraction help.")
        return [c | {"encoding": self.encoding} for c in counts]

    def _fit_and_score(self, rows, label, numeric, categorical, split: int, indexer: StringIndexerModel | None) -> Metrics:
        features = [] if self.encoding == "index" else feature_stages(numeric, categorical, self.encoding, self.hash_buckets)
        train, test = rows.filter(moments.trains(split)), rows.filter(~moments.trains(split))
        return self._score(self._fit(train, label, features, bool(numeric), indexer).transform(test), label)

    def _fit(
        self, train: DataFrame, label: str, features: list, numbers: bool, indexer: StringIndexerModel | None = None
    ) -> PipelineModel:
        return Pipeline(stages=self._stages(label, features, indexer)).fit(train)

    def _stages(self, label: str, features: list, indexer: StringIndexerModel | None) -> list:
        raise NotImplementedError

    def _score(self, predictions: DataFrame, label: str) -> Metrics:
        raise NotImplementedError


def metric_deltas(raw: Metrics, cleaned: Metrics, names: Iterable[str]) -> Metrics:
    """Cleaned minus raw per metric, None where either side has none."""
    deltas = {}
    for name in names:
        before, after = raw.get(name), cleaned.get(name)
        deltas[name] = None if before is None or after is None else round(after - before, 4)
    return deltas | {"ml_row_count": cleaned["ml_row_count"] - raw["ml_row_count"]}


class SparkMLClassificationEvaluator(_Comparison):
    """Logistic regression on the raw and on the cleaned table."""

    metric_names = ("accuracy", "f1", "auc", "weighted_precision", "weighted_recall")
    stability_names = ("accuracy", "f1", "auc")

    def evaluate_logistic_regression(
        self,
        raw_df: DataFrame,
        cleaned_df: DataFrame,
        label_col: str,
        numeric_cols: Sequence[str],
        categorical_cols: Sequence[str],
    ) -> MLEvaluationResult:
        return self.compare(raw_df, cleaned_df, label_col, numeric_cols, categorical_cols)

    def _stored(self, rows: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str]) -> StoredTable:
        """Feature vectors where text is numbered; the values are those of all rows, so a value may be new to a split's fit."""
        if self.encoding != "index":
            return super()._stored(rows, label, numeric, categorical)
        index = category_index(rows, categorical)
        try:
            return sparse_vectors(rows, numeric, index, [label, moments.SPLITS], FEATURES)
        finally:
            index.drop()

    def _stages(self, label: str, features: list, indexer: StringIndexerModel | None) -> list:
        model = LogisticRegression(
            featuresCol=FEATURES,
            labelCol=LABEL_INDEX,
            predictionCol=_PREDICTION,
            maxIter=self.iterations,
            tol=self.tolerance,
            regParam=0.0,
            elasticNetParam=0.0,
        )
        return [indexer or label_indexer(label), *features, model]

    def _fit(
        self, train: DataFrame, label: str, features: list, numbers: bool, indexer: StringIndexerModel | None = None
    ) -> PipelineModel:
        """Where all features are numbered text, equal rows are one with their number as weight: the same likelihood, few rows a step."""
        if numbers or features:
            return super()._fit(train, label, features, numbers, indexer)
        stage, model = self._stages(label, features, indexer)
        named = indexer or stage.fit(train)
        groups = named.transform(train).groupBy(LABEL_INDEX, FEATURES).agg(F.count(F.lit(1)).cast("double").alias(_WEIGHT))
        return PipelineModel([named, model.setWeightCol(_WEIGHT).fit(groups)])

    def class_probabilities(
        self, df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], carried: Sequence[str] = ()
    ) -> DataFrame:
        """The carried columns, class and its probability, for each complete row and each class of a fit on all of them.

        The result reads a stored table of vectors in the shared folder.
        """
        rows = scores.modelling_rows(df, numeric, categorical, label, False, carried)
        index = category_index(rows, categorical)
        try:
            vectors = sparse_vectors(rows, numeric, index, list(dict.fromkeys([label, *carried])), FEATURES)
        finally:
            index.drop()
        model = self._fit(vectors.df, label, [], bool(numeric))
        chances = vector_to_array(F.col("probability"))
        each = [F.struct(F.lit(c).alias("class"), chances[i].alias("probability")) for i, c in enumerate(label_classes(model))]
        return model.transform(vectors.df).select(*map(col, carried), F.inline(F.array(*each)))

    def _score(self, predictions: DataFrame, label: str) -> Metrics:
        row = scores.classification_scores(predictions, LABEL_INDEX, _PREDICTION, label_classes=True).first()
        names = ("accuracy", "f1", "weighted_precision", "weighted_recall")
        metrics = {n: round(row[n], 4) for n in names}
        if row["label_classes"] != 2:
            return metrics | {"auc": None}
        area = BinaryClassificationEvaluator(
            labelCol=LABEL_INDEX, rawPredictionCol="rawPrediction", metricName="areaUnderROC"
        )
        return metrics | {"auc": round(area.evaluate(predictions), 4)}


class SparkMLRegressionEvaluator(_Comparison):
    """Linear regression on the raw and on the cleaned table."""

    metric_names = stability_names = ("rmse", "mae", "r2")
    numeric_label = True

    def evaluate_linear_regression(
        self,
        raw_df: DataFrame,
        cleaned_df: DataFrame,
        label_col: str,
        numeric_cols: Sequence[str],
        categorical_cols: Sequence[str],
        raw_metrics: Metrics | None = None,
    ) -> MLEvaluationResult:
        return self.compare(raw_df, cleaned_df, label_col, numeric_cols, categorical_cols, raw_metrics)

    def _stages(self, label: str, features: list, indexer: StringIndexerModel | None) -> list:
        model = LinearRegression(
            featuresCol=FEATURES,
            labelCol=label,
            predictionCol=_PREDICTION,
            maxIter=self.iterations,
            tol=self.tolerance,
            regParam=0.0,
            elasticNetParam=0.0,
        )
        return [*features, model]

    def _splits(self, rows: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str], splits: int) -> list[Metrics]:
        """All splits from the same sums of products, unless there are too many features or text is hashed."""
        if self.encoding != "index":
            return super()._splits(rows, label, numeric, categorical, splits)
        index = category_index(rows, categorical)
        try:
            if len(numeric) + sum(index.sizes.values()) > moments.MOST_FEATURES:
                vectors = sparse_vectors(rows, numeric, index, [label, moments.SPLITS], FEATURES)
                try:
                    return super()._splits(vectors.df, label, numeric, categorical, splits)
                finally:
                    vectors.drop()
            _, found, sums = moments.fit_splits(rows, label, numeric, index, splits)
        finally:
            index.drop()
        rounded = [{n: None if m[n] is None else round(m[n], 4) for n in self.metric_names} for m in found]
        return [c | m for c, m in zip(self._counts(sums), rounded)]

    def _score(self, predictions: DataFrame, label: str) -> Metrics:
        row = scores.regression_scores(predictions, label, _PREDICTION).first()
        return {n: None if row[n] is None else round(row[n], 4) for n in self.metric_names}


def compare_conditions(
    evaluator: _Comparison,
    conditions: dict[str, DataFrame],
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
) -> DataFrame:
    """One row per condition, its scores and their distance from the first one's.

    Usual conditions are the raw table, the same table after detection only, the
    policy's repair and a hand-written one. A table that occurs twice is fitted
    once.
    """
    fitted: dict[int, Metrics] = {}
    rows, base = [], None
    for name, df in conditions.items():
        if id(df) not in fitted:
            fitted[id(df)] = evaluator.evaluate_one(df, label, numeric, categorical)
        metrics = fitted[id(df)]
        base = base or metrics
        deltas = metric_deltas(base, metrics, evaluator.metric_names)
        values = [metrics[m] for m in evaluator.metric_names] + [deltas[m] for m in evaluator.metric_names]
        rows.append((name, metrics["ml_row_count"], *values))
    columns = ["condition string", "ml_row_count bigint"]
    columns += [f"{m} double" for m in evaluator.metric_names]
    columns += [f"{m}_delta double" for m in evaluator.metric_names]
    spark = next(iter(conditions.values())).sparkSession
    return spark.createDataFrame(rows, ", ".join(columns))
