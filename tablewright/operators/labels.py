"""Label statistics, label-noise estimate and model-based label repair."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Snapshot, col, is_numeric, is_present, is_text, ratio
from ..functions.draws import row_hash
from ..sources.storage import (
    COPIES, MARK, SINGLE_ROWS, WEIGHT, StoredTable, count_copies, materialise, store_distinct, training_runs,
)
from .bins import Bins, find_bins
from .categories import CategoryIndex, category_index, with_ranks
from .features import (
    ENCODINGS, FEATURES, HASH_BUCKETS, LABEL_INDEX, complete_rows, has_more_classes, label_classes, label_numbers,
)
from .outliers import drifted_from_number
from .schemas import cast_to

_PREDICTION, _PROBABILITY, _RAW = "__prediction", "__probability", "__raw"
_CONFIDENCE = "__confidence"

# Fixed values of the forests: the same trees, depth and seed in every run.
TREES, SEED, NOISE_DEPTH = 50, 42, 5

#: Labels with more values are not fitted: each is a class of every tree and an entry on the driver.
MAX_LABEL_CLASSES = 100
_FOLD = "__fold"


def label_stats(df: DataFrame, label: str) -> DataFrame:
    """One row: rows, null labels, and distinct labels with null counted as one.

    Labels are grouped first, so a dominant label leaves each task as one row
    and a label with very many values needs no value set in memory.
    """
    groups = df.groupBy(col(label).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("label_null_count"),
        F.count(F.lit(1)).alias("distinct_label_count"),
    ).withColumn("label_null_ratio", ratio(F.col("label_null_count"), F.col("row_count")))


@dataclass(frozen=True)
class FeatureColumns:
    numeric: tuple[str, ...]
    text: tuple[str, ...]
    restored: tuple[str, ...] = ()

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.text]


def feature_columns(df: DataFrame, label: str, reference: Snapshot | None = None) -> FeatureColumns:
    """Usable features: numbers and text, with drifted text read as numbers again."""
    fields = [f for f in df.schema.fields if f.name != label]
    restored = [f.name for f in fields if drifted_from_number(f.name, f.dataType, reference)]
    numeric = [f.name for f in fields if is_numeric(f.dataType)] + restored
    text = [f.name for f in fields if is_text(f.dataType) and f.name not in restored]
    return FeatureColumns(tuple(sorted(numeric)), tuple(sorted(text)), tuple(sorted(restored)))


def restore_types(df: DataFrame, features: FeatureColumns, reference: Snapshot | None) -> DataFrame:
    return df.withColumns(
        {c: cast_to(col(c), str(reference[c]["data_type"])) for c in features.restored}
    ) if features.restored else df


class TextNumbers:
    """Text features as numbers, for trees: one feature a column, however many values it has.

    With encoding "index" the number is the value's place in its column's order by
    frequency. The order is a stored table, not a list on the driver, and rows get
    their numbers by a join; values it does not have come after all others. With
    "hash" it is one of ``HASH_BUCKETS`` buckets, and nothing is stored. A tree
    splits either order wherever it likes.
    """

    def __init__(self, rows: DataFrame, features: FeatureColumns, encoding: str):
        if encoding not in ENCODINGS:
            raise ValueError(f"encoding is one of {', '.join(ENCODINGS)}; {encoding!r} was given.")
        self.features = features
        self.names = {c: f"__number_{i}" for i, c in enumerate(features.text)}
        self.index: CategoryIndex | None = category_index(rows, features.text) if encoding == "index" and self.names else None

    def add_to(self, df: DataFrame) -> DataFrame:
        if not self.names:
            return df
        if self.index is None:
            return df.withColumns({n: F.pmod(F.xxhash64(col(c)), F.lit(HASH_BUCKETS)) for c, n in self.names.items()})
        numbered = with_ranks(df, self.index, self.names)
        return numbered.withColumns({n: F.coalesce(n, F.lit(self.index.sizes[c])) for c, n in self.names.items()})

    @property
    def inputs(self) -> list[str]:
        """The features of rows with numbers."""
        return [*self.features.numeric, *self.names.values()]

    def drop(self) -> None:
        """Delete the order. Frames with numbers must be stored before."""
        if self.index is not None:
            self.index.drop()


@dataclass(frozen=True)
class ForestRows:
    """Stored training rows of a forest: the different ones with their number and fold.

    Beyond ``SINGLE_ROWS`` rows the features are in bins before rows are counted, so
    that the work of a forest follows the different rows of bins, not the rows.
    """

    stored: StoredTable
    rows: int
    label: str
    inputs: tuple[str, ...]
    bins: Bins | None

    def features_of(self, df: DataFrame) -> DataFrame:
        """Rows with numbers as the forest takes them."""
        return df if self.bins is None else self.bins.add_to(df)

    def runs(self, rows: DataFrame) -> DataFrame:
        return training_runs(rows, self.rows)


def store_forest_rows(df: DataFrame, label: str, inputs: Sequence[str], folds: int = 1) -> ForestRows:
    """Store the rows, which fall into folds by a hash of their features and label, whatever bins these are in."""
    kept = [*inputs, label]
    stored = store_distinct(df.select(*map(col, kept)))
    rows = count_copies(stored.df)
    fold = F.pmod(row_hash(stored.df.select(*map(col, kept)), SEED), F.lit(folds))
    distinct = stored.df.withColumn(_FOLD, fold)
    if rows <= SINGLE_ROWS:
        return ForestRows(StoredTable(stored.path, distinct), rows, label, tuple(inputs), None)
    try:
        bins = find_bins(stored.df, inputs, rows)
        names = [*bins.names.values(), label, _FOLD]
        counted = bins.add_to(distinct).groupBy(*map(col, names)).agg(F.sum(COPIES).alias(COPIES))
        binned = materialise(counted.withColumn(MARK, row_hash(counted.drop(COPIES))), "binned")
    finally:
        stored.drop()
    return ForestRows(binned, rows, label, tuple(bins.names.values()), bins)


def fit_forest(training: ForestRows, depth: int | None, without: int | None = None) -> PipelineModel:
    """A forest on all rows, or on those of all folds but one."""
    forest = RandomForestClassifier(
        featuresCol=FEATURES,
        labelCol=LABEL_INDEX,
        predictionCol=_PREDICTION,
        probabilityCol=_PROBABILITY,
        rawPredictionCol=_RAW,
        weightCol=WEIGHT,
        numTrees=TREES,
        seed=SEED,
    )
    if depth is not None:
        forest.setMaxDepth(depth)
    rows = training.stored.df if without is None else training.stored.df.filter(F.col(_FOLD) != without)
    indexer = label_numbers(rows, training.label, COPIES)
    assembler = VectorAssembler(inputCols=list(training.inputs), outputCol=FEATURES)
    return Pipeline(stages=[indexer, assembler, forest]).fit(training.runs(rows))


def with_confidence(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn(_CONFIDENCE, F.array_max(vector_to_array(F.col(_PROBABILITY))))


@dataclass(frozen=True)
class NoiseEstimate:
    rows_used: int
    suspected: int = 0
    average_confidence: float | None = None
    low_confidence: int = 0
    features: FeatureColumns = FeatureColumns((), ())
    too_many_classes: bool = False


def estimate_label_noise(
    df: DataFrame,
    label: str,
    threshold: float = 0.65,
    min_rows: int = 30,
    reference: Snapshot | None = None,
    encoding: str = "index",
    max_classes: int = MAX_LABEL_CLASSES,
    folds: int = 1,
) -> NoiseEstimate | None:
    """Fit a forest on the complete labelled rows and count confident disagreements.

    With one fold the forest scores the rows it was trained on. With more, rows
    fall into folds by their hash, and each fold is scored by a forest that has
    seen the others only; copies of a row share a fold. Returns None without
    features, and an estimate without scores when there are fewer rows than
    ``min_rows`` or more classes than ``max_classes``.
    """
    features = feature_columns(df, label, reference)
    if not features.all:
        return None
    labelled = df.filter(col(label).isNotNull()).select(*map(col, [*features.all, label]))
    training = complete_rows(restore_types(labelled, features, reference), features.all)
    rows = training.count()
    if rows < min_rows:
        return NoiseEstimate(rows, features=features)
    if has_more_classes(training, label, max_classes):
        return NoiseEstimate(rows, features=features, too_many_classes=True)
    numbers = TextNumbers(training, features, encoding)
    try:
        forest_rows = store_forest_rows(numbers.add_to(training), label, numbers.inputs, folds)
    finally:
        numbers.drop()
    try:
        counts = _disagreements(_scored(forest_rows, folds), threshold)
    finally:
        forest_rows.stored.drop()
    return NoiseEstimate(rows, counts["suspected"], counts["average"], counts["low"], features)


def _scored(training: ForestRows, folds: int) -> list[DataFrame]:
    """The different rows of each fold with their number, scored."""
    rows = training.stored.df
    if folds == 1:
        return [with_confidence(fit_forest(training, NOISE_DEPTH).transform(rows))]
    return [
        with_confidence(fit_forest(training, NOISE_DEPTH, fold).transform(rows.filter(F.col(_FOLD) == fold))) for fold in range(folds)
    ]


def _disagreements(scored: Sequence[DataFrame], threshold: float) -> dict:
    """Counts over all folds. A label no other fold has seen has no index and is left out."""
    wrong = F.col(LABEL_INDEX) != F.col(_PREDICTION)
    parts = [
        part.agg(
            _copies_where(wrong & (F.col(_CONFIDENCE) >= threshold)).alias("suspected"),
            F.sum(F.col(_CONFIDENCE).cast("decimal(18,15)") * F.col(COPIES).cast("decimal(18,0)")).alias("sure"),  # in any order the same
            _copies_where(F.col(_CONFIDENCE).isNotNull()).alias("n"),
            _copies_where(F.col(_CONFIDENCE) < threshold).alias("low"),
        ).first()
        for part in scored
    ]
    n = sum(p["n"] for p in parts)
    return {
        "suspected": sum(p["suspected"] for p in parts),
        "average": float(sum(p["sure"] or 0 for p in parts)) / n if n else None,
        "low": sum(p["low"] for p in parts),
    }


def _copies_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(COPIES))), F.lit(0))


@dataclass(frozen=True)
class LabelFill:
    """The repaired table, and the counts (or the reason for leaving it alone)."""

    df: DataFrame
    reason: str | None = None
    training_rows: int = 0
    candidates: int = 0
    imputed: int = 0


NO_FEATURES = "The table has no number or text column to learn from."
FEW_ROWS = "Too few complete rows carry a label."
NO_CANDIDATES = "No row without a label has all its features."
NO_CLASSES = "The training rows gave no classes."
MANY_CLASSES = "The label has more values than max_label_classes allows."


def impute_labels(
    df: DataFrame,
    label: str,
    confidence: float = 0.0,
    min_training_rows: int = 20,
    encoding: str = "index",
    max_classes: int = MAX_LABEL_CLASSES,
) -> LabelFill:
    """Predict missing labels of complete rows and write back the confident ones.

    Rows are split by whether they are candidates and put together again, so no
    row id and no join are needed: every row passes through exactly one branch.
    The predicted rows are stored, so that counting them does not predict twice.
    """
    features = feature_columns(df, label)
    if not features.all:
        return LabelFill(df, NO_FEATURES)
    has_label = col(label).isNotNull()
    complete = _complete(df, features.all)
    counted = df.agg(
        F.count_if(has_label & complete).alias("training"),
        F.count_if(~has_label & complete).alias("candidates"),
    ).first()
    training_rows, candidates = counted["training"], counted["candidates"]
    if training_rows < min_training_rows:
        return LabelFill(df, FEW_ROWS, training_rows)
    if candidates == 0:
        return LabelFill(df, NO_CANDIDATES, training_rows)
    training = df.filter(has_label & complete).select(*map(col, [*features.all, label]))
    if has_more_classes(training, label, max_classes):
        return LabelFill(df, MANY_CLASSES, training_rows, candidates)
    numbers = TextNumbers(training, features, encoding)
    try:
        forest_rows = store_forest_rows(numbers.add_to(training), label, numbers.inputs)
        try:
            model = fit_forest(forest_rows, None)
        finally:
            forest_rows.stored.drop()
        classes = label_classes(model)
        if not classes:
            return LabelFill(df, NO_CLASSES, training_rows, candidates)
        open_rows = ~has_label & complete
        names = F.array(*[F.lit(c) for c in classes])
        chosen = F.when(
            F.col(_CONFIDENCE) >= confidence,
            F.element_at(names, (F.col(_PREDICTION) + 1).cast("int")),
        ).cast(df.schema[label].dataType)
        # The indexer skips rows without a label, so candidates carry a stand-in.
        stand_in = numbers.add_to(df.filter(open_rows).withColumn(label, F.lit(classes[0])))
        predicted = with_confidence(model.transform(forest_rows.features_of(stand_in))).withColumn(label, chosen)
        predicted = materialise(predicted.select(*map(col, df.columns)), "imputed").df
    finally:
        numbers.drop()
    imputed = predicted.agg(F.count(col(label))).first()[0]
    repaired = df.filter(~open_rows).unionByName(predicted)
    return LabelFill(repaired, None, training_rows, candidates, imputed)


def _complete(df: DataFrame, columns: Sequence[str]):
    types = {f.name: f.dataType for f in df.schema.fields}
    complete = F.lit(True)
    for c in columns:
        complete = complete & is_present(col(c), types[c])
    return complete


def label_recovery(cleaned: DataFrame, truth: DataFrame, key: str, label: str) -> DataFrame:
    """One row: how many labels are there, and how many equal the true ones."""
    true_label = truth.select(col(key).alias("__k"), col(label).alias("__true"))
    joined = cleaned.join(true_label, col(key) == F.col("__k"), "inner")
    counted = joined.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(col(label)).alias("labeled_rows"),
        F.count_if(col(label) == F.col("__true")).alias("correct_rows"),
    )
    accuracy = F.try_divide(F.col("correct_rows").cast("double"), F.col("labeled_rows").cast("double"))
    return counted.select(
        "total_rows",
        "labeled_rows",
        (F.col("total_rows") - F.col("labeled_rows")).alias("remaining_missing"),
        ratio(F.col("labeled_rows"), F.col("total_rows")).alias("coverage_ratio"),
        "correct_rows",
        accuracy.alias("accuracy"),
    )
