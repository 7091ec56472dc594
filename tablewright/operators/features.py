"""Feature stages shared by every model this package fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_present

ENCODINGS = ("index", "hash")
HASH_BUCKETS = 4_096
FEATURES, LABEL_INDEX = "__features", "__label_index"


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have a value (not null, not NaN) in every given column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in columns:
        df = df.filter(is_present(col(c), types[c]))
    return df


def feature_stages(
    numeric: Sequence[str], categorical: Sequence[str], encoding: str = "index", buckets: int = HASH_BUCKETS
) -> list[Estimator | Transformer]:
    """Encode text columns, then assemble all features.

    ``encoding`` says how, whatever the data: "index" numbers the values of each
    column by frequency and makes them one-hot, with all values on the driver;
    "hash" spreads the values of all columns over ``buckets`` and holds nothing.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {', '.join(ENCODINGS)}; {encoding!r} was given.")
    stages, inputs, text = [], list(numeric), list(categorical)
    if text and encoding == "index":
        indexed = [f"__idx_{i}" for i in range(len(text))]
        encoded = [f"__vec_{i}" for i in range(len(text))]
        stages.append(StringIndexer(inputCols=text, outputCols=indexed, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"))
        inputs += encoded
    elif text:
        stages.append(FeatureHasher(inputCols=text, outputCol="__hashed", numFeatures=buckets))
        inputs.append("__hashed")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return stages


def label_indexer(label: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol=LABEL_INDEX, handleInvalid="skip")


def label_numbers(distinct: DataFrame, label: str, copies: str) -> StringIndexerModel:
    """What ``label_indexer`` finds, of different rows with their number; there are few classes."""
    counts = distinct.groupBy(col(label).cast("string").alias("v")).agg(F.sum(copies).alias("n"))
    names = [r["v"] for r in counts.filter("v IS NOT NULL").orderBy(F.desc("n"), "v").collect()]
    return StringIndexerModel.from_labels(names, inputCol=label, outputCol=LABEL_INDEX, handleInvalid="skip")


def split_label_indexers(df: DataFrame, label: str, training: Sequence[Column]) -> tuple[dict, list[StringIndexerModel]]:
    """What ``label_indexer`` finds in the training rows of each split, and the numbers of rows; one scan, there are few classes."""
    text = col(label).cast("string")
    found = df.groupBy(text).agg(F.count(F.lit(1)), *[F.count_if(t) for t in training]).collect()
    models = []
    for f in range(2, 2 + len(training)):
        # equally frequent classes are ordered as the library orders them
        names = sorted((r for r in found if r[f] and r[0] is not None), key=lambda r: (-r[f], r[0].encode()))
        models.append(StringIndexerModel.from_labels(
            [r[0] for r in names], inputCol=label, outputCol=LABEL_INDEX, handleInvalid="skip") if names else None)
    counts = {"rows": sum(r[1] for r in found), "training": [sum(r[f] for r in found) for f in range(2, 2 + len(training))]}
    return counts, models


def class_count(df: DataFrame, label: str, most: int) -> int:
    """How many values a label has, at most one more than ``most``."""
    return df.select(col(label)).distinct().limit(most + 1).count()


def has_more_classes(df: DataFrame, label: str, most: int) -> bool:
    """Whether a label has more values than ``most``; an index of them would lie on the driver."""
    return class_count(df, label, most) > most


def label_classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)
