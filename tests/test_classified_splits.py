"""Splits of a classified table: stored once, fitted side by side, scored as each would be alone."""

from functools import partial

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tablewright import SparkMLClassificationEvaluator
from tablewright.functions.draws import uniform
from tablewright.operators import categories, features
from tablewright.plans import models
from tablewright.sources import storage


def labelled(spark, classes):
    """Classes that follow the features in part; two of three are equally frequent."""
    rows = [(i, float(i * 37 % 101), float(i % 7), "abcd"[i % 4], "ynz"[(i + (i * 37 % 101 > 60)) % classes]) for i in range(1200)]
    rows += [(2000 + i, None if i % 2 else 1.0, 2.0, None, "y") for i in range(30)]
    return spark.createDataFrame(rows, "id long, x double, z double, t string, label string").repartition(5)


def alone(df, seed):
    """Scores of one split by the library's own stages."""
    rows = df.dropna(subset=["x", "z", "t", "label"])
    index = categories.category_index(rows, ["t"])
    trains = uniform(seed, F.col("id")) < 0.8
    vectors = categories.sparse_vectors(rows, ["x", "z"], index, ["id", "label"], features.FEATURES).df
    train, test = vectors.filter(trains), vectors.filter(~trains)
    model = LogisticRegression(featuresCol=features.FEATURES, labelCol=features.LABEL_INDEX, maxIter=50, tol=1e-6)
    scored = Pipeline(stages=[features.label_indexer("label"), model]).fit(train).transform(test)
    found = {n: MulticlassClassificationEvaluator(labelCol=features.LABEL_INDEX, metricName=m).evaluate(scored) for n, m in (
        ("accuracy", "accuracy"), ("f1", "f1"), ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall"))}
    area = BinaryClassificationEvaluator(labelCol=features.LABEL_INDEX).evaluate(scored) if len(model.fit(
        features.label_indexer("label").fit(train).transform(train)).interceptVector) == 1 else None
    return found | {"auc": area, "ml_row_count": rows.count(), "train_row_count": train.count(), "test_row_count": test.count()}


@pytest.mark.parametrize("classes", [2, 3])
def test_scores_are_those_of_each_split_alone(spark, classes):
    df = labelled(spark, classes)
    found = SparkMLClassificationEvaluator(validation_folds=4, id_columns=["id"]).evaluate_one(df, "label", ["x", "z"], ["t"])
    expected = alone(df, 42)
    assert (expected["auc"] is None) == (classes == 3)
    assert {n: found[n] for n in expected} == pytest.approx(expected, abs=1e-4)
    for fold in found["fold_stability"]["folds"]:
        expected = alone(df, 42 + fold["fold"])
        assert {n: fold[n] for n in ("accuracy", "f1", "auc")} == pytest.approx(
            {n: expected[n] for n in ("accuracy", "f1", "auc")}, abs=1e-4)


def test_only_vectors_are_stored(spark, monkeypatch):
    """Rows are stored once, in the form that is fitted, and predictions are not stored at all."""
    stored = []

    def noted(df, name="table"):
        stored.append(name)
        return storage.materialise(df, name)

    monkeypatch.setattr(models, "materialise", noted)
    monkeypatch.setattr(categories, "materialise", noted)
    SparkMLClassificationEvaluator(validation_folds=2, id_columns=["id"]).evaluate_one(labelled(spark, 3), "label", ["x", "z"], ["t"])
    assert sorted(stored) == ["categories", "category-index", "vectors"]


def test_label_numbers_of_all_splits_are_the_librarys(spark):
    """Equally frequent classes too."""
    values = ["\U0001f600", "～", "b", "a", "", None]
    df = spark.createDataFrame([(i, values[i % 6], i % 3 * 1.5) for i in range(120)], "id int, t string, n double").repartition(3)
    training = [F.col("id") >= 0, F.col("id") % 6 != 3, F.col("id") > 13, F.col("id") < 0]
    for label in ("t", "n"):
        counts, found = features.split_label_indexers(df, label, training)
        assert counts == {"rows": 120, "training": [df.filter(t).count() for t in training]}
        assert found[3] is None
        for t, model in zip(training, found[:3]):
            assert list(model.labels) == list(features.label_indexer(label).fit(df.filter(t)).labels)


@pytest.mark.parametrize("encoding", features.ENCODINGS)
def test_errors_stay(spark, encoding):
    df = labelled(spark, 3)
    make = partial(SparkMLClassificationEvaluator, id_columns=["id"], encoding=encoding)
    with pytest.raises(ValueError, match="no complete row"):
        make().evaluate_one(df.filter("t IS NULL"), "label", ["x"], ["t"])
    with pytest.raises(ValueError, match="more than 2 values"):
        make(max_label_classes=2).evaluate_one(df, "label", ["x"], ["t"])
    with pytest.raises(ValueError, match="split leaves"):
        make(train_fraction=1e-9).evaluate_one(df, "label", ["x"], ["t"])
