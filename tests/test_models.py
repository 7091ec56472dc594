"""Numbered text values, sparse vectors, and least squares from sums of products."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablewright import SparkMLClassificationEvaluator, SparkMLRegressionEvaluator
from tablewright.operators import categories, moments
from tablewright.operators.features import FEATURES
from tablewright.sources.storage import training_partitions

VALUES = [None, "", "b", "a", "é", "hot", "x" * 2000, "Z"]


def texts(spark, hot=400):
    rows = [(i, VALUES[i % 7], f"v{i % 50}") for i in range(140)] + [(1000 + i, "hot", None) for i in range(hot)] + [(1, "x" * 2000, "v1")] * 3
    return spark.createDataFrame(rows, "id long, `a.b` string, c string").repartition(5)


def plain_ranks(values):
    counts = Counter(v for v in values if v is not None)
    order = sorted(counts, key=lambda v: (-counts[v], v.encode()))
    return {v: (counts[v], i) for i, v in enumerate(order)}


@pytest.mark.parametrize("small", [8 << 20, 0])
def test_index_and_ranks(spark, small, monkeypatch):
    monkeypatch.setattr(categories, "SMALL_INDEX_BYTES", small)
    monkeypatch.setattr(categories, "HOT_SHARE", 2)  # only "hot" is hot then
    df = texts(spark)
    local = df.collect()
    index = categories.category_index(df, ["a.b", "c"])
    found = {(r["column"], r["value"]): (r["n"], r["rank"]) for r in index.table.collect()}
    expected = {(c, v): x for c in ("a.b", "c") for v, x in plain_ranks([r[c] for r in local]).items()}
    assert found == expected and index.sizes == {"a.b": 6, "c": 50}
    others = df.unionByName(spark.createDataFrame([(9, "new", None)], df.schema))
    ranked = categories.with_ranks(others, index, {"a.b": "first", "c": "second"}).collect()
    rank = lambda c, v: expected.get((c, v), (0, None))[1]
    assert Counter(ranked) == Counter((*r, rank("a.b", r["a.b"]), rank("c", r["c"])) for r in others.collect())


def test_hot_values_do_not_meet(spark, monkeypatch):
    """Rows of a value that holds most of the table are spread over the tasks of the join."""
    monkeypatch.setattr(categories, "SMALL_INDEX_BYTES", 0)
    df = texts(spark, hot=20_000)
    index = categories.category_index(df, ["a.b"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = categories.with_ranks(df, index, {"a.b": "rank"})
        sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 1.2 * sum(sizes) / 4


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "x double, t string, y double")
    index = categories.category_index(nothing, ["t"])
    assert index.sizes == {"t": 0} and index.table.count() == 0
    assert categories.sparse_vectors(nothing, ["x"], index, ["y"], "v").df.count() == 0
    assert categories.category_index(nothing, []).sizes == {}


def modelled(spark, n=500, mean=1e6):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(n):
        x, z, t, u = float(draw.normal(mean, 3)), float(draw.normal()), "abc"[int(draw.integers(3))], f"w{int(draw.integers(12))}"
        rows.append((i, x, z, t, u, 5 * x - 2 * z + {"a": 1.0, "b": -3.0, "c": 0.0}[t] + 0.1 * len(u) + float(draw.normal())))
    return spark.createDataFrame(rows, "id long, x double, z double, t string, u string, y double").repartition(4)


@pytest.mark.parametrize("at_once", [200, 3])
def test_fits_are_those_of_least_squares(spark, at_once, monkeypatch):
    monkeypatch.setattr(moments, "SUMS_AT_ONCE", at_once)
    df = modelled(spark)
    masks = [F.col("id") % 3 != 0, F.col("id") % 2 == 0]
    rows = df.withColumn(moments.SPLITS, moments.split_mask(masks))
    index = categories.category_index(rows, ["t", "u"])
    fits, scores, sums = moments.fit_splits(rows, "y", ["x", "z"], index, 2)
    local = df.orderBy("id").toPandas()
    one_hot = [local[c].eq(v).astype(float) for c in ("t", "u") for v in sorted(local[c].unique())]
    design = np.column_stack([np.ones(len(local)), local.x - local.x.mean(), local.z, *one_hot])
    for f, training in enumerate((local.id % 3 != 0, local.id % 2 == 0)):
        b = np.linalg.lstsq(design[training], local.y[training], rcond=None)[0]
        error = (local.y - design @ b)[~training]
        assert sums["training"][f] == training.sum() and sums["rows"] == len(local)
        assert scores[f]["rmse"] == pytest.approx(np.sqrt((error**2).mean()), abs=1e-6)
        assert scores[f]["mae"] == pytest.approx(error.abs().mean(), abs=1e-6)
        assert scores[f]["r2"] == pytest.approx(1 - (error**2).mean() / local.y[~training].var(ddof=0), abs=1e-6)
        assert fits[f].numeric["x"] == pytest.approx(b[1], abs=1e-6)


def test_all_folds_take_as_many_jobs_as_one(spark):
    rows = modelled(spark).withColumn(moments.SPLITS, moments.split_mask([F.col("id") % 7 != f for f in range(7)]))
    stored = rows.cache()
    stored.count()
    index = categories.category_index(stored, ["t"])
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for splits in (1, 7):
        spark.sparkContext.setJobGroup(f"folds {splits}", "")
        moments.fit_splits(stored, "y", ["x", "z"], index, splits)
        jobs.append(len(tracker.getJobIdsForGroup(f"folds {splits}")))
    spark.sparkContext.setJobGroup("", "")
    stored.unpersist()
    assert jobs[0] == jobs[1]


def test_evaluator_paths_agree(spark, monkeypatch):
    df = modelled(spark, mean=1.0)
    exact = SparkMLRegressionEvaluator(validation_folds=2, id_columns=["id"]).evaluate_one(df, "y", ["x", "z"], ["t"])
    monkeypatch.setattr(moments, "MOST_FEATURES", 1)  # now the vectors are fitted by the library
    fitted = SparkMLRegressionEvaluator(validation_folds=2, id_columns=["id"]).evaluate_one(df, "y", ["x", "z"], ["t"])
    for name in ("ml_row_count", "train_row_count", "test_row_count"):
        assert exact[name] == fitted[name]
    for name in ("rmse", "mae"):
        assert exact[name] == pytest.approx(fitted[name], abs=2e-3)
    with pytest.raises(ValueError, match="split leaves"):
        SparkMLRegressionEvaluator(train_fraction=1e-9).evaluate_one(df, "y", ["x"], [])


def test_vectors_are_read_as_vectors(spark):
    df = modelled(spark)
    index = categories.category_index(df.filter("t <> 'c'"), ["t"])
    vectors = categories.sparse_vectors(df, ["x", "z"], index, ["id", "t", "y"], FEATURES).df
    for r in vectors.collect():
        assert r[FEATURES].size == 5 and r[FEATURES].indices.tolist()[:2] == [0, 1]
        assert (r[FEATURES].indices[2] == 4) == (r["t"] == "c")
    assert LinearRegression(featuresCol=FEATURES, labelCol="y").fit(vectors).numFeatures == 5


def test_two_million_values_stay_off_the_driver(spark):
    """The index of a column of two million values reaches the driver as three sums."""
    df = spark.range(2_000_000).selectExpr("concat('value ', id) AS t", "cast(id % 7 as double) AS x")
    index = categories.category_index(df, ["t"])
    assert index.sizes == {"t": 2_000_000}
    extent = index.table.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
    assert tuple(extent) == (0, 1_999_999, 2_000_000)
    vectors = categories.sparse_vectors(df, ["x"], index, ["x"], FEATURES)
    assert vectors.df.count() == 2_000_000


def test_probabilities_of_a_saturated_fit(spark):
    rows = spark.createDataFrame([("a", "p")] * 30 + [("a", "q")] * 10 + [("b", "p")] * 5 + [("b", "q")] * 45, "t string, y string")
    evaluator = SparkMLClassificationEvaluator(iterations=100, tolerance=1e-12)
    found = evaluator.class_probabilities(rows, "y", [], ["t"], ["t"]).distinct().collect()
    shares = {(r["t"], r["class"]): r["probability"] for r in found}
    assert shares == pytest.approx({("a", "p"): 0.75, ("a", "q"): 0.25, ("b", "p"): 0.1, ("b", "q"): 0.9}, abs=1e-6)


def test_partitions_follow_the_rows():
    assert [training_partitions(n) for n in (0, 1, 10_000, 10_001, 10**6, 10**8, 10**12)] == [1, 1, 1, 2, 64, 100, 10**6]
