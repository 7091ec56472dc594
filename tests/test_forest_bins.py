"""Forests on many rows: features in bins, copies as weights."""

from pyspark.sql import functions as F

from tablewright.operators import labels
from tablewright.operators.bins import find_bins
from tablewright.sources import storage


def few_single_rows(monkeypatch, most):
    for module in (labels, storage):
        monkeypatch.setattr(module, "SINGLE_ROWS", most)


def flipped(spark, rows=20_000, partitions=4):
    """The label follows a text of six values, but for one row in fifty; the number says nothing of it."""
    text = F.concat(F.lit("t"), F.col("id") % 6)
    flip = F.pmod(F.xxhash64("id"), F.lit(50)) == 0
    soon = (F.col("id") % 6 < 2) != flip
    number = (F.col("id") * 7919 % rows).cast("double")
    return spark.range(0, rows, 1, partitions).select(number.alias("x"), text.alias("text"), F.when(soon, "soon").otherwise("later").alias("when"))


def test_rows_of_a_forest_do_not_grow_with_the_table(spark, monkeypatch):
    few_single_rows(monkeypatch, 500)
    kept = []
    for rows in (10_000, 40_000):
        df = flipped(spark, rows).withColumn("text", F.ascii(F.substring("text", 2, 1)).cast("double"))
        training = labels.store_forest_rows(df, "when", ["x", "text"])
        runs = training.runs(training.stored.df)
        total = runs.agg(F.count(F.lit(1)), F.sum(storage.WEIGHT)).first()
        assert total[1] == rows == training.rows
        kept.append(total[0])
        training.stored.drop()
    assert max(kept) <= 32 * 6 * 2 + 500 + 64


def test_bins_find_what_was_flipped(spark, monkeypatch):
    df = flipped(spark)
    truth = df.withColumn("t", F.substring("text", 2, 1).cast("int")).filter((F.col("t") < 2) != (F.col("when") == "soon")).count()
    whole = [labels.estimate_label_noise(df, "when", folds=k) for k in (1, 3)]
    few_single_rows(monkeypatch, 2_000)
    for k, exact in zip((1, 3), whole):
        found = labels.estimate_label_noise(df, "when", folds=k)
        assert found.suspected == exact.suspected == truth > 100 and found.rows_used == 20_000
        assert abs(found.average_confidence - exact.average_confidence) < 0.01


def test_binned_forest_does_not_depend_on_the_layout(spark, monkeypatch):
    few_single_rows(monkeypatch, 1_000)
    found = [labels.estimate_label_noise(flipped(spark, 8_000, p).repartition(p), "when") for p in (2, 16)]
    assert found[0] == found[1]


def test_binned_forest_imputes_labels(spark, monkeypatch):
    few_single_rows(monkeypatch, 1_000)
    rule = F.when(F.col("text").isin("t0", "t1"), "soon").otherwise("later")
    df = flipped(spark, 6_000).withColumn("when", F.when(F.col("x") % 10 > 0, rule))
    done = labels.impute_labels(df, "when")
    assert done.imputed == done.candidates == 600 and done.df.filter(F.col("when") != rule).count() == 0


def test_few_values_and_heavy_values_have_bins_of_their_own(spark):
    heavy = F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id").cast("double") + 2)
    df = spark.range(3_000).select(heavy.alias("h"), (F.col("id") % 5).cast("double").alias("few"), F.lit(4.0).alias("one"))
    stored = storage.store_distinct(df)
    bins = find_bins(stored.df, ["h", "few", "one"], 3_000)
    names = bins.names
    rows = bins.add_to(df)
    of_heavy = rows.filter("h = 1").select(names["h"]).distinct().collect()
    assert len(of_heavy) == 1 and rows.filter((F.col(names["h"]) == of_heavy[0][0]) & (F.col("h") != 1)).count() == 0
    assert rows.select("few", names["few"]).distinct().count() == rows.select(names["few"]).distinct().count() == 5
    assert rows.select(names["one"]).distinct().count() == 1 and rows.select(names["h"]).distinct().count() <= 32
    stored.drop()
