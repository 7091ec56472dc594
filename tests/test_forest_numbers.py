import pytest
from pyspark.sql import functions as F

from tablewright.operators import labels
from tablewright.sources.storage import store_for_training


def many_values(spark, rows=60_000, partitions=4):
    """Every row has its own text but for two hot values, which alone decide the label."""
    hot = F.when(F.col("id") % 3 == 0, "hot-a").when(F.col("id") % 3 == 1, "hot-b").otherwise(F.concat(F.lit("v"), "id"))
    label = F.when(F.col("id") % 3 == 0, "yes").otherwise("no")
    return spark.range(0, rows, 1, partitions).select(hot.alias("text"), label.alias("label"))


def test_numbers_follow_frequency_then_bytes(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "text string")
    numbers = labels.TextNumbers(rows, labels.FeatureColumns((), ("text",)), "index")
    more = rows.unionByName(spark.createDataFrame([("new",)], "text string"))
    found = sorted(numbers.add_to(more).filter("text IS NOT NULL").select("text", "__number_0").distinct().collect())
    numbers.drop()
    assert [tuple(r) for r in found] == [("a", 1), ("b", 2), ("c", 0), ("new", 3)]


def test_text_with_as_many_values_as_rows_is_one_feature(spark):
    df = many_values(spark)
    noise = labels.estimate_label_noise(df, "label")
    assert noise.rows_used == 60_000 and noise.suspected == 0 and noise.average_confidence > 0.99


@pytest.mark.parametrize("encoding", labels.ENCODINGS)
def test_flipped_labels_of_hot_values_are_found(spark, encoding):
    small = many_values(spark, 3_000)
    flip = (F.col("text") == "hot-a") & (F.xxhash64(F.monotonically_increasing_id()) % 20 == 0)
    flipped = small.withColumn("label", F.when(flip, "no").otherwise(F.col("label"))).cache()
    wrong = flipped.filter("text = 'hot-a' AND label = 'no'").count()
    assert wrong > 20 and labels.estimate_label_noise(flipped, "label", encoding=encoding).suspected == wrong
    flipped.unpersist()


def test_same_forest_from_few_and_many_partitions(spark):
    found = [labels.estimate_label_noise(many_values(spark, 5_000, p).repartition(p), "label") for p in (3, 64)]
    assert found[0] == found[1]


def test_labels_are_imputed_for_values_not_seen_in_training(spark):
    df = many_values(spark, 6_000)
    unseen = (F.col("text") == "v2") | (F.col("text") == "v5")
    gaps = df.withColumn("label", F.when(unseen | (F.xxhash64("text", F.monotonically_increasing_id()) % 10 == 0), None).otherwise(F.col("label")))
    done = labels.impute_labels(gaps, "label")
    assert done.candidates == done.imputed > 500 and done.df.columns == ["text", "label"]
    wrong = done.df.filter((F.col("text") == "hot-a") != (F.col("label") == "yes")).count()
    assert wrong == 0 and done.df.count() == 6_000


def test_unknown_encoding_is_refused(spark):
    with pytest.raises(ValueError):
        labels.estimate_label_noise(many_values(spark, 300), "label", encoding="guess")


def test_copies_of_few_rows_fill_all_training_partitions(spark):
    kind = F.concat(F.lit("k"), F.col("id") % 5)
    few = spark.range(100_000).select(kind.alias("text"), (F.col("id") % 5).cast("double").alias("x"))
    layouts = []
    for df in (few, few.repartition(7)):
        stored = store_for_training(df, 16)
        sizes = stored.df.groupBy(F.spark_partition_id().alias("p"), "text", "x").count()
        layouts.append(sorted(tuple(r) for r in sizes.collect()))
        stored.drop()
    of_part = {p: sum(n for q, _, _, n in layouts[0] if q == p) for p, *_ in layouts[0]}
    assert layouts[0] == layouts[1] and len(of_part) == 16
    assert sum(of_part.values()) == 100_000 and max(of_part.values()) < 12_500
    texts = {t: sum(n for _, u, _, n in layouts[0] if u == t) for _, t, _, _ in layouts[0]}
    assert texts == {f"k{i}": 20_000 for i in range(5)}
