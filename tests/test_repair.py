from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright import DataProfiler, RepairEngine, RepairPolicy
from tablewright.operators import bounds, duplicates, fills, labels, layout, schemas


def repair(df, policy=RepairPolicy(), reference=None, keys=None, label=None):
    profile = DataProfiler().profile(df, keys, reference, label)
    return RepairEngine(policy).repair(df, profile, reference, keys, label)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_median_fill_keeps_integers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (100,)], "v int")
    done = repair(df, RepairPolicy(outlier_strategy="none", drop_duplicates=False))
    assert dict(done.cleaned_df.dtypes)["v"] == "int"
    assert sorted(column(done.cleaned_df, "v")) == [1, 2, 2, 100]


def test_mean_fill_keeps_decimals(spark):
    df = spark.createDataFrame([(Decimal("1.10"),), (Decimal("9.90"),), (None,)], "v decimal(10,2)")
    done = repair(df, RepairPolicy(numeric_imputation="mean", outlier_strategy="none"))
    assert dict(done.cleaned_df.dtypes)["v"] == "decimal(10,2)"
    assert Decimal("5.50") in column(done.cleaned_df, "v")


def test_nan_is_filled_and_all_null_is_left(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "v double, w double")
    done = repair(df, RepairPolicy(drop_duplicates=False))
    assert sorted(column(done.cleaned_df, "v")) == [1.0, 1.0, 3.0]
    assert column(done.cleaned_df, "w") == [None] * 3


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("a", 2), ("b", 1), (None, None)], "s string, n int")
    assert fills.modes(df, ["s", "n"]) == {"s": "a", "n": 1}
    assert fills.modes(df, ["s"]) == {"s": "a"}


def test_rare_missing_values_are_filled_too(spark):
    df = spark.range(30_000).select(F.when(F.col("id") > 0, F.col("id")).alias("v"))
    done = repair(df, RepairPolicy(drop_duplicates=False))
    assert done.cleaned_df.filter("v is null").count() == 0


def test_bad_casts_become_null_are_reported_and_then_filled(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("2.5",)], "v string")
    reference = {"v": {"data_type": "double", "nullable": True}}
    assert column(schemas.align(df, reference), "v") == [1.5, None, 2.5]
    done = repair(df, reference=reference)
    cast = next(a for a in done.actions if a["strategy"] == "cast")
    assert cast["lost_values"] == 1
    assert sorted(column(done.cleaned_df, "v")) == [1.5, 1.5, 2.5] or sorted(
        column(done.cleaned_df, "v")
    ) == [1.5, 2.5]


def test_schema_actions(spark):
    df = spark.createDataFrame([(1, "x")], "a int, extra string")
    reference = {"a": {"data_type": "bigint"}, "b": {"data_type": "decimal(5,1)"}}
    kept = repair(df, reference=reference).cleaned_df
    assert kept.columns == ["a", "extra", "b"] and dict(kept.dtypes)["b"] == "decimal(5,1)"
    dropped = repair(df, RepairPolicy(drop_added_columns=True), reference).cleaned_df
    assert dropped.dtypes == [("a", "bigint"), ("b", "decimal(5,1)")]
    same = repair(df, RepairPolicy(align_schema=False), reference).cleaned_df
    assert same.columns == ["a", "extra"]


@pytest.mark.parametrize("data_type", ["tinyint", "int", "bigint", "decimal(10,2)", "float", "double"])
def test_caps_keep_the_type_and_the_nulls(spark, data_type):
    values = [*range(10, 19), 100, None]
    df = spark.createDataFrame([(v,) for v in values], "v int").select(F.col("v").cast(data_type))
    done = repair(df, RepairPolicy(skip_imputation=True))
    assert done.cleaned_df.dtypes == df.dtypes
    found = column(done.cleaned_df, "v")
    assert max(v for v in found if v is not None) < 30 and None in found


def test_bounds_outside_the_type_leave_values_alone(spark):
    df = spark.createDataFrame([(-128,), (127,)], "v int").select(F.col("v").cast("tinyint"))
    assert column(bounds.cap(df, {"v": (-1000.0, 1000.0)}), "v") == [-128, 127]


def test_nan_is_not_capped(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,), (50.0,)], "v double")
    capped = bounds.cap(df, {"v": (0.0, 10.0)})
    assert [v for v in column(capped, "v") if v == v] == [5.0, 10.0]


def test_label_is_not_capped_unless_asked(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(10, 19), 100]], "y double")
    assert max(column(repair(df, label="y").cleaned_df, "y")) == 100.0
    assert max(column(repair(df, RepairPolicy(cap_label=True), label="y").cleaned_df, "y")) < 100.0


def test_column_override_and_limits(spark):
    df = spark.createDataFrame([(float(v), float(v)) for v in [*range(10, 19), 100]], "a double, b double")
    done = repair(df, RepairPolicy(outlier_column_strategies={"a": "none"}, cap_limits={"b": (None, 15.0)}))
    assert max(column(done.cleaned_df, "a")) == 100.0 and max(column(done.cleaned_df, "b")) == 15.0
    assert [a["strategy"] for a in done.actions if a["issue"] == "outliers"] == ["none", "cap"]


def test_zero_iqr_is_skipped_with_an_action(spark):
    df = spark.createDataFrame([(5, i) for i in range(9)] + [(9, 9)], "v int, i int")
    done = repair(df)
    assert any(a["strategy"] == "skip_non_repairable" for a in done.actions)
    assert 9 in column(done.cleaned_df, "v")


def test_row_filters_drop_and_count(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,), (9.0,), (float("nan"),)], "v double")
    done = repair(df, RepairPolicy(row_filters={"v": (2.0, 8.0)}))
    assert column(done.cleaned_df, "v") == [5.0]
    assert next(a for a in done.actions if "rows_removed" in a)["rows_removed"] == 4


def test_rows_made_equal_by_the_repair_are_merged(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "k int, s string")
    policy = RepairPolicy(categorical_imputation="mode")
    assert repair(df, policy).cleaned_df.count() == 2


def test_unique_key_saves_the_deduplication(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "k int, s string")
    done = repair(df, keys=["k"])
    assert [a["issue"] for a in done.actions] == ["missingness"]


def test_key_deduplication_keeps_the_first_in_order(spark):
    rows = [(1, "b", 2), (1, "a", 9), (None, "z", 1), (None, None, 5), (2, "q", 0)]
    df = spark.createDataFrame(rows, "k int, s string, n int").repartition(3)
    done = repair(df, RepairPolicy(duplicate_strategy="key", skip_imputation=True, outlier_strategy="none"), keys=["k"])
    assert set(map(tuple, done.cleaned_df.collect())) == {(1, "a", 9), (None, None, 5), (2, "q", 0)}
    assert set(map(tuple, duplicates.drop_duplicates_by_key(df, ["k", "s", "n"]).collect())) == set(rows)


def test_hot_key_is_spread_and_no_row_changes(spark):
    df = spark.range(8000).select(
        F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), F.lit("same").alias("s")
    )
    spread = layout.spread_by_key(df, "k", 8)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 4000
    assert spread.exceptAll(df).count() == 0 and df.exceptAll(spread).count() == 0


def test_copies_of_one_row_are_spread_too(spark):
    df = spark.range(6000).select(F.lit(1).alias("k")).repartition(4)
    sizes = [r["count"] for r in layout.spread_by_key(df, "k", 8).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1


def test_skew_repair_reports_the_requested_partitions(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1000, -1).otherwise(F.col("id") % 100).alias("k"), F.col("id"))
    done = repair(df, RepairPolicy(skew_strategy="repartition", skew_target_partitions=6), keys=["k"])
    assert done.actions[-1]["target_partitions"] == 6 and done.cleaned_df.count() == 2000


@pytest.mark.parametrize(
    "changes",
    [
        {"numeric_imputation": "magic"},
        {"categorical_imputation": "magic"},
        {"outlier_strategy": "drop"},
        {"outlier_column_strategies": {"a": "drop"}},
        {"duplicate_strategy": "fuzzy"},
        {"label_imputation": "guess"},
        {"skew_strategy": "pray"},
        {"skew_strategy": "repartition", "skew_target_partitions": 0},
    ],
)
def test_policy_is_checked(spark, changes):
    with pytest.raises(ValueError):
        RepairPolicy(**changes).validate()


def labelled(spark, rows=200):
    return spark.range(rows).select(
        F.col("id"),
        F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).cast("double").alias("x"),
        F.when(F.col("id") % 10 == 3, None).otherwise(F.when(F.col("id") < rows / 2, "a").otherwise("b")).alias("y"),
    )


def test_missing_labels_are_predicted_for_complete_rows_only(spark):
    df = labelled(spark)
    done = labels.impute_labels(df, "y")
    assert done.reason is None and done.imputed == done.candidates == df.filter("y is null and x is not null").count()
    assert done.df.count() == 200 and done.df.columns == df.columns
    left = done.df.filter("y is null")
    assert left.count() == df.filter("y is null and x is null").count()
    unchanged = df.filter("y is not null")
    assert unchanged.exceptAll(done.df).count() == 0
    truth = df.select("id", F.when(F.col("id") < 100, "a").otherwise("b").alias("y"))
    assert labels.label_recovery(done.df, truth, "id", "y").first()["accuracy"] > 0.97


def test_label_repair_skips_with_a_reason(spark):
    few = labelled(spark, 10)
    assert labels.impute_labels(few, "y", min_training_rows=50).reason == labels.FEW_ROWS
    assert labels.impute_labels(few.select("y"), "y").reason == labels.NO_FEATURES
    done = repair(labelled(spark, 15), RepairPolicy(label_imputation="model", skip_imputation=True), label="y")
    assert any(a["strategy"] == "skip_model_imputation" for a in done.actions)
