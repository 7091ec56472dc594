import math

import pytest
from pyspark.sql import functions as F

from tablewright import DataProfiler
from tablewright.functions import grades, quantiles
from tablewright.functions.draws import uniform
from tablewright.sources.storage import shared_folder
from tablewright.operators import completeness, duplicates, outliers


@pytest.mark.parametrize(
    "ladder, value, expected",
    [
        (grades.MISSINGNESS, 0.0, "none"),
        (grades.MISSINGNESS, 0.0999, "low"),
        (grades.MISSINGNESS, 0.10, "medium"),
        (grades.MISSINGNESS, 0.40, "medium"),
        (grades.MISSINGNESS, 0.41, "high"),
        (grades.DUPLICATES, 0.02, "low"),
        (grades.DUPLICATES, 0.15, "medium"),
        (grades.DUPLICATES, 0.16, "high"),
        (grades.OUTLIERS, 0.049, "low"),
        (grades.OUTLIERS, 0.05, "high"),
        (grades.SKEW, 5.0, "low"),
        (grades.SKEW, 10.0, "medium"),
        (grades.SKEW, 10.1, "high"),
        (grades.SKEW, None, "unknown"),
        (grades.LABEL_NOISE, 0.03, "medium"),
        (grades.LABEL_NOISE, 0.11, "high"),
    ],
)
def test_grades_agree_on_numbers_and_columns(spark, ladder, value, expected):
    assert ladder.grade(value) == expected
    column = spark.range(1).select(ladder.column(F.lit(value).cast("double"))).first()[0]
    assert column == expected


def test_empty_table(spark):
    df = spark.createDataFrame([], "k int, v double, label string")
    report = DataProfiler().profile(df, ["k"], df.schema, "label")
    assert report["row_count"] == 0
    assert report["missingness"] == {} and report["outliers"] == {}
    assert report["duplicates"]["severity"] == "none" and report["duplicates"]["by_key"] == {}
    assert report["skew"]["k"]["severity"] == "unknown"
    assert report["label_noise"]["distinct_label_count"] == 0
    assert completeness.missingness(df).count() == 0


def test_missing_counts_nulls_and_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (3.0,), (None,)], "v double")
    entry = DataProfiler().profile(df)["missingness"]["v"]
    assert (entry["missing_count"], entry["nan_count"], entry["severity"]) == (2, 1, "medium")
    row = completeness.missingness(df).first()
    assert (row["null_count"], row["nan_count"], row["missing_count"]) == (1, 1, 2)


def test_nan_is_no_outlier_and_no_quartile(spark):
    df = spark.createDataFrame([(float("nan"),)] * 3 + [(float(i),) for i in range(1, 9)], "v double")
    entry = DataProfiler().profile(df)["outliers"]["v"]
    assert (entry["q1"], entry["q3"], entry["outlier_count"]) == (2.0, 6.0, 0)


def test_all_null_number_has_no_outlier_entry(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "v double, w int")
    report = DataProfiler().profile(df)
    assert set(report["outliers"]) == {"w"}


def test_zero_iqr_is_counted_but_not_repairable(spark):
    df = spark.createDataFrame([(5,), (5,), (5,), (5,), (9,)], "v int")
    entry = DataProfiler().profile(df)["outliers"]["v"]
    assert entry["outlier_count"] == 1 and not entry["repairable"]
    assert entry["method"] == outliers.ZERO_IQR and entry["lower_bound"] is None


def test_null_key_is_a_value_and_unknown_key_is_reported(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "k string, v int")
    report = DataProfiler().profile(df, ["k", "zz"])
    entry = report["duplicates"]["by_key"]["k"]
    assert (entry["duplicate_group_count"], entry["duplicate_row_count"]) == (1, 2)
    assert "zz" in report["duplicates"]["by_key"]["zz"]["error"]
    assert "two or more" in report["duplicates"]["composite_key"]["message"]
    assert report["skew"]["k"]["max_count"] == 2
    rows = {r["key"]: r for r in duplicates.key_duplicates(df, ["k", "zz"]).collect()}
    assert rows["zz"]["error"] and rows["k"]["duplicate_excess_count"] == 1


def test_fingerprints_tell_shifted_nulls_apart_and_join_equal_zeros(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, None)], "a int, b int")
    assert DataProfiler().profile(df)["duplicates"]["duplicate_count"] == 1
    zeros = spark.createDataFrame([(0.0, "x"), (-0.0, "x")], "a double, b string")
    assert DataProfiler().profile(zeros)["duplicates"]["duplicate_count"] == 1
    assert duplicates.exact_duplicates(zeros).first()["duplicate_count"] == 1


def test_many_repeated_fingerprints_take_the_whole_row_path(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") % 10).alias("a"), F.lit("x").alias("b"))
    assert duplicates.exact_duplicate_count(df, 10) == 90
    monkeypatch.setattr(duplicates, "_BROADCAST_GROUPS", 1)
    assert duplicates.exact_duplicate_count(df, 10) == 90


def test_nested_and_map_columns(spark):
    df = spark.createDataFrame(
        [({"a": 1, "b": 2}, [1]), ({"b": 2, "a": 1}, [1]), ({"a": 1}, [None]), (None, [1])],
        "m map<string,int>, l array<int>",
    )
    assert DataProfiler().profile(df)["duplicates"]["duplicate_count"] == 1
    assert duplicates.drop_duplicates(df).count() == 3
    deep = df.select(F.struct(F.array("m").alias("x")).alias("s"))
    assert duplicates.drop_duplicates(deep).count() == 3


def test_drift_is_sorted_and_ignores_nullability(spark):
    df = spark.createDataFrame([("1", "2", 3)], "b string, a string, extra int")
    reference = {
        "a": {"data_type": "int", "nullable": False},
        "b": {"data_type": "double", "nullable": True},
        "gone": {"data_type": "date", "nullable": True},
    }
    drift = DataProfiler().profile(df, reference_schema=reference)["schema_drift"]
    assert drift["added_columns"] == ["extra"] and drift["removed_columns"] == ["gone"]
    assert [c["column"] for c in drift["type_changes"]] == ["a", "b"]
    assert not DataProfiler().profile(df)["schema_drift"]["evaluated"]
    same = {c: {"data_type": t, "nullable": False} for c, t in (("b", "string"), ("a", "string"), ("extra", "int"))}
    assert not DataProfiler().profile(df, reference_schema=same)["schema_drift"]["drift_detected"]


def test_drifted_numbers_show_their_outliers(spark):
    df = spark.createDataFrame([(str(v),) for v in [*range(1, 20), 1000]], "v string")
    reference = {"v": {"data_type": "double", "nullable": True}}
    assert DataProfiler().profile(df, reference_schema=reference)["outliers"]["v"]["outlier_count"] == 1
    as_is = DataProfiler(restore_drifted_types=False).profile(df, reference_schema=reference)
    assert as_is["outliers"] == {}


def test_exact_quantiles_whatever_the_rounds_and_partitions(spark):
    names = ["spread", "tied", "empty", "same"]
    shares = [0.01, 0.25, 0.5, 0.75, 1.0]
    key = F.col("id")
    rows = spark.range(20_000).select(
        (uniform(1, key) * 1000).alias("spread"),
        F.when(uniform(2, key) < 0.4, 5.0).otherwise(uniform(3, key) * 10).alias("tied"),
        F.lit(None).cast("double").alias("empty"),
        F.lit(7).alias("same"),
    )
    rows.write.mode("overwrite").parquet(f"{shared_folder(spark)}/quantile-rows")
    rows = spark.read.parquet(f"{shared_folder(spark)}/quantile-rows")
    picks = [f"percentile_disc({s}) within group (order by {n})" for n in names for s in shares]
    flat = list(rows.selectExpr(*picks).first())
    wanted = {n: flat[i * 5 : i * 5 + 5] for i, n in enumerate(names)}
    for partitions, finish_rows in [(1, 3), (7, 50), (3, 10**6)]:
        found = quantiles.exact(rows.repartition(partitions), {n: F.col(n) for n in names}, shares, finish_rows)
        assert found == wanted


def test_exact_search_survives_a_wrong_bracket(spark):
    data = spark.range(1000).select(F.col("id").cast("double").alias("v0"))
    for near in [(900.0, 950.0), (1.0, 2.0), (500.5, 500.5)]:
        found = quantiles.search(data, {"v": "v0"}, {"v0": (1000, near)}, [0.25], finish_values=10)
        assert found["v"] == [249.0]


def test_sketched_quantiles_are_close(spark):
    df = spark.range(50_000).select(F.col("id").cast("double").alias("v"))
    low, high = quantiles.approximate(df, {"v": F.col("v")}, [0.25, 0.75])["v"]
    assert abs(low - 12_500) < 500 and abs(high - 37_500) < 500
    report = DataProfiler(exact_quantiles=False).profile(df)
    assert math.isclose(report["outliers"]["v"]["iqr"], 25_000, rel_tol=0.02)


def test_profile_does_not_depend_on_partitioning(spark):
    df = spark.range(3000).select(
        (F.col("id") % 50).alias("k"), (uniform(5, F.col("id")) * 100).alias("v"), F.lit("c").alias("s")
    )
    one, many = (DataProfiler().profile(df.repartition(p), ["k"]) for p in (1, 9))
    assert one == many


def test_profile_takes_few_jobs_whatever_the_width(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(width: int) -> int:
        group = f"width-{width}"
        df = spark.range(500).select(*[(F.col("id") * i % 97).alias(f"c{i}") for i in range(1, width + 1)])
        spark.sparkContext.setJobGroup(group, group)
        DataProfiler().profile(df, ["c1", "c2"])
        spark.sparkContext.setJobGroup("other", "other")
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(4) == jobs(24) <= 20


def test_label_section_guards(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "v int, label string")
    profiler = DataProfiler()
    assert profiler.profile(df)["label_noise"]["message"] == "No label was named."
    assert "no label column 'zz'" in profiler.profile(df, label_col="zz")["label_noise"]["message"]
    found = profiler.profile(df, label_col="label")["label_noise"]
    assert (found["label_null_count"], found["distinct_label_count"]) == (1, 2)
    assert not found["confidence_noise"]["evaluated"]


def test_label_noise_finds_flipped_labels(spark):
    df = spark.range(400).select(
        F.col("id").cast("double").alias("x"),
        F.when((F.col("id") % 40 == 0) != (F.col("id") >= 200), "hi").otherwise("lo").alias("label"),
    )
    noise = DataProfiler(strict=True).profile(df, label_col="label")["label_noise"]["confidence_noise"]
    assert noise["evaluated"] and noise["labeled_rows_used"] == 400
    assert 5 <= noise["suspected_noise_count"] <= 10
