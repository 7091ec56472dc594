import pytest
from pyspark.sql import functions as F

from tablewright import (
    CleaningCycle, DataQualityEvaluator, EvaluationReportBuilder, ExperimentLogger, MLEvaluationResult, PDSAConfig,
    PDSALoop, RepairPolicy, SparkMLClassificationEvaluator, SparkMLRegressionEvaluator, SyntheticDataGenerator,
    SyntheticIssueConfig,
)
from tablewright.operators import scores
from tablewright.plans.evaluation import safe_ratio, summarize_quality
from tablewright.plans.loop import act_log, compute_residuals, failed_issues, narrow_policy
from tablewright.plans.models import compare_conditions, summarize_folds
from tablewright.plans.report import policy_lines, skew_balance
from tablewright.plans.synthetic import inject_wine_issues
from tablewright.plans.verify import (
    compute_detection_accuracy, rate_accuracy, run_validation_only_baseline, verify_profiler_accuracy,
)
from tablewright.sources import readers
from tablewright.sources.sampling import sample_rows
from tablewright.sources.storage import materialise


@pytest.fixture(scope="module")
def dirty(spark):
    config = SyntheticIssueConfig(row_count=1500, label_noise_rate=0.0, missing_label_rate=0.0)
    data = SyntheticDataGenerator(spark, config).generate_regression_dataset()
    data.dirty_df = materialise(data.dirty_df, "generated").df
    return data


@pytest.fixture(scope="module")
def cycle(dirty):
    return CleaningCycle(repair_policy=RepairPolicy(drop_added_columns=True)).run(
        dirty.dirty_df, ["join_key"], dirty.reference_schema
    )


def test_cycle_removes_what_was_injected(dirty, cycle):
    assert cycle.evaluation["missingness"]["cleaned_total"] == 0
    assert cycle.evaluation["duplicates"]["cleaned"] == 0
    assert cycle.evaluation["schema_drift"] == {
        "raw_drift_detected": True, "cleaned_drift_detected": False, "raw_issue_count": 2, "cleaned_issue_count": 0,
    }
    assert cycle.evaluation["missingness"]["removed_columns"] == {"new_source_col": 0}
    assert cycle.cleaned_df.count() == 1500
    assert cycle.opex_metrics["repair_action_count"] == len(cycle.repair_actions)
    assert summarize_quality(cycle.evaluation)["duplicate_reduction"] > 0


def test_profile_of_the_injected_issues_is_verified(dirty, cycle):
    checked = verify_profiler_accuracy(dirty.dirty_df, cycle.raw_profile)
    assert checked["missingness"]["exact_match"] and checked["duplicates"]["exact_match"]
    found = compute_detection_accuracy(dirty.metadata["issues"], cycle.raw_profile)
    assert found["schema_drift"]["accurate"] and found["missingness"]["mean_accuracy"] > 70
    assert found["key_skew"]["detected_severity"] == "high"


def test_detection_only_flags_columns(dirty):
    found = run_validation_only_baseline(dirty.dirty_df, dirty.reference_schema, ["join_key"])["issues_detected"]
    assert found["missingness_cols_flagged"] == 2 and found["schema_drift_detected"]
    assert found["skew_cols_flagged"] == 1 and found["duplicates_detected"] > 0


def test_rate_accuracy():
    assert rate_accuracy(0.05, 0.05) == 100.0 and rate_accuracy(0.2, 0.05) == 0.0
    assert rate_accuracy(None, 0.05) is None and rate_accuracy(0.1, 0) is None


def test_evaluator_on_plain_reports():
    raw = {
        "row_count": 10,
        "missingness": {"a": {"missing_count": 4}, "b": {"missing_count": 1}},
        "outliers": {"a": {"outlier_count": 3}},
        "skew": {"k": {"skew_ratio": 6.0, "severity": "medium"}, "m": {"error": "no"}},
    }
    cleaned = {
        "row_count": 8,
        "missingness": {"a": {"missing_count": 0}, "c": {"missing_count": 8}},
        "outliers": {"c": {"outlier_count": 2}},
        "skew": {"k": {"skew_ratio": 4.0, "severity": "low"}},
    }
    found = DataQualityEvaluator().evaluate(raw, cleaned, [{"issue": "x"}, {}]).metrics
    assert found["row_count"] == {"raw": 10, "cleaned": 8, "change": -2, "change_ratio": -0.2}
    assert found["missingness"]["raw_total"] == 4 and found["missingness"]["added_columns"] == {"c": 8}
    assert found["outliers"]["by_column"]["c"]["reduction"] == -2
    assert found["skew"]["by_column"]["k"]["reduction"] == 2.0
    assert found["skew"]["by_column"]["m"]["reduction"] is None
    assert found["repair_actions_by_issue"] == {"x": 1, "unknown": 1}
    assert safe_ratio(1, 0) == 0.0
    assert skew_balance(raw, cleaned)["average_reduction"] == 2.0


def test_loop_stops_and_says_why(dirty):
    loop = PDSALoop(RepairPolicy(), PDSAConfig(max_iterations=3))
    found = loop.run(dirty.dirty_df, ["join_key"], dirty.reference_schema)
    assert found.stop_reason == "converged" and found.converged
    assert found.pdsa_iterations[0].repair_issue_types[0] == "schema_drift"
    for record in found.pdsa_iterations[1:]:
        assert record.repair_issue_types == ("outliers",)
    assert found.iterations_frame().count() == found.total_iterations
    strict = PDSAConfig(max_iterations=2, max_skew_ratio=1.0, max_outlier_ratio=1.0, iterative_issue_types=("outliers",))
    stuck = PDSALoop(RepairPolicy(), strict).run(dirty.dirty_df, ["join_key"], dirty.reference_schema)
    assert stuck.stop_reason == "nothing_to_retry" and stuck.total_iterations == 1
    [act] = stuck.pdsa_iterations[0].policy_adjustments
    assert act.issue == "skew" and act.residual > act.limit == 1.0 and not act.retried
    assert stuck.iterations_frame().first()["policy_adjustments"][0]["issue"] == "skew"
    assert stuck.cleaned_df.count() == 1500


def test_loop_helpers():
    config = PDSAConfig(max_skew_ratio=3.0)
    profile = {
        "row_count": 10,
        "missingness": {"a": {"missing_count": 1}, "b": {"missing_count": 1}},
        "outliers": {"a": {"outlier_count": 6}, "b": {"outlier_count": 6}},
        "duplicates": {"duplicate_count": 0},
        "skew": {"k": {"skew_ratio": 4.0}, "m": {"error": "no"}},
    }
    left = compute_residuals(profile)
    assert left == {"missingness": 0.1, "outliers": 1.2, "duplicates": 0.0, "skew": 4.0}
    assert failed_issues(left, config) == ("missingness", "outliers", "skew")
    acts = act_log(left, config, ("missingness", "outliers"), ("outliers",))
    assert [(a.issue, a.residual, a.limit, a.retried) for a in acts] == [
        ("missingness", 0.1, 0.01, False), ("outliers", 1.2, 0.01, True)]
    narrow = narrow_policy(RepairPolicy(skew_strategy="repartition"), ["outliers"])
    assert narrow.skew_strategy == "none" and not narrow.drop_duplicates and narrow.outlier_strategy == "cap"
    with pytest.raises(ValueError):
        PDSALoop(pdsa_config=PDSAConfig(max_iterations=0))
    with pytest.raises(ValueError):
        PDSALoop(pdsa_config=PDSAConfig(iterative_issue_types=("nonsense",)))


def test_generated_data_does_not_depend_on_partitions(spark):
    config = SyntheticIssueConfig(row_count=600)
    for name in ("classification", "regression", "employee_attrition", "house_price"):
        plain, spread = (
            getattr(SyntheticDataGenerator(spark, config, ids), f"generate_{name}_dataset")()
            for ids in (None, spark.range(600).toDF("row_id").repartition(7))
        )
        assert plain.dirty_df.exceptAll(spread.dirty_df).count() == 0
        assert plain.reference_schema == spread.reference_schema
        assert 600 < plain.dirty_df.count() < 640
    with pytest.raises(ValueError):
        SyntheticDataGenerator(spark, SyntheticIssueConfig(missing_rate=1.5))
    with pytest.raises(ValueError):
        SyntheticDataGenerator(spark, SyntheticIssueConfig(row_count=0))


def test_report_and_run_log(spark, cycle, tmp_path):
    ml = MLEvaluationResult(
        {"rmse": 2.0, "mae": 1.0, "r2": 0.5, "ml_row_count": 9},
        {"rmse": 1.0, "mae": 0.5, "r2": 0.7, "ml_row_count": 10},
        {"rmse": -1.0, "mae": -0.5, "r2": 0.2, "ml_row_count": 1},
    )
    report = EvaluationReportBuilder().build(cycle, ml, 12, 80, 100.0)
    process = report.process_efficiency_metrics
    assert report.ml_metrics["task_type"] == "regression" and report.ml_metrics["rmse"]["delta"] == -1.0
    assert process["reduction_in_dataset_specific_cleaning_code"]["estimated_lines_reduced"] == 80 - 6
    assert policy_lines(None) == 5
    assert not EvaluationReportBuilder().build(cycle).ml_metrics["captured"]
    log = ExperimentLogger(str(tmp_path / "runs"), spark)
    first = log.log_run("wine auto!", cycle, cycle.repair_policy, {"k": 1}, ml, report)
    second = log.log_run("wine manual", cycle)
    assert log.newest_run("auto") == first and log.newest_run("manual") == second
    with pytest.raises(FileNotFoundError):
        log.newest_run("nowhere")
    assert log.artifact(first, "policy")["drop_added_columns"] is True
    assert log.artifact(second, "ml_metrics") is None
    compared = {r["metric"]: r for r in log.compare(first, second).collect()}
    assert compared["duplicates_raw"]["same"] and not compared["rmse_raw"]["same"]
    rows = {r["run_id"]: r for r in log.summary("data_quality").collect()}
    assert rows[first]["missingness_cleaned"] == 0.0 and set(rows) == {first, second}
    assert log.summary("regression").first()["rmse_cleaned"] == 1.0
    assert log.summary("effort").count() == 2


def test_regression_and_classification_comparison(spark, dirty, cycle):
    numbers = ["feature_num1", "feature_num2"]
    evaluator = SparkMLRegressionEvaluator(validation_folds=2)
    found = evaluator.evaluate_linear_regression(dirty.dirty_df, cycle.cleaned_df, "target", numbers, ["category"])
    assert found.delta["ml_row_count"] > 0 and found.cleaned_metrics["r2"] > found.raw_metrics["r2"]
    assert set(found.raw_metrics["fold_stability"]["summary"]) == {"rmse", "mae", "r2"}
    labelled = cycle.cleaned_df.withColumn("high", F.when(F.col("target") > 150, "yes").otherwise("no"))
    classes = SparkMLClassificationEvaluator()
    table = compare_conditions(classes, {"raw": labelled, "checked": labelled}, "high", numbers, ["category"])
    rows = table.collect()
    assert rows[0]["accuracy"] > 0.8 and rows[1]["accuracy_delta"] == 0.0 and rows[0]["auc"] > 0.8
    with pytest.raises(ValueError):
        classes.evaluate_one(labelled.filter("false"), "high", numbers, [])
    with pytest.raises(ValueError):
        SparkMLRegressionEvaluator(train_fraction=1.0)
    with pytest.raises(ValueError):
        SparkMLRegressionEvaluator(validation_folds=0)


def test_scores_match_spark_evaluators(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

    df = spark.range(500).select(
        (F.col("id") % 3).cast("double").alias("l"), ((F.col("id") * F.col("id")) % 4).cast("double").alias("p")
    )
    ours = scores.classification_scores(df, "l", "p").first()
    names = {"accuracy": "accuracy", "f1": "f1", "weighted_precision": "weightedPrecision", "weighted_recall": "weightedRecall"}
    for mine, theirs in names.items():
        judge = MulticlassClassificationEvaluator(labelCol="l", predictionCol="p", metricName=theirs)
        assert ours[mine] == pytest.approx(judge.evaluate(df))
    ours = scores.regression_scores(df, "l", "p").first()
    for name in ("rmse", "mae", "r2"):
        assert ours[name] == pytest.approx(RegressionEvaluator(labelCol="l", predictionCol="p", metricName=name).evaluate(df))


def test_area_under_roc_against_all_pairs(spark):
    rows = [(i % 3 == 0, float((i * 37) % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wanted = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert scores.area_under_roc(df, "y", "s").first()["auc"] == pytest.approx(wanted, abs=1e-12)
    assert scores.area_under_roc(df.filter("y"), "y", "s").first()["auc"] is None


def test_split_is_whole_and_disjoint(spark):
    df = spark.range(2000).toDF("i")
    train, test = scores.split(df.repartition(5), 0.8, 42)
    assert train.intersect(test).count() == 0 and train.count() + test.count() == 2000
    assert 1500 < train.count() < 1700
    assert scores.split_counts(df, 0.8, 42).first()["train_row_count"] == train.count()


def test_fold_summary():
    found = summarize_folds([{"fold": 1, "auc": 0.5}, {"fold": 2, "auc": None}], ["auc", "f1"])
    assert found["summary"] == {"auc": {"mean": 0.5, "stddev": 0.0, "min": 0.5, "max": 0.5}, "f1": None}


def test_census_files(spark, tmp_path):
    row = " 39, State-gov, 77516, Bachelors, 13, Never-married, ?, Not-in-family, White, Male, 2174, 0, 40, ?, <=50K."
    (tmp_path / "a.data").write_text("|skip this line\n" + row + "\n")
    (tmp_path / "b.data").write_text(row.replace("77516", "many") + "\n")
    df = readers.load_adult_dataframe(spark, [str(tmp_path / "a.data"), str(tmp_path / "b.data")])
    first, second = sorted(df.collect(), key=lambda r: r["fnlwgt"] is None)
    assert first["age"] == 39 and first["fnlwgt"] == 77516.0 and first["income"] == "<=50K"
    assert first["occupation"] is None and second["fnlwgt"] is None


def test_wine_files_and_damage(spark, tmp_path):
    for name in ("red", "white"):
        lines = "\n".join(f"{i};{i / 2};{9 + i % 4}" for i in range(1, 401))
        (tmp_path / f"{name}.csv").write_text("fixed acidity;residual sugar;alcohol\n" + lines + "\n")
    df = readers.load_wine_dataframe(spark, str(tmp_path / "red.csv"), str(tmp_path / "white.csv"))
    assert df.columns == ["fixed_acidity", "residual_sugar", "alcohol", "wine_type"]
    assert df.groupBy("wine_type").count().count() == 2 and df.count() == 800
    hurt, issues = inject_wine_issues(df, 0.1, 0.1, 0.1, True)
    assert dict(hurt.dtypes)["alcohol"] == "string" and "source_system" in hurt.columns
    assert set(issues) == {"missingness", "outliers", "schema_drift", "duplicates"}
    assert hurt.filter("residual_sugar = 100.0").count() > 30 and hurt.count() > 830


def test_taxi_files(spark, tmp_path):
    columns = ", ".join(["fare_amount double", "passenger_count bigint", "trip_distance double", "PULocationID int",
                         "DOLocationID int", "payment_type bigint", "RatecodeID double", "tpep_pickup_datetime timestamp"])
    when = spark.sql("select timestamp'2023-01-01 13:30:00'").first()[0]
    rows = [(float(i), 1, 2.5, 7, 8, 2, 1.0, when) for i in range(300)] + [(None, 1, 2.5, 7, 8, 2, 1.0, when)]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "trips"))
    df = readers.load_taxi_dataframe(spark, str(tmp_path / "trips"), 50)
    assert df.count() == 50
    row = df.first()
    assert (row["payment_type"], row["RatecodeID"], row["hour_of_day"], row["day_of_week"]) == ("2", "1", 13.0, 1.0)
    assert readers.load_taxi_dataframe(spark, str(tmp_path / "trips")).count() == 300


def test_samples_with_copies_have_the_right_size(spark):
    df = spark.range(900).select(F.lit("copy").alias("c"))
    assert sample_rows(df, 100).count() == 100
    assert sample_rows(df, 5000).count() == 900 and sample_rows(df, 0).count() == 0
    ids = spark.range(1000)
    one, other = (sample_rows(ids.repartition(p), 50, ids=["id"]) for p in (1, 6))
    assert one.count() == 50 and one.exceptAll(other).count() == 0


def test_encoding_is_what_was_asked_for():
    from tablewright.operators import features

    by_index = features.feature_stages(["n"], ["few", "many"])
    assert [type(s).__name__ for s in by_index] == ["StringIndexer", "OneHotEncoder", "VectorAssembler"]
    by_hash = features.feature_stages(["n"], ["few", "many"], "hash", 64)
    assert [type(s).__name__ for s in by_hash] == ["FeatureHasher", "VectorAssembler"] and by_hash[0].getNumFeatures() == 64
    with pytest.raises(ValueError):
        features.feature_stages(["n"], ["few"], "guess")

