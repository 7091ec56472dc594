"""Wide tables, exact values in a column's own type, layouts that change nothing, stored tables that go."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright import CleaningCycle, DataProfiler, PDSAConfig, PDSALoop, RepairEngine, RepairPolicy
from tablewright.functions import quantiles
from tablewright.operators import duplicates, fills, labels, outliers
from tablewright.plans.synthetic import dirty_table
from tablewright.plans.verify import injected_rates
from tablewright.sources.storage import shared_folder


def wide(spark, columns: int, kind: str, rows: int = 50):
    cells = [F.pmod(F.col("id") * (i + 3), F.lit(7)).cast(kind).alias(f"c{i}") for i in range(columns)]
    return spark.range(rows).select(*cells)


@pytest.mark.parametrize("columns", [63, 64, 65])
def test_modes_and_keys_of_many_columns(spark, columns):
    df = wide(spark, columns, "string")
    found = fills.modes(df, df.columns)
    assert found == {c: fills.modes(df, [c])[c] for c in ("c0", f"c{columns - 1}")} | {c: found[c] for c in df.columns[1:-1]}
    assert len(found) == columns
    counts = {r["key"]: r["duplicate_group_count"] for r in duplicates.key_duplicates(df, df.columns).collect()}
    assert len(counts) == columns and counts["c0"] == 7
    assert duplicates.composite_key_duplicates(df, df.columns).first()["row_count"] == 50


def test_profile_with_a_hundred_keys_and_mode_repair_of_wide_text(spark):
    df = wide(spark, 100, "string").withColumn("c0", F.when(F.col("c0") != "1", F.col("c0")))
    report = DataProfiler().profile(df, df.columns)
    assert len(report["skew"]) == 100 and report["duplicates"]["composite_key"]["duplicate_group_count"] == 7
    policy = RepairPolicy(categorical_imputation="mode", drop_duplicates=False)
    assert RepairEngine(policy).repair(df, report).cleaned_df.filter("c0 IS NULL").count() == 0


def test_quantiles_of_wide_numbers(spark):
    df = wide(spark, 230, "double", 400)
    found = quantiles.exact(df, {c: F.col(c) for c in df.columns}, [0.25, 0.75], finish_values=100)
    some = [f"percentile_disc({p}) within group (order by c{i})" for i in (0, 99, 100, 229) for p in (0.25, 0.75)]
    expected = list(df.selectExpr(*some).first())
    assert [q for i in (0, 99, 100, 229) for q in found[f"c{i}"]] == expected
    assert outliers.outliers(df.select(*df.columns[:3])).count() == 3


def test_medians_are_values_of_their_column(spark):
    far = 2**53
    integers = spark.createDataFrame([(far + k,) for k in (1, 2, 3, 4, 5, 900)] + [(None,)], "v long")
    assert fills.medians(integers, ["v"]) == {"v": far + 3}
    low = spark.createDataFrame([(-(2**63) + k,) for k in range(9)], "v long")
    assert fills.medians(low, ["v"]) == {"v": -(2**63) + 4}
    start = Decimal("12345678901234567890.12")
    decimals = spark.createDataFrame([(start + Decimal(k) / 100,) for k in range(7)], "v decimal(30,2)")
    assert fills.medians(decimals, ["v"]) == {"v": start + Decimal("0.03")}
    longest = spark.createDataFrame([(Decimal(10**38 - 1 - k),) for k in range(5)], "v decimal(38,0)")
    assert fills.medians(longest, ["v"]) == {"v": Decimal(10**38 - 3)}
    assert fills.fill(decimals.union(spark.createDataFrame([(None,)], "v decimal(30,2)")), {"v": start}).filter(
        F.col("v") == start).count() == 2


def test_collated_copies(spark):
    df = spark.createDataFrame([("a", 1), ("A", 1), ("b", 1)], "t string, n int").withColumn("t", F.collate("t", "UTF8_LCASE"))
    assert not duplicates.can_fingerprint(df)
    profile = DataProfiler().profile(df)
    assert profile["duplicates"]["duplicate_count"] == 1
    assert RepairEngine(RepairPolicy()).repair(df, profile).cleaned_df.count() == 2


def test_record_of_damage_and_independent_draws(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 50).cast("double").alias("b"))
    both, issues = dirty_table(df, missing={"a": 0.1, "b": 0.3}, outliers={"b": (1e6, 0.05)}, duplicate_rate=0.02)
    assert sorted(injected_rates(issues), key=str) == sorted(
        [("missingness", "a", 0.1), ("missingness", "b", 0.3), ("outliers", "b", 0.05), ("duplicates", None, 0.02)], key=str)
    alone, _ = dirty_table(df, outliers={"b": (1e6, 0.05)}, duplicate_rate=0.02)
    assert both.columns == df.columns and both.count() == alone.count()
    assert both.filter("b = 1e6").count() == alone.filter("b = 1e6").count()


def noisy(spark):
    uneven = F.pmod(F.xxhash64("id"), F.lit(100))
    return spark.range(600).select(
        (F.col("id") % 97).cast("double").alias("x"), (uneven / 7).alias("y"),
        F.when(uneven < 4, F.lit(None)).when((F.col("id") % 97 > 50) != (uneven > 92), "hi").otherwise("lo").alias("label"))


def test_models_do_not_depend_on_the_layout(spark):
    found = set()
    for partitions, shuffle in ((1, "2"), (5, "16")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        try:
            df = noisy(spark).repartition(partitions)
            noise = labels.estimate_label_noise(df, "label")
            done = labels.impute_labels(df, "label").df.groupBy("label").count().collect()
            found.add((noise.rows_used, noise.suspected, noise.low_confidence, tuple(sorted(map(tuple, done)))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 1


def test_labels_with_many_values_are_not_fitted(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("x"), F.concat(F.lit("v"), "id").alias("label"))
    assert labels.estimate_label_noise(df, "label").too_many_classes
    report = DataProfiler().profile(df, label_col="label")["label_noise"]["confidence_noise"]
    assert report == {"evaluated": False, "message": labels.MANY_CLASSES}
    gaps = df.withColumn("label", F.when(F.col("x") > 5, F.col("label")))
    assert labels.impute_labels(gaps, "label").reason == labels.MANY_CLASSES


def test_out_of_fold_noise_suspects_what_self_scoring_learns_by_heart(spark):
    df = noisy(spark).filter("label IS NOT NULL")
    own, apart = (labels.estimate_label_noise(df, "label", folds=k) for k in (1, 3))
    assert own.rows_used == apart.rows_used and apart.suspected >= 1
    assert DataProfiler(label_noise_folds=3).profile(df, label_col="label")["label_noise"]["confidence_noise"]["method"] == (
        "random_forest_out_of_fold")


def stored_tables(spark) -> set[str]:
    return {p for p in os.listdir(shared_folder(spark)) if p.startswith(("cleaned", "cycle"))}


def test_results_give_their_tables_back(spark):
    df = spark.createDataFrame([(k % 7, float(k)) for k in range(60)] + [(3, None)], "k int, v double")
    before = stored_tables(spark)
    with CleaningCycle().run(df) as cycle:
        assert stored_tables(spark) - before and cycle.cleaned_df.count() == 61
    loop = PDSALoop(pdsa_config=PDSAConfig(max_iterations=2)).run(df)
    loop.close()
    assert stored_tables(spark) == before


def test_a_failing_profile_leaves_no_table(spark):
    class Second(DataProfiler):
        turns = 0

        def profile(self, *args, **kwargs):
            self.turns += 1
            if self.turns == 2:
                raise RuntimeError("stop")
            return super().profile(*args, **kwargs)

    df = spark.createDataFrame([(k, float(k)) for k in range(20)], "k int, v double")
    before = stored_tables(spark)
    for plan in (CleaningCycle(Second()), PDSALoop(profiler=Second())):
        with pytest.raises(RuntimeError):
            plan.run(df)
    assert stored_tables(spark) == before
