import pytest
from pyspark.sql import functions as F

from tablewright import CleaningCycle, DataProfiler, PDSAConfig, PDSALoop, RepairEngine, RepairPolicy
from tablewright.functions.columns import col
from tablewright.operators.duplicates import FINGERPRINT
from tablewright.plans import profiler as profiler_module
from tablewright.plans.profiler import Carried, profile_after
from tablewright.sources.storage import materialise


def table(spark, copies=False):
    n = F.col("id")
    rows = spark.range(0, 600, 1, 3).select(
        n.alias("key"),
        (n % 7).alias("group"),
        F.when(n % 11 == 0, None).when(n % 13 == 0, float("nan")).when(n % 50 == 1, 1e6).otherwise((n * 37) % 101 + 0.5).alias("price"),
        F.when(n % 90 == 0, -500).otherwise(n % 23).cast("int").alias("size"),
        F.when(n % 9 == 0, None).otherwise(F.concat(F.lit("t"), n % 5)).alias("text.dotted"),
        F.when(n % 17 == 0, None).when(n % 23 < 12, "low").otherwise("high").alias("label"),
    )
    return materialise(rows.unionByName(rows.limit(30)) if copies else rows, "table").df


@pytest.fixture
def scanned(monkeypatch):
    """What profiles have aggregated over rows and which column sets they have grouped by."""
    found = {"measures": [], "sets": []}
    summarise, census = profiler_module.summarise, profiler_module.dup.group_census
    monkeypatch.setattr(
        profiler_module, "summarise", lambda df, measures: (found["measures"].extend(measures), summarise(df, measures))[1])
    monkeypatch.setattr(
        profiler_module.dup, "group_census", lambda df, sets: (found["sets"].extend(map(tuple, sets.values())), census(df, sets))[1])
    return found


POLICIES = {
    "caps only": RepairPolicy(skip_imputation=True),
    "all columns": RepairPolicy(),
    "nothing": RepairPolicy(skip_imputation=True, outlier_strategy="none"),
    "label too": RepairPolicy(label_imputation="model", outlier_strategy="none"),
    "schema": RepairPolicy(skip_imputation=True, outlier_strategy="none", drop_added_columns=True),
    "rows go": RepairPolicy(row_filters={"size": (0, None)}),
}


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("name", POLICIES)
def test_carried_profile_is_the_full_one(spark, name, copies):
    df, profiler = table(spark, copies), DataProfiler(strict=True)
    reference = df.drop("group").schema if name == "schema" else df.schema
    label = "label" if name in ("nothing", "label too") else "group"  # a number has no forest
    context = {"key_columns": ["key", "group", "text.dotted", "absent"], "reference_schema": reference, "label_col": label}
    before = profiler.profile(df, **context)
    repaired = RepairEngine(POLICIES[name]).repair(df, before, **context)
    after = materialise(repaired.cleaned_df, "after").df
    assert profile_after(profiler, before, after, repaired.rewritten, **context) == profiler.profile(after, **context)


def test_untouched_columns_are_not_scanned(spark, scanned):
    df, profiler = table(spark), DataProfiler()
    context = {"key_columns": ["key", "size", "text.dotted"], "label_col": "group"}
    before = profiler.profile(df, **context)
    changed = materialise(df.withColumn("size", F.greatest("size", F.lit(0))), "after").df
    full = profiler.profile(changed, **context)
    scanned["measures"].clear(), scanned["sets"].clear()
    carried = profiler.profile(changed, **context, carried=Carried(before, frozenset({"size"})))
    assert carried == full
    assert sorted(scanned["measures"]) == ["null_3", "s0"]
    assert sorted(scanned["sets"]) == [FINGERPRINT, ("key", "size", "text.dotted"), ("size",)]
    scanned["measures"].clear(), scanned["sets"].clear()
    assert profiler.profile(df, **context, carried=Carried(before)) == before
    assert scanned == {"measures": [], "sets": []}


def test_carried_sections_are_no_shared_objects(spark):
    df, profiler = table(spark), DataProfiler()
    before = profiler.profile(df, label_col="label")
    again = profiler.profile(df, label_col="label", carried=Carried(before))
    again["outliers"]["price"]["q1"] = again["label_noise"]["label_col"] = "spoilt"
    assert before == profiler.profile(df, label_col="label")


def test_a_column_of_another_type_is_scanned_anew(spark):
    df, profiler = table(spark), DataProfiler()
    before = profiler.profile(df)
    cast = df.withColumn("size", col("size").cast("double"))
    assert profiler.profile(cast, carried=Carried(before)) == profiler.profile(cast)


def test_loop_reports_what_full_profiles_say_from_less(spark, scanned):
    class Full(DataProfiler):
        def profile(self, *args, carried=None, **kwargs):
            return super().profile(*args, **kwargs)

    df = table(spark, copies=True)
    config = PDSAConfig(max_iterations=3, max_outlier_ratio=0.0)
    found = {}
    for profiler in (DataProfiler, Full):
        scanned["measures"].clear()
        with CleaningCycle(profiler()).run(df, ["key"], df.schema, "group") as cycle:
            evaluation = cycle.evaluation
        loop = PDSALoop(pdsa_config=config, profiler=profiler()).run(df, ["key"], df.schema, "group")
        found[profiler] = (loop.cleaned_profile, loop.repair_actions, loop.stop_reason, loop.total_iterations, evaluation)
        found[profiler, "measures"] = len(scanned["measures"])
        loop.close()
    assert found[DataProfiler] == found[Full] and found[Full][3] > 1
    assert found[DataProfiler, "measures"] < found[Full, "measures"]


def test_empty_tables_have_nothing_to_carry(spark):
    df, profiler = table(spark).limit(0), DataProfiler()
    before = profiler.profile(df, label_col="label")
    assert profile_after(profiler, before, df, frozenset(), label_col="label") == before
