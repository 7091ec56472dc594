"""Headline timings. Prints one JSON line.

All queries run once to warm up and then three times each; the median counts.
``jobs`` has the Spark jobs of one run. The ``per_column`` entries do the same work as the ``fused`` ones, one column or key
at a time, for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalogue.tables import stored_orders, table  # noqa: E402
from tablewright import (  # noqa: E402
    CleaningCycle, DataProfiler, RepairEngine, RepairPolicy, SparkMLRegressionEvaluator, SyntheticDataGenerator,
    SyntheticIssueConfig,
)
from tablewright.operators import completeness, duplicates, fills, labels, outliers, scores  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def outliers_per_column(df: DataFrame) -> None:
    rows = df.count()
    for name in outliers.numeric_values(df):
        q1, q3 = df.approxQuantile(name, [0.25, 0.75], 0.01)
        reach = 1.5 * (q3 - q1)
        beyond = df.filter((F.col(name) < q1 - reach) | (F.col(name) > q3 + reach))
        assert beyond.count() <= rows


def keys_per_key(df: DataFrame) -> None:
    for key in KEYS:
        groups = df.groupBy(key).count()
        repeated = groups.filter(F.col("count") > 1)
        repeated.count()
        repeated.agg(F.sum("count")).collect()
        groups.agg(F.max("count")).collect()
        groups.approxQuantile("count", [0.5], 0.01)


def profile_per_column(df: DataFrame) -> None:
    rows = df.count()
    df.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).collect()
    assert rows >= df.distinct().count()
    outliers_per_column(df)
    keys_per_key(df)
    whole = df.groupBy(*KEYS).count().filter(F.col("count") > 1)
    whole.count()
    whole.agg(F.sum("count")).collect()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lines = table(spark, FOLDER, "lineitem")
    orders = table(spark, FOLDER, "orders")
    dirty = stored_orders(spark, FOLDER)
    label = "o_orderstatus"
    profiler = DataProfiler()
    profile = profiler.profile(dirty, ["o_custkey"])
    order_ids = orders.select(F.col("o_orderkey").alias("row_id"))
    priced = lines.withColumn("predicted", F.col("l_quantity") * 1500.0)
    flagged = lines.withColumn("positive", F.col("l_returnflag") == "R")
    cases = {
        "profile_full": lambda: profiler.profile(lines, KEYS),
        "profile_full_per_column": lambda: profile_per_column(lines),
        "outliers_fused": lambda: run(outliers.outliers(lines)),
        "outliers_sketched": lambda: run(outliers.outliers(lines, exact=False)),
        "outliers_per_column": lambda: outliers_per_column(lines),
        "keys_fused": lambda: run(duplicates.as_key_skew(duplicates.group_census(lines, {k: [k] for k in KEYS}))),
        "keys_per_column": lambda: keys_per_key(lines),
        "missingness": lambda: run(completeness.missingness(dirty)),
        "exact_duplicates": lambda: run(duplicates.exact_duplicates(lines)),
        "dedupe_exact": lambda: run(duplicates.drop_duplicates(dirty)),
        "dedupe_by_key": lambda: run(duplicates.drop_duplicates_by_key(lines, ["l_orderkey"])),
        "modes": lambda: fills.modes(dirty, ["o_orderpriority", "o_totalprice", "o_custkey"]),
        "repair": lambda: run(RepairEngine(RepairPolicy()).repair(dirty, profile, label_col=label).cleaned_df),
        "cleaning_cycle": lambda: CleaningCycle().run(dirty, ["o_custkey"]).close(),
        "generate_houses": lambda: run(
            SyntheticDataGenerator(spark, SyntheticIssueConfig(), order_ids).generate_house_price_dataset().dirty_df
        ),
        "regression_scores": lambda: run(scores.regression_scores(priced, "l_extendedprice", "predicted")),
        "area_under_roc": lambda: run(scores.area_under_roc(flagged, "positive", "l_extendedprice")),
        "label_noise": lambda: labels.estimate_label_noise(dirty, label),
        "linear_regression": lambda: SparkMLRegressionEvaluator().evaluate_one(
            lines, "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"]
        ),
    }
    for case in cases.values():
        case()
    seconds, jobs = {}, {}
    tracker = spark.sparkContext.statusTracker()
    for name, case in cases.items():
        laps = []
        for lap in range(RUNS):
            spark.sparkContext.setJobGroup(f"{name} {lap}", name)
            started = time.perf_counter()
            case()
            laps.append(time.perf_counter() - started)
        jobs[name] = len(tracker.getJobIdsForGroup(f"{name} 0"))
        seconds[name] = round(median(laps), 3)
    ours = {k: v for k, v in seconds.items() if not k.endswith("per_column")}
    result = {
        "metric": "sum of median query seconds",
        "value": round(sum(ours.values()), 3),
        "unit": "sec",
        "queries": ours,
        "per_column_formulation": {k: v for k, v in seconds.items() if k not in ours},
        "jobs": jobs,
        "sf": Path(FOLDER).name.removeprefix("sf"),
        "rows": {"lineitem": lines.count(), "orders": orders.count()},
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
