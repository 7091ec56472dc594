"""Cycles and comparisons over one table that take what an earlier one found of it."""

from catalogue import evaluating
from tablewright import CleaningCycle, DataProfiler, SparkMLRegressionEvaluator

FOLDER = "/root/testdata/sf0.001"


def test_logged_runs_profile_the_raw_table_once(spark, monkeypatch):
    profiled, profile = [], DataProfiler.profile
    monkeypatch.setattr(DataProfiler, "profile", lambda self, df, *a, **k: profiled.append(df) or profile(self, df, *a, **k))
    rows = evaluating.run_summary(spark, FOLDER).collect()
    assert len(rows) == 3 and len(profiled) == 4  # the raw table and three cleaned ones
    first, again = (next(r for r in rows if r["run_name"] == name) for name in ("orders_auto", "orders_again"))
    assert first[1:] == again[1:]


def test_given_profile_gives_the_same_cycle(spark):
    df = evaluating.stored_orders(spark, FOLDER)
    with CleaningCycle().run(df, evaluating.KEYS) as first, CleaningCycle().run(df, evaluating.KEYS, raw_profile=first.raw_profile) as second:
        assert second.evaluation == first.evaluation and second.repair_actions == first.repair_actions
        assert second.raw_profile == first.raw_profile and second.raw_profile is not first.raw_profile


def test_given_scores_of_the_raw_table_are_taken(spark):
    df = evaluating.stored_orders(spark, FOLDER)
    clean = df.filter("o_totalprice < 9999999")
    evaluator = SparkMLRegressionEvaluator(id_columns=["o_orderkey"])
    first = evaluator.evaluate_linear_regression(df, clean, "o_totalprice", ["o_custkey"], [])
    assert evaluator.evaluate_linear_regression(None, clean, "o_totalprice", ["o_custkey"], [], first.raw_metrics) == first
