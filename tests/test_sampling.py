from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablewright.functions.draws import rank_key
from tablewright.sources import sampling
from tablewright.sources.sampling import sample_rows
from tablewright.sources.storage import shared_folder


def stored_samples(spark):
    return sorted(Path(shared_folder(spark)).glob("sample-*"))


@pytest.mark.parametrize("size", [1, 10, 1000, 9_999])
def test_sample_is_the_rows_with_the_smallest_draws(spark, size):
    df = spark.range(10_000)
    expected = {r[0] for r in df.orderBy(rank_key(7, F.col("id"))).limit(size).collect()}
    found = [r[0] for r in sample_rows(df, size, 7, ["id"]).collect()]
    assert len(found) == size and set(found) == expected


@pytest.mark.parametrize("size", [0, 10_000, 20_000])
def test_no_rows_and_whole_tables(spark, size):
    assert sample_rows(spark.range(10_000), size).count() == min(size, 10_000)


def test_only_the_rows_near_the_sample_are_stored(spark):
    before = stored_samples(spark)
    assert sample_rows(spark.range(200_000), 500).count() == 500
    [new] = [f for f in stored_samples(spark) if f not in before]
    assert 500 <= spark.read.parquet(str(new)).count() < 1_000


def test_copies_are_drawn_one_by_one_from_one_evaluation(spark):
    """Rows that differ at each scan: the sample is what the one scan has seen."""
    df = spark.range(0, 20_000, 1, 8).select(F.lit("copy").alias("text"), F.expr("uuid()").alias("mark"))
    sample = sample_rows(df.select("text", "mark"), 300)
    first, again = (sorted(r["mark"] for r in sample.collect()) for _ in range(2))
    assert first == again and len(set(first)) == 300
    assert sample_rows(df.select("text"), 300).count() == 300


def test_line_is_raised_where_many_rows_share_an_id(spark, monkeypatch):
    """A third of all rows, or all of them, share one draw, wherever it lies."""
    for share, seeds in ((3, range(4)), (1, range(2))):
        df = spark.range(9_000).select(F.when(F.col("id") % share == 0, -1).otherwise(F.col("id")).alias("key"), "id")
        for seed in seeds:
            rows = sample_rows(df, 400, seed, ["key"]).collect()
            assert len(rows) == 400 and len({r["id"] for r in rows}) == 400
    monkeypatch.setattr(sampling, "_DEVIATIONS", 0)
    monkeypatch.setattr(sampling, "_SPARE", -350)
    assert sample_rows(spark.range(9_000), 400, 1, ["id"]).count() == 400


def test_null_ids_and_nulls(spark):
    df = spark.range(2_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("key"), F.lit(None).cast("string").alias("x"))
    assert sample_rows(df, 100, ids=["key"]).count() == 100 and sample_rows(df, 100).count() == 100
