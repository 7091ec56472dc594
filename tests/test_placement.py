"""Placement of keys by their number of rows."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import layout


def sizes_and_parts(placed, key):
    cells = placed.groupBy(key, F.spark_partition_id().alias("at")).count().collect()
    sizes, parts = {}, {}
    for value, at, n in cells:
        sizes[at] = sizes.get(at, 0) + n
        parts[value] = parts.get(value, 0) + 1
    return sizes, parts


@pytest.mark.parametrize("hot", [0, 3000])
def test_rows_are_even_and_only_large_keys_are_divided(spark, hot):
    rows = [(f"k{i % 700}", i) for i in range(7000)] + [("hot", i) for i in range(hot)] + [(None, i) for i in range(900)] + [("big", i) for i in range(600)]
    df = spark.createDataFrame(rows, "`a.key` string, n long").repartition(5)
    placed = layout.place_by_weight(df, "a.key", 10)
    assert sorted(placed.collect(), key=str) == sorted(df.collect(), key=str)
    sizes, parts = sizes_and_parts(placed, "`a.key`")
    share = len(rows) / 10
    assert len(sizes) == 10 and max(sizes.values()) <= 1.25 * share
    assert {k for k, n in parts.items() if n > 1} == {k for k, n in (("hot", hot), (None, 900), ("big", 600)) if n > share}


def test_small_tables(spark):
    nothing = spark.createDataFrame([], "k long, v string")
    assert layout.place_by_weight(nothing, "k", 3).count() == 0
    one = spark.createDataFrame([(1, "x")], "k long, v string")
    assert [tuple(r) for r in layout.place_by_weight(one, "k", 3).collect()] == [(1, "x")]
    doubles = spark.createDataFrame([(float("nan"),), (float("nan"),), (-0.0,), (0.0,), (None,)], "k double")
    placed = layout.place_by_weight(doubles, "k", 2)
    assert placed.count() == 5


def test_places():
    assert layout._places([], [0, 0], 2)[0] == []
    assert layout._places([5, 4, 3], [], 2) == ([[0], [1], [1]], [])
    keys, groups = layout._places([10], [1, 2, 2], 3)  # a share is five
    assert sorted(keys[0]) == [0, 1] and groups == [2, 2, 2]
