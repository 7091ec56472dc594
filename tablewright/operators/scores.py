"""Model scores as aggregates over a table of predictions, and data splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, ratio
from ..functions.draws import row_identity, uniform
from .features import complete_rows
from .schemas import cast_to

SPLIT_DRAW = "__draw"


def modelling_rows(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    numeric_label: bool = False,
    ids: Sequence[str] = (),
) -> DataFrame:
    """Only features and label, numbers as doubles, complete rows only.

    Id columns that are no features come along as they are.
    """
    columns = {c: cast_to(col(c), "double") for c in numeric} | {c: col(c) for c in categorical}
    columns[label] = cast_to(col(label), "double") if numeric_label else col(label)
    carried = [c for c in ids if c not in columns]
    chosen = df.select(*[e.alias(c) for c, e in columns.items()], *map(col, carried))
    return complete_rows(chosen, list(columns))


def with_split(df: DataFrame, seed: int, ids: Sequence[str] | None = None) -> DataFrame:
    """Add the draw that places a row in training or test.

    It hashes the row (or the given id columns), so both sides are disjoint
    and complete even when a lost task is computed again. Equal rows share a
    side.
    """
    return df.withColumn(SPLIT_DRAW, uniform(seed, *row_identity(df, ids)))


def split(
    df: DataFrame, train_fraction: float, seed: int, ids: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    drawn = with_split(df, seed, ids)
    in_training = F.col(SPLIT_DRAW) < train_fraction
    return drawn.filter(in_training).drop(SPLIT_DRAW), drawn.filter(~in_training).drop(SPLIT_DRAW)


def split_counts(df: DataFrame, train_fraction: float, seed: int, ids: Sequence[str] | None = None) -> DataFrame:
    """One row with the sizes of the whole, training and test data."""
    drawn = with_split(df, seed, ids)
    in_training = F.col(SPLIT_DRAW) < train_fraction
    return drawn.agg(
        F.count(F.lit(1)).alias("ml_row_count"),
        F.count_if(in_training).alias("train_row_count"),
        F.count_if(~in_training).alias("test_row_count"),
    )


def confusion(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    return predictions.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_scores(
    predictions: DataFrame, label: str, prediction: str, by: Sequence[str] = (), label_classes: bool = False
) -> DataFrame:
    """Accuracy, F1, weighted precision and recall from one pass over the predictions.

    The rows collapse to the confusion matrix first; everything after works on
    classes. ``by`` gives one row of scores per group, ``label_classes`` the number of
    classes that labels have.
    """
    cells = predictions.groupBy(
        *map(col, by), col(label).alias("label"), col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(nothing)
    sides = cells.select(
        *map(col, by),
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), nothing.alias("predicted"), hit.alias("correct")),
                F.struct(F.col("prediction").alias("class"), nothing.alias("actual"), F.col("n").alias("predicted"), nothing.alias("correct")),
            )
        ),
    )
    classes = sides.groupBy(*map(col, by), "class").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("actual", "predicted", "correct")]
    )
    precision = ratio(F.col("correct"), F.col("predicted"))
    recall = ratio(F.col("correct"), F.col("actual"))
    f1 = ratio(2 * precision * recall, precision + recall)
    grouped = classes.groupBy(*map(col, by)) if by else classes.groupBy()
    total = F.sum("actual")
    return grouped.agg(
        total.cast("bigint").alias("row_count"),
        ratio(F.sum("correct"), total).alias("accuracy"),
        ratio(F.sum(F.col("actual") * f1), total).alias("f1"),
        ratio(F.sum(F.col("actual") * precision), total).alias("weighted_precision"),
        ratio(F.sum(F.col("actual") * recall), total).alias("weighted_recall"),
        *([F.count_if(F.col("actual") > 0).alias("label_classes")] if label_classes else []),
    )


def area_under_roc(predictions: DataFrame, positive: str, score: str) -> DataFrame:
    """Exact AUC: the share of (positive, negative) pairs ranked right, ties half.

    Rows collapse to counts per score, so a score shared by many rows is one row.
    The scores are range-partitioned, each range is ranked on its own, and the
    ranges are then chained by their totals. There are as many ranges as shuffle
    partitions, so no task holds more than its share of the scores and the last
    one only one row per range. Counts stay whole numbers until the division.
    """
    label = F.coalesce(col(positive).cast("boolean"), F.lit(False))
    by_score = predictions.groupBy(col(score).cast("double").alias("s")).agg(
        F.count_if(label).alias("p"), F.count_if(~label).alias("n")
    )
    ranges = by_score.repartitionByRange("s").withColumn("b", F.spark_partition_id())
    ranked = ranges.withColumn("below", _negatives_before(Window.partitionBy("b").orderBy("s")))
    pairs = F.col("p").cast("decimal(38,0)") * (2 * F.col("below") + F.col("n"))
    totals = ranked.groupBy("b").agg(
        F.min("s").alias("start"), F.sum(pairs).alias("inner"), F.sum("p").alias("p"), F.sum("n").alias("n")
    )
    chained = totals.withColumn("below", _negatives_before(Window.partitionBy(F.lit(0)).orderBy("start")))
    right = F.sum(F.col("inner") + 2 * F.col("p").cast("decimal(38,0)") * F.col("below"))
    return chained.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("negatives"),
        F.coalesce(right, F.lit(0)).cast("decimal(38,0)").alias("twice_pairs_right"),
    ).select(
        "positives",
        "negatives",
        F.try_divide(
            F.col("twice_pairs_right").cast("double"),
            2.0 * F.col("positives").cast("double") * F.col("negatives").cast("double"),
        ).alias("auc"),
    )


def _negatives_before(window):
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(earlier), F.lit(0))


def regression_scores(predictions: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R squared in one aggregate, overall or per group."""
    error = col(label).cast("double") - col(prediction).cast("double")
    actual = col(label).cast("double")
    grouped = predictions.groupBy(*map(col, by)) if by else predictions.groupBy()
    sums = grouped.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(error * error).alias("sse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.var_pop(actual) * F.count(actual)).alias("sst"),
    )
    return sums.select(
        *map(col, by),
        "row_count",
        F.sqrt(F.try_divide(F.col("sse"), F.col("row_count").cast("double"))).alias("rmse"),
        "mae",
        (1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"),
    )


def stability(fold_scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum of each metric over folds."""
    one_row = fold_scores.agg(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.avg(m).alias("mean"),
                F.stddev_pop(m).alias("stddev"),
                F.min(m).alias("min"),
                F.max(m).alias("max"),
            ).alias(f"m{i}")
            for i, m in enumerate(metrics)
        ]
    )
    return one_row.select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(metrics))])))


def score_changes(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Join two (metric, value) tables into raw, cleaned and delta per metric."""
    before = raw.select("metric", F.col("value").alias("raw"))
    after = cleaned.select("metric", F.col("value").alias("cleaned"))
    return before.join(after, "metric", "full_outer").withColumn("delta", F.col("cleaned") - F.col("raw"))
