"""Splits, scores and fitted comparisons."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright import (
    DataProfiler, RepairEngine, RepairPolicy, SparkMLClassificationEvaluator, SparkMLRegressionEvaluator,
)
from tablewright.functions.columns import snapshot
from tablewright.operators import categories, features, inject, labels, moments, scores
from tablewright.plans.models import compare_conditions
from tablewright.sources.storage import materialise

from .repairing import AUTO_REPAIRED
from .tables import ORDER_ID, dirty_orders, fence, n, stored_orders, table, u, with_dirty

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


_LINE = "l_orderkey || ':' || l_linenumber || ':' || l_partkey"


def _line_draw(seed: int) -> str:
    return u(seed, _LINE)


_IDS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query(
    f"""SELECT count(*) AS ml_row_count, count(*) FILTER (WHERE {_line_draw(42)} < 0.8) AS train_row_count,
        count(*) FILTER (WHERE NOT {_line_draw(42)} < 0.8) AS test_row_count FROM lineitem"""
)
def hash_split_counts(spark, folder):
    return scores.split_counts(table(spark, folder, "lineitem"), 0.8, 42, _IDS)


@query(
    with_dirty(
        """SELECT CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM dirty
           WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL"""
    )
)
def modelling_rows(spark, folder):
    df = dirty_orders(spark, folder)
    return scores.modelling_rows(df, ["o_custkey", "o_totalprice"], ["o_orderpriority"], "o_orderstatus")


# A rule stands in for a model: orders priced above a line are predicted as open.
_RULED = "(SELECT *, CASE WHEN o_totalprice > 300000 THEN 'O' WHEN o_totalprice > 150000 THEN 'F' ELSE 'P' END AS guess FROM orders)"


def _ruled(spark, folder):
    price = F.col("o_totalprice")
    guess = F.when(price > 300000, "O").when(price > 150000, "F").otherwise("P")
    return table(spark, folder, "orders").withColumn("guess", guess)


_CLASSES = f"""cells AS (SELECT o_orderstatus AS label, guess, count(*) AS c FROM {_RULED} GROUP BY 1, 2),
  actual AS (SELECT label AS class, CAST(sum(c) AS DOUBLE) AS actual,
               CAST(coalesce(sum(c) FILTER (WHERE label = guess), 0) AS DOUBLE) AS correct FROM cells GROUP BY 1),
  guessed AS (SELECT guess AS class, CAST(sum(c) AS DOUBLE) AS guessed FROM cells GROUP BY 1),
  classes AS (SELECT class, coalesce(actual, 0) AS actual, coalesce(correct, 0) AS correct,
                CASE WHEN coalesce(guessed, 0) = 0 THEN 0 ELSE coalesce(correct, 0) / guessed END AS p,
                CASE WHEN coalesce(actual, 0) = 0 THEN 0 ELSE coalesce(correct, 0) / actual END AS r
              FROM actual FULL JOIN guessed USING (class))"""


@query(
    f"""WITH {_CLASSES} SELECT {n('sum(actual)')} AS row_count, round(sum(correct) / sum(actual), 9) AS accuracy,
        round(sum(actual * CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END) / sum(actual), 9) AS f1,
        round(sum(actual * p) / sum(actual), 9) AS weighted_precision,
        round(sum(actual * r) / sum(actual), 9) AS weighted_recall FROM classes"""
)
def confusion_metrics(spark, folder):
    found = scores.classification_scores(_ruled(spark, folder), "o_orderstatus", "guess")
    return found.withColumns(
        {c: F.round(c, 9) for c in ("accuracy", "f1", "weighted_precision", "weighted_recall")}
    )


@query(f"SELECT o_orderstatus AS label, guess AS prediction, count(*) AS n FROM {_RULED} GROUP BY 1, 2")
def confusion_matrix(spark, folder):
    return scores.confusion(_ruled(spark, folder), "o_orderstatus", "guess")


@query(
    f"""WITH s AS (SELECT l_extendedprice AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS p,
          count(*) FILTER (WHERE l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
        r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
        SELECT {n('sum(p)')} AS positives, {n('sum(n)')} AS negatives,
          CAST(sum(p * (2 * below + n)) AS DOUBLE) / (2.0::DOUBLE * CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc
        FROM r"""
)
def auc_rank(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("positive", F.col("l_returnflag") == "R")
    return scores.area_under_roc(df, "positive", "l_extendedprice")


_PREDICTED = "(l_quantity * 1500.0::DOUBLE)"
_ERROR = f"(l_extendedprice - {_PREDICTED})"
_SCORES = f"""count(*) AS row_count, round(sqrt(avg({_ERROR} * {_ERROR})), 4) AS rmse, round(avg(abs({_ERROR})), 4) AS mae,
    round(1 - sum({_ERROR} * {_ERROR}) / (var_pop(l_extendedprice) * count(*)), 6) AS r2"""


def _predicted(spark, folder):
    return table(spark, folder, "lineitem").withColumn("predicted", F.col("l_quantity") * 1500.0)


def _rounded(df):
    return df.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "r2": F.round("r2", 6)})


@query(f"SELECT {_SCORES} FROM lineitem")
def regression_metrics(spark, folder):
    return _rounded(scores.regression_scores(_predicted(spark, folder), "l_extendedprice", "predicted"))


_FOLDS = 5
_FOLD = f"CAST(floor({_line_draw(7)} * {_FOLDS}) AS INTEGER)"


def _fold_scores(spark, folder):
    drawn = scores.with_split(_predicted(spark, folder), 7, _IDS)
    folded = drawn.withColumn("fold", F.floor(F.col(scores.SPLIT_DRAW) * _FOLDS).cast("int"))
    return scores.regression_scores(folded, "l_extendedprice", "predicted", by=["fold"])


@query(
    f"""WITH f AS (SELECT {_FOLD} AS fold, sqrt(avg({_ERROR} * {_ERROR})) AS rmse, avg(abs({_ERROR})) AS mae FROM lineitem GROUP BY 1)
        SELECT 'rmse' AS metric, round(avg(rmse), 4) AS mean, round(stddev_pop(rmse), 4) AS stddev,
          round(min(rmse), 4) AS min, round(max(rmse), 4) AS max FROM f
        UNION ALL SELECT 'mae', round(avg(mae), 4), round(stddev_pop(mae), 4), round(min(mae), 4), round(max(mae), 4) FROM f"""
)
def fold_stability(spark, folder):
    found = scores.stability(_fold_scores(spark, folder), ["rmse", "mae"])
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "stddev", "min", "max")})


def _long(df):
    return df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), F.round(m, 4).alias("value")) for m in ("rmse", "mae")]
            )
        )
    )


@query(
    f"""WITH a AS (SELECT {_SCORES} FROM lineitem), b AS (SELECT {_SCORES} FROM lineitem WHERE l_discount >= 0.05)
        SELECT 'rmse' AS metric, a.rmse AS raw, b.rmse AS cleaned, round(b.rmse - a.rmse, 4) AS delta FROM a, b
        UNION ALL SELECT 'mae', a.mae, b.mae, round(b.mae - a.mae, 4) FROM a, b"""
)
def metric_deltas(spark, folder):
    df = _predicted(spark, folder)
    raw = scores.regression_scores(df, "l_extendedprice", "predicted")
    kept = scores.regression_scores(df.filter("l_discount >= 0.05"), "l_extendedprice", "predicted")
    return scores.score_changes(_long(raw), _long(kept)).withColumn("delta", F.round("delta", 4))


_TRAIN = f"{_line_draw(42)} < 0.8"


_LINES = f"""lines AS (SELECT l_extendedprice AS y, l_quantity AS x, {_TRAIN} AS training FROM lineitem),
  damaged AS (SELECT l_extendedprice AS y, CASE WHEN {_line_draw(20)} < 0.05 THEN 1000.0::DOUBLE ELSE l_quantity END AS x,
    {_TRAIN} AS training FROM lineitem)"""


def _model(source: str) -> str:
    return f"""(SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {source} WHERE training)"""


def _test_errors(source: str) -> str:
    return f"(SELECT y, y - (m.a + m.b * x) AS e FROM {source}, {_model(source)} m WHERE NOT training)"


def _fit_row(source: str) -> str:
    return f"""(SELECT round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(e)), 2) AS mae,
        round(1 - sum(e * e) / (var_pop(y) * count(*)), 3) AS r2 FROM {_test_errors(source)})"""


@query(
    f"""WITH {_LINES}, raw AS {_fit_row('damaged')}, clean AS {_fit_row('lines')}
        SELECT 'rmse' AS metric, raw.rmse AS raw, clean.rmse AS cleaned FROM raw, clean
        UNION ALL SELECT 'mae', raw.mae, clean.mae FROM raw, clean
        UNION ALL SELECT 'r2', raw.r2, clean.r2 FROM raw, clean"""
)
def linreg_raw_vs_clean(spark, folder):
    """Fit and score a line on damaged and on clean data; least squares is exact."""
    clean = table(spark, folder, "lineitem").select(*_IDS, "l_quantity", "l_extendedprice")
    damaged = inject.constant_outliers(clean, "l_quantity", 1000.0, 0.05, ids=_IDS)
    evaluator = SparkMLRegressionEvaluator(id_columns=_IDS)
    found = evaluator.evaluate_linear_regression(damaged, clean, "l_extendedprice", ["l_quantity"], [])
    scored = found.to_frame(spark).filter("metric <> 'ml_row_count'")
    exact = lambda c: F.when(F.col("metric") == "r2", F.round(c, 3)).otherwise(F.round(c, 2))
    return scored.select("metric", exact("raw").alias("raw"), exact("cleaned").alias("cleaned"))


_FEATURES = (["o_custkey", "o_totalprice"], ["o_orderpriority"])


def _repaired(spark, folder):
    df = stored_orders(spark, folder)
    profile = DataProfiler().profile(df)
    cleaned = RepairEngine(RepairPolicy()).repair(df, profile, label_col="o_orderstatus").cleaned_df
    return df, materialise(cleaned, "cleaned").df


_COMPLETE = "o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL"
_POLICY = f"policy AS ({AUTO_REPAIRED})"
_MANUAL = """manual AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
    coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM dirty)"""


@query(
    with_dirty(
        " UNION ALL ".join(
            f"""SELECT '{side}' AS side, count(*) AS ml_row_count, count(*) FILTER (WHERE {u(42)} < 0.8) AS train_row_count,
                count(*) FILTER (WHERE NOT {u(42)} < 0.8) AS test_row_count, true AS in_range, 2 AS folds
                FROM {source} WHERE {_COMPLETE}"""
            for side, source in (("raw", "dirty"), ("cleaned", "policy"))
        ),
        fence("f", "dirty", "o_totalprice"),
        _POLICY,
    )
)
def logreg_raw_vs_clean(spark, folder):
    """Rows and splits of both sides are exact; the scores of a fit can only be held to their range."""
    raw, cleaned = _repaired(spark, folder)
    evaluator = SparkMLClassificationEvaluator(validation_folds=2, id_columns=ORDER_ID)
    found = evaluator.evaluate_logistic_regression(raw, cleaned, "o_orderstatus", *_FEATURES)
    rows = [
        (side, *(m[c] for c in ("ml_row_count", "train_row_count", "test_row_count")),
         all(0 <= m[c] <= 1 for c in ("accuracy", "f1", "weighted_precision", "weighted_recall")), len(m["fold_stability"]["folds"]))
        for side, m in (("raw", found.raw_metrics), ("cleaned", found.cleaned_metrics))
    ]
    return spark.createDataFrame(
        rows, "side string, ml_row_count bigint, train_row_count bigint, test_row_count bigint, in_range boolean, folds int")


@query(
    with_dirty(
        " UNION ALL ".join(
            f"""SELECT '{condition}' AS condition, count(*) AS ml_row_count, true AS in_range,
                {'0.0::DOUBLE' if source == 'dirty' else 'NULL::DOUBLE'} AS delta_of_raw FROM {source} WHERE {_COMPLETE}"""
            for condition, source in (("raw", "dirty"), ("detection_only", "dirty"), ("policy", "policy"), ("manual", "manual"))
        ),
        fence("f", "dirty", "o_totalprice"),
        _POLICY,
        _MANUAL,
    )
)
def four_conditions(spark, folder):
    """As above; detection alone changes nothing, so its scores are those of the raw table."""
    raw, cleaned = _repaired(spark, folder)
    by_hand = raw.fillna({"o_orderpriority": "unknown"}).dropDuplicates()
    conditions = {"raw": raw, "detection_only": raw, "policy": cleaned, "manual": by_hand}
    found = compare_conditions(SparkMLClassificationEvaluator(), conditions, "o_orderstatus", *_FEATURES)
    same = F.when(F.col("condition").isin("raw", "detection_only"), F.abs("accuracy_delta") + F.abs("f1_delta"))
    return found.select(
        "condition", "ml_row_count", (F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1)).alias("in_range"),
        same.alias("delta_of_raw"))


# A label that is a rule of one feature, so that a forest must find it.
_RULE = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' ELSE 'later' END"
_OTHER = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'later' ELSE 'soon' END"


def _by_rule(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.expr(_RULE).alias("when"))


@query(
    f"""SELECT count(*) AS rows_used, count(*) FILTER (WHERE {u(40)} < 0.05) AS suspected,
        count(*) FILTER (WHERE {u(40)} < 0.05) AS flipped FROM orders"""
)
def label_noise_known_flips(spark, folder):
    """The forest suspects exactly the labels that were flipped against the rule."""
    flipped = inject.flipped_labels(_by_rule(spark, folder), "when", "soon", "later", 0.05, ids=ORDER_ID)
    found = labels.estimate_label_noise(flipped.drop("o_orderkey"), "when")
    truth = flipped.filter(F.col("when") != F.expr(_RULE)).count()
    return spark.createDataFrame([(found.rows_used, found.suspected, truth)], "rows_used bigint, suspected bigint, flipped bigint")


@query(f"SELECT count(*) AS rows_used, count(*) FILTER (WHERE {u(40)} < 0.05) AS suspected FROM orders")
def label_noise_out_of_fold(spark, folder):
    """The same with every row scored by a forest that has not seen it."""
    flipped = inject.flipped_labels(_by_rule(spark, folder), "when", "soon", "later", 0.05, ids=ORDER_ID)
    found = labels.estimate_label_noise(flipped.withColumnRenamed("o_orderkey", "key"), "when", folds=3)
    return spark.createDataFrame([(found.rows_used, found.suspected)], "rows_used bigint, suspected bigint")


@query(f"SELECT o_orderkey, {_RULE} AS \"when\" FROM orders")
def impute_labels_by_rule(spark, folder):
    """Labels taken away and imputed are those of the rule, and no other changes."""
    gaps = inject.missing_labels(_by_rule(spark, folder), "when", 0.1, ids=ORDER_ID)
    dated = gaps.withColumn("o_orderkey", F.date_from_unix_date(F.col("o_orderkey").cast("int")))  # a date is no feature
    done = labels.impute_labels(dated, "when")
    return done.df.select(F.unix_date("o_orderkey").cast("bigint").alias("o_orderkey"), "when")


@query(
    """SELECT count(*) AS rows, 1 + count(DISTINCT o_orderpriority) + 1 + count(DISTINCT o_orderstatus) + 1 AS vector_size,
         (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS first_value FROM orders"""
)
def feature_vectors(spark, folder):
    """One slot for a number, one for each value of a text column and one for unknown values."""
    df = table(spark, folder, "orders").select("o_totalprice", "o_orderpriority", "o_orderstatus")
    model = Pipeline(stages=features.feature_stages(["o_totalprice"], ["o_orderpriority", "o_orderstatus"])).fit(df)
    sizes = model.transform(df).select(F.size(vector_to_array(F.col(features.FEATURES))).cast("bigint").alias("vector_size"))
    first = model.stages[0].labelsArray[0][0]
    return sizes.groupBy("vector_size").agg(F.count(F.lit(1)).alias("rows")).withColumn("first_value", F.lit(first))


@query("SELECT count(*) AS rows, count(o_totalprice) AS restored, min(o_totalprice) AS low FROM orders")
def restored_feature_types(spark, folder):
    """Numbers that drifted to text are numbers again when a forest reads them."""
    orders = table(spark, folder, "orders").select("o_totalprice", "o_orderstatus")
    drifted = inject.drifted_schema(orders, {"o_totalprice": "string"})
    reference = snapshot(orders.schema)
    chosen = labels.feature_columns(drifted, "o_orderstatus", reference)
    restored = labels.restore_types(drifted, chosen, reference)
    return restored.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias("restored") for c in chosen.restored],
        *[F.min(c).alias("low") for c in chosen.numeric])


_VALUES = """(SELECT 'part' AS "column", CAST(l_partkey AS VARCHAR) AS value FROM lineitem
    UNION ALL SELECT 'flag', l_returnflag FROM lineitem)"""


def _texts(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_partkey").cast("string").alias("part"), F.col("l_returnflag").alias("flag"))


@query(
    f"""SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) - 1 AS rank
        FROM (SELECT "column", value, count(*) AS n FROM {_VALUES} GROUP BY ALL)"""
)
def feature_index(spark, folder):
    """Values of two text columns numbered by frequency, then by their bytes."""
    return categories.category_index(_texts(spark, folder), ["part", "flag"]).table


@query(
    f"""WITH i AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) - 1 AS rank
          FROM {_VALUES} GROUP BY 1, 2), s AS (SELECT count(*) FILTER (WHERE "column" = 'part') AS parts, count(*) AS all_values FROM i)
        SELECT l_orderkey, l_linenumber, s.all_values + 3 AS places, 1 + p.rank AS part_place, 2 + s.parts + f.rank AS flag_place,
          l_quantity AS total_of_first
        FROM lineitem, s, i p, i f WHERE p."column" = 'part' AND p.value = CAST(l_partkey AS VARCHAR)
          AND f."column" = 'flag' AND f.value = l_returnflag"""
)
def sparse_feature_rows(spark, folder):
    """Each row's sparse vector: one number, then a place for each value of two columns and one for unknown values."""
    rows = _texts(spark, folder)
    index = categories.category_index(rows, ["part", "flag"])
    vectors = categories.sparse_vectors(rows, ["l_quantity"], index, ["l_orderkey", "l_linenumber"], features.FEATURES)
    index.drop()
    stored = spark.read.parquet(vectors.path)  # the vectors as they are stored, a struct
    at = lambda part, i: F.element_at(F.col(features.FEATURES)[part], i).cast("bigint" if part == "indices" else "double")
    return stored.select(
        "l_orderkey", "l_linenumber", F.col(features.FEATURES).size.cast("bigint").alias("places"), at("indices", 2).alias("part_place"),
        at("indices", 3).alias("flag_place"), at("values", 1).alias("total_of_first"))


def _lines_in_folds(spark, folder):
    draw = scores.with_split(table(spark, folder, "lineitem"), 7, _IDS)
    return draw.select("l_quantity", "l_extendedprice", F.floor(F.col(scores.SPLIT_DRAW) * _FOLDS).cast("int").alias("fold"))


_FOLD_FITS = f"""lines AS (SELECT l_extendedprice AS y, l_quantity AS x, {_FOLD} AS fold FROM lineitem), folds AS (SELECT DISTINCT fold FROM lines),
    fits AS (SELECT f.fold, count(*) AS training_rows, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
             FROM folds f JOIN lines l ON l.fold <> f.fold GROUP BY f.fold),
    tests AS (SELECT fold, a, b, training_rows, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y) AS r2
              FROM (SELECT *, y - (a + b * x) AS e FROM lines JOIN fits USING (fold)) GROUP BY ALL)"""


def _fold_fits(spark, folder):
    lines = _lines_in_folds(spark, folder)
    mask = moments.split_mask([F.col("fold") != f for f in range(_FOLDS)])
    rows = lines.withColumn(moments.SPLITS, mask).drop("fold")
    index = categories.category_index(rows, [])
    try:
        return moments.fit_splits(rows, "l_extendedprice", ["l_quantity"], index, _FOLDS)
    finally:
        index.drop()


@query(
    f"""WITH {_FOLD_FITS} SELECT fold, training_rows, round(b, 6) AS slope, round(a, 4) AS intercept, round(rmse, 4) AS rmse,
        round(mae, 4) AS mae, round(r2, 8) AS r2 FROM tests"""
)
def linreg_folds(spark, folder):
    """Five fits, each on four folds and scored on the fifth, from one scan for all products and one for all scores."""
    fits, found, sums = _fold_fits(spark, folder)
    rows = [
        (f, n, round(fit.numeric["l_quantity"], 6), round(fit.raw_intercept, 4), round(m["rmse"], 4), round(m["mae"], 4), round(m["r2"], 8))
        for f, (fit, m, n) in enumerate(zip(fits, found, sums["training"]))
    ]
    return spark.createDataFrame(
        rows, "fold int, training_rows bigint, slope double, intercept double, rmse double, mae double, r2 double")


@query(
    f"""WITH {_FOLD_FITS}, long AS (SELECT 'rmse' AS metric, rmse AS v FROM tests UNION ALL SELECT 'mae', mae FROM tests)
        SELECT metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS stddev, round(min(v), 4) AS min, round(max(v), 4) AS max
        FROM long GROUP BY metric"""
)
def fold_stability_refit(spark, folder):
    """Mean and spread of scores over folds that are each fitted anew."""
    _, found, _ = _fold_fits(spark, folder)
    per_fold = spark.createDataFrame([(m["rmse"], m["mae"]) for m in found], "rmse double, mae double")
    spread = scores.stability(per_fold, ["rmse", "mae"])
    return spread.withColumns({c: F.round(c, 4) for c in ("mean", "stddev", "min", "max")})


@query(
    """WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
       SELECT l_returnflag, l_linestatus, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM n"""
)
def logreg_saturated(spark, folder):
    """With one text column as only feature, a fit's probabilities are the shares of the labels in each group."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus")
    evaluator = SparkMLClassificationEvaluator(iterations=200, tolerance=1e-12)
    found = evaluator.class_probabilities(lines, "l_linestatus", [], ["l_returnflag"], ["l_returnflag"])
    groups = found.groupBy("l_returnflag", "class").agg(F.avg("probability").alias("share"))
    return groups.select("l_returnflag", F.col("class").alias("l_linestatus"), F.round("share", 6).alias("share"))
