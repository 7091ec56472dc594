"""Repair: schema, missing values, bounds, labels, duplicates, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import DataProfiler, RepairEngine, RepairPolicy
from tablewright.functions.columns import snapshot
from tablewright.operators import bounds, duplicates, fills, labels, layout, outliers, schemas
from tablewright.sources.storage import materialise

from .tables import beyond, capped, dirty_orders, drifted_orders, div, fence, n, stored_orders, table, with_dirty

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


MEDIAN = "(SELECT CAST(quantile_disc(o_totalprice, 0.5) AS DOUBLE) FROM dirty)"


def mode_of(column: str, source: str = "dirty") -> str:
    return (
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


@query(with_dirty(f"SELECT o_orderkey, coalesce(o_totalprice, {MEDIAN}) AS o_totalprice FROM dirty"))
def impute_median(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "o_totalprice")
    return fills.fill(df, fills.medians(df, ["o_totalprice"]))


@query(
    with_dirty(
        """SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM dirty)), 4) AS o_totalprice
           FROM dirty"""
    )
)
def impute_mean(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "o_totalprice")
    filled = fills.fill(df, fills.means(df, ["o_totalprice"]))
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    with_dirty(
        "SELECT o_orderkey, coalesce(o_orderpriority, 'unknown') AS o_orderpriority, "
        "coalesce(o_orderstatus, 'unknown') AS o_orderstatus FROM dirty"
    )
)
def impute_constant(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return fills.fill(df, {"o_orderpriority": "unknown", "o_orderstatus": "unknown"})


@query(
    with_dirty(
        f"SELECT o_orderkey, coalesce(o_orderpriority, {mode_of('o_orderpriority')}) AS o_orderpriority, "
        f"coalesce(o_orderstatus, {mode_of('o_orderstatus')}) AS o_orderstatus FROM dirty"
    )
)
def impute_mode(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return fills.fill(df, fills.modes(df, ["o_orderpriority", "o_orderstatus"]))


@query(
    with_dirty(
        f"SELECT o_orderkey, coalesce(o_totalprice, {mode_of('o_totalprice')}) AS o_totalprice FROM dirty"
    )
)
def impute_numeric_mode(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "o_totalprice")
    return fills.fill(df, fills.modes(df, ["o_totalprice"]))


def _bounds(df, column):
    found = outliers.find_fences(df, outliers.numeric_values(df.select(column)))
    return {c: (f.lower, f.upper) for c, f in found.items() if f.repairable}


@query(f"WITH {fence('f', 'events', 'value')} SELECT event_id, {capped('value', 'f')} AS value FROM events")
def cap_outliers(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    return bounds.cap(df, _bounds(df, "value"))


@query(
    f"""WITH {fence('f', 'documents', 'n_chars')}
    SELECT doc_id, CAST(CASE WHEN n_chars < (SELECT lower_bound FROM f) THEN ceil((SELECT lower_bound FROM f))
        WHEN n_chars > (SELECT upper_bound FROM f) THEN floor((SELECT upper_bound FROM f))
        ELSE n_chars END AS BIGINT) AS n_chars FROM documents"""
)
def cap_keeps_integer_type(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "n_chars")
    return bounds.cap(df, _bounds(df, "n_chars"))


_CEILING = 500000.0


@query(
    with_dirty(
        f"""SELECT o_orderkey, CASE WHEN o_totalprice < (SELECT lower_bound FROM f) THEN (SELECT lower_bound FROM f)
            WHEN o_totalprice > least((SELECT upper_bound FROM f), {_CEILING}::DOUBLE)
              THEN least((SELECT upper_bound FROM f), {_CEILING}::DOUBLE)
            ELSE o_totalprice END AS o_totalprice FROM dirty""",
        fence("f", "dirty", "o_totalprice"),
    )
)
def cap_with_ceiling(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "o_totalprice")
    low, high = _bounds(df, "o_totalprice")["o_totalprice"]
    return bounds.cap(df, {"o_totalprice": (low, min(high, _CEILING))})


@query(
    f"""WITH {fence('f', 'events', 'value')}
    SELECT 'value' AS "column", 'none' AS strategy,
        count(*) FILTER (WHERE {beyond('value', 'f')}) AS outlier_count,
        {n('sum(round(value * 100))')} AS cents FROM events"""
)
def cap_column_override(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    policy = RepairPolicy(outlier_column_strategies={"value": "none"})
    done = RepairEngine(policy).repair(df, DataProfiler().profile(df))
    action = next(a for a in done.actions if a["issue"] == "outliers")
    return done.cleaned_df.agg(
        F.lit(action["column"]).alias("column"),
        F.lit(action["strategy"]).alias("strategy"),
        F.lit(action["outlier_count"]).cast("bigint").alias("outlier_count"),
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
    )


@query(with_dirty("SELECT o_orderkey, o_totalprice, 'v2' AS source_system FROM dirty"))
def align_schema_cast(spark, folder):
    df = drifted_orders(spark, folder).select("o_orderkey", "o_totalprice", "source_system")
    reference = snapshot(table(spark, folder, "orders").select("o_orderkey", "o_totalprice").schema)
    return schemas.align(df, reference)


@query(
    with_dirty(
        """SELECT o_orderkey, TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority,
                  CAST(NULL AS INTEGER) AS o_shippriority FROM dirty"""
    )
)
def align_schema_add_missing(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "o_orderpriority")
    types = {"o_orderkey": "bigint", "o_orderpriority": "int", "o_shippriority": "int"}
    return schemas.align(df, {c: {"data_type": t} for c, t in types.items()})


@query(with_dirty("SELECT o_orderkey, o_totalprice FROM dirty"))
def align_schema_drop_added(spark, folder):
    df = drifted_orders(spark, folder).select("o_orderkey", "o_totalprice", "source_system")
    reference = table(spark, folder, "orders").select("o_orderkey", "o_totalprice").schema
    return schemas.align(df, reference, drop_added=True)


_DATED = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority"


def _dated(df):
    return df.withColumn("o_orderdate", F.to_date("o_orderdate"))


@query(with_dirty(f"SELECT DISTINCT {_DATED} FROM dirty"))
def dedupe_exact(spark, folder):
    return _dated(duplicates.drop_duplicates(dirty_orders(spark, folder)))


@query(
    with_dirty(
        f"""SELECT {_DATED} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
              ORDER BY o_orderkey NULLS FIRST, o_orderstatus NULLS FIRST, o_totalprice NULLS FIRST,
                       o_orderdate NULLS FIRST, o_orderpriority NULLS FIRST) AS place FROM dirty)
            WHERE place = 1"""
    )
)
def dedupe_by_key(spark, folder):
    return _dated(duplicates.drop_duplicates_by_key(dirty_orders(spark, folder), ["o_custkey"]))


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
       WHERE l_quantity BETWEEN 5 AND 40 AND l_discount >= 0.02"""
)
def domain_row_filter(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return bounds.keep_within(df, {"l_quantity": (5.0, 40.0), "l_discount": (0.02, None)})


_AUTO = RepairPolicy()
AUTO_REPAIRED = f"""SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus,
    {capped(f'coalesce(o_totalprice, {MEDIAN})', 'f')} AS o_totalprice, o_orderdate,
    coalesce(o_orderpriority, 'unknown') AS o_orderpriority FROM dirty"""


def _auto_repair(spark, folder):
    df = stored_orders(spark, folder)
    profile = DataProfiler().profile(df, ["o_orderkey"])
    return RepairEngine(_AUTO).repair(df, profile, label_col="o_orderstatus")


@query(
    with_dirty(
        f"SELECT {_DATED} FROM ({AUTO_REPAIRED})",
        fence("f", "dirty", "o_totalprice"),
    )
)
def repair_full(spark, folder):
    return _dated(_auto_repair(spark, folder).cleaned_df)


@query(
    with_dirty(
        f"""SELECT 'missingness' AS issue, 'median' AS strategy, 'o_totalprice' AS "column",
              CAST(NULL AS BIGINT) AS affected, {MEDIAN} AS detail
            UNION ALL SELECT 'missingness', 'constant', 'o_orderpriority', NULL, NULL
            UNION ALL SELECT 'outliers', 'cap', 'o_totalprice',
              (SELECT count(*) FROM dirty WHERE {beyond('o_totalprice', 'f')}), (SELECT upper_bound FROM f)
            UNION ALL SELECT 'duplicates', 'dropDuplicates', NULL,
              (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)), NULL""",
        fence("f", "dirty", "o_totalprice"),
    )
)
def repair_actions(spark, folder):
    actions = _auto_repair(spark, folder).actions_frame()
    get = lambda name, kind: F.try_element_at("details", F.lit(name)).try_cast(kind)
    return actions.select(
        "issue",
        "strategy",
        "column",
        F.coalesce(get("outlier_count", "bigint"), get("duplicate_count", "bigint")).alias("affected"),
        F.coalesce(get("upper_bound", "double"), get("fill_value", "double")).alias("detail"),
    )


_RULES = RepairPolicy(
    numeric_imputation="mode",
    categorical_imputation="mode",
    row_filters={"o_custkey": (2.0, None)},
    cap_limits={"o_totalprice": (None, _CEILING)},
    drop_duplicates=False,
)


@query(
    with_dirty(
        f"""SELECT o_orderkey, o_custkey, coalesce(o_orderpriority, {mode_of('o_orderpriority', 'kept')}) AS o_orderpriority,
              CASE WHEN price < (SELECT lower_bound FROM f) THEN (SELECT lower_bound FROM f)
                   WHEN price > least((SELECT upper_bound FROM f), {_CEILING}::DOUBLE)
                     THEN least((SELECT upper_bound FROM f), {_CEILING}::DOUBLE) ELSE price END AS o_totalprice
            FROM (SELECT *, coalesce(o_totalprice, {mode_of('o_totalprice', 'kept')}) AS price FROM kept)""",
        fence("f", "dirty", "o_totalprice"),
        "kept AS (SELECT * FROM dirty WHERE o_custkey >= 2)",
    )
)
def repair_with_domain_rules(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    profile = DataProfiler().profile(df)
    return RepairEngine(_RULES).repair(df, profile).cleaned_df


@query(
    with_dirty(
        f"""SELECT o_orderkey, o_custkey, o_orderstatus, {capped('o_totalprice', 'f')} AS o_totalprice FROM
            (SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, {MEDIAN}) AS o_totalprice FROM dirty)""",
        fence("f", "dirty", "o_totalprice"),
    )
)
def repair_drifted(spark, folder):
    """Schema drift and missing values and outliers in one column, repaired in one projection."""
    keep = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    df = materialise(drifted_orders(spark, folder).select(*keep, "source_system"), "drifted").df
    reference = table(spark, folder, "orders").select(*keep).schema
    policy = RepairPolicy(drop_added_columns=True, drop_duplicates=False)
    profile = DataProfiler().profile(df, reference_schema=reference)
    repaired = RepairEngine(policy).repair(df, profile, reference, label_col="o_orderstatus")
    return repaired.cleaned_df


@query(
    with_dirty(
        f"""SELECT o_orderkey, {capped('o_totalprice', 'f')} AS o_totalprice, o_orderpriority FROM dirty""",
        fence("f", "dirty", "o_totalprice"),
    )
)
def repair_without_imputation(spark, folder):
    """Imputation and deduplication switched off: only bounds apply, nulls stay."""
    df = dirty_orders(spark, folder).select("o_orderkey", "o_totalprice", "o_orderpriority")
    policy = RepairPolicy(skip_imputation=True, drop_duplicates=False)
    return RepairEngine(policy).repair(df, DataProfiler().profile(df)).cleaned_df


@query(with_dirty("SELECT o_orderkey, o_custkey, o_totalprice FROM dirty"))
def skew_repartition(spark, folder):
    df = dirty_orders(spark, folder).select("o_orderkey", "o_custkey", "o_totalprice")
    return layout.spread_by_key(df, "o_custkey", 8)


_PARTS = 16


@query(
    with_dirty(
        f"""SELECT sum(n) AS rows, {_PARTS} AS partitions, count(*) FILTER (WHERE n > share) AS divided_keys, true AS within_bound
            FROM (SELECT o_custkey, count(*) AS n, (SELECT ceil(count(*) / {_PARTS}.0::DOUBLE) FROM dirty) AS share FROM dirty GROUP BY 1)"""
    )
)
def weighted_placement(spark, folder):
    """No partition has over five quarters of an even share, and only keys above a share are divided."""
    df = dirty_orders(spark, folder).select("o_orderkey", "o_custkey", "o_totalprice")
    placed = layout.place_by_weight(df, "o_custkey", _PARTS).withColumn("at", F.spark_partition_id())
    cells = placed.groupBy("o_custkey", "at").agg(F.count(F.lit(1)).alias("n"))
    keys = cells.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("parts")).agg(F.count_if(F.col("parts") > 1).cast("bigint").alias("divided_keys"))
    sizes = cells.groupBy("at").agg(F.sum("n").alias("n")).agg(
        F.sum("n").cast("bigint").alias("rows"), F.count(F.lit(1)).cast("int").alias("partitions"),
        (F.max("n") * _PARTS <= 1.25 * F.sum("n")).alias("within_bound"))
    return sizes.crossJoin(F.broadcast(keys))  # one row each


_HAS_FEATURES = "o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL"


@query(
    with_dirty(
        f"""SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderstatus IS NOT NULL AND {_HAS_FEATURES}) AS training_rows,
            count(*) FILTER (WHERE o_orderstatus IS NULL AND {_HAS_FEATURES}) AS candidates,
            count(*) FILTER (WHERE o_orderstatus IS NULL AND {_HAS_FEATURES}) AS imputed,
            count(*) FILTER (WHERE o_orderstatus IS NULL AND NOT ({_HAS_FEATURES})) AS still_missing,
            count(o_orderstatus) - count(o_orderstatus) AS labels_changed FROM dirty"""
    )
)
def impute_labels_forest(spark, folder):
    """Three classes: the likeliest has over 0.3, so every candidate gets a label, and no label there was changes."""
    df = stored_orders(spark, folder).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"
    )
    done = labels.impute_labels(df, "o_orderstatus", confidence=0.3)
    changed = df.filter("o_orderstatus IS NOT NULL").exceptAll(done.df).count()
    return done.df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(done.training_rows).alias("training_rows"),
        F.lit(done.candidates).alias("candidates"),
        F.lit(done.imputed).alias("imputed"),
        F.count_if(F.col("o_orderstatus").isNull()).alias("still_missing"),
        F.lit(changed).alias("labels_changed"),
    )


@query(
    with_dirty(
        f"""SELECT count(*) AS total_rows, count(d.o_orderstatus) AS labeled_rows,
            count(*) - count(d.o_orderstatus) AS remaining_missing,
            {div('count(d.o_orderstatus)', 'count(*)')} AS coverage_ratio,
            count(*) FILTER (WHERE d.o_orderstatus = o.o_orderstatus) AS correct_rows,
            {div('count(*) FILTER (WHERE d.o_orderstatus = o.o_orderstatus)', 'count(d.o_orderstatus)')} AS accuracy
        FROM dirty d JOIN orders o USING (o_orderkey)"""
    )
)
def label_recovery(spark, folder):
    return labels.label_recovery(
        dirty_orders(spark, folder), table(spark, folder, "orders"), "o_orderkey", "o_orderstatus"
    )


_KNOWN_AFTER = f"count(*) FILTER (WHERE d.o_orderstatus IS NOT NULL OR {_HAS_FEATURES.replace('o_', 'd.o_')})"


@query(
    with_dirty(
        f"""SELECT count(*) AS total_rows, {_KNOWN_AFTER} AS labeled_rows, count(*) - {_KNOWN_AFTER} AS remaining_missing,
            {div(_KNOWN_AFTER, 'count(*)')} AS coverage_ratio,
            count(*) FILTER (WHERE d.o_orderstatus = o.o_orderstatus) AS correct_before, true AS none_lost
        FROM dirty d JOIN orders o USING (o_orderkey)"""
    )
)
def label_recovery_forest(spark, folder):
    """Without a confidence to reach, every candidate gets a label; labels that were right stay right."""
    df = stored_orders(spark, folder).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"
    )
    truth = table(spark, folder, "orders")
    before = labels.label_recovery(df, truth, "o_orderkey", "o_orderstatus").first()["correct_rows"]
    done = labels.impute_labels(df, "o_orderstatus")
    found = labels.label_recovery(done.df, truth, "o_orderkey", "o_orderstatus")
    return found.select(
        "total_rows", "labeled_rows", "remaining_missing", "coverage_ratio",
        F.lit(before).alias("correct_before"), (F.col("correct_rows") >= before).alias("none_lost"))


# Neighbours that doubles cannot tell apart: integers beyond 2^53, decimals of 22 digits.
_FAR = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 9007199254740992 + o_custkey END"


def _filled_with_median(spark, folder, sql):
    df = table(spark, folder, "orders").selectExpr("o_orderkey", f"{sql} AS v")
    return fills.fill(df, fills.medians(df, ["v"]))


@query(f"""WITH t AS (SELECT o_orderkey, {_FAR} AS v FROM orders)
    SELECT o_orderkey, coalesce(v, (SELECT quantile_disc(v, 0.5) FROM t)) AS v FROM t""")
def impute_median_bigint(spark, folder):
    return _filled_with_median(spark, folder, _FAR)


_LONG_SPARK = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST('12345678901234567890.00' AS DECIMAL(30, 2)) + o_custkey * CAST(0.01 AS DECIMAL(2, 2)) AS DECIMAL(30, 2)) END"
_LONG_DUCK = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST('12345678901234567890.00' AS DECIMAL(30, 2)) + CAST(o_custkey AS DECIMAL(20, 2)) * CAST(0.01 AS DECIMAL(3, 2)) END"


@query(f"""WITH t AS (SELECT o_orderkey, {_LONG_DUCK} AS v FROM orders)
    SELECT o_orderkey, CAST(CAST(coalesce(v, (SELECT v FROM t WHERE v IS NOT NULL ORDER BY v
      LIMIT 1 OFFSET (SELECT (count(v) + 1) // 2 - 1 FROM t))) AS DECIMAL(30, 2)) AS VARCHAR) AS v FROM t""")
def impute_median_decimal(spark, folder):
    return _filled_with_median(spark, folder, _LONG_SPARK).withColumn("v", F.col("v").cast("string"))
