"""Detection: missing values, duplicates, outliers, skew, schema, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import DataProfiler, RepairEngine, RepairPolicy
from tablewright.functions.columns import snapshot
from tablewright.operators import completeness, duplicates, labels, outliers, schemas
from tablewright.plans.profiler import flagged
from tablewright.plans.verify import verify_profiler_accuracy

from .tables import (
    DIRTY, ORDER_COLUMNS, ORDER_NUMBERS, beyond, dirty_orders, div, drifted_orders, events_with_nan,
    fence, grade, n, stored_orders, table, u, with_dirty,
)

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _missing_row(source: str, column: str, nan: bool) -> str:
    nans = f"count(*) FILTER (WHERE isnan({column}))" if nan else "0"
    nulls = f"count(*) FILTER (WHERE {column} IS NULL)"
    return (
        f"SELECT '{column}' AS \"column\", count(*) AS row_count, {nulls} AS null_count, "
        f"{n(nans)} AS nan_count, {n(f'{nulls} + {nans}')} AS missing_count FROM {source}"
    )


def _missing_table(source: str, columns: dict[str, bool]) -> str:
    rows = " UNION ALL ".join(_missing_row(source, c, nan) for c, nan in columns.items())
    share = div("missing_count", "row_count")
    return f"SELECT *, {share} AS missing_ratio, {grade('missingness', share)} AS severity FROM ({rows})"


ORDER_NAN = {c: c == "o_totalprice" for c in ORDER_COLUMNS}


@query(with_dirty(_missing_table("dirty", ORDER_NAN)))
def missingness_profile(spark, folder):
    return completeness.missingness(dirty_orders(spark, folder))


@query(
    f"""WITH e AS (SELECT event_id, ts, user_id, event_type,
          CASE WHEN {u(70, 'event_id')} < 0.03 THEN 'nan'::DOUBLE ELSE value END AS value, props FROM events)
    """
    + _missing_table(
        "e", {c: c == "value" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")}
    )
)
def missingness_with_nan(spark, folder):
    return completeness.missingness(events_with_nan(spark, folder))


def _duplicates_tail(count: str, rows: str) -> str:
    return f"{div(count, rows)} AS duplicate_ratio, {grade('duplicates', div(count, rows))} AS severity"


@query(
    with_dirty(
        f"""SELECT row_count, distinct_count, row_count - distinct_count AS duplicate_count,
            {_duplicates_tail('(row_count - distinct_count)', 'row_count')}
        FROM (SELECT (SELECT count(*) FROM dirty) AS row_count,
                     (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS distinct_count)"""
    )
)
def exact_duplicates(spark, folder):
    return duplicates.exact_duplicates(dirty_orders(spark, folder))


def _key_row(source: str, keys: str, name: str) -> str:
    return f"""SELECT '{name}' AS key, {n('sum(c)')} AS row_count,
        count(*) FILTER (WHERE c > 1) AS duplicate_group_count,
        {n('coalesce(sum(c) FILTER (WHERE c > 1), 0)')} AS duplicate_row_count,
        {n('coalesce(sum(c - 1) FILTER (WHERE c > 1), 0)')} AS duplicate_excess_count
        FROM (SELECT {keys}, count(*) AS c FROM {source} GROUP BY {keys})"""


LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]


@query(
    "SELECT *, "
    + _duplicates_tail("duplicate_row_count", "row_count")
    + ", CAST(NULL AS VARCHAR) AS error FROM ("
    + " UNION ALL ".join(_key_row("lineitem", k, k) for k in LINE_KEYS)
    + ") UNION ALL SELECT 'no_such_column', NULL, NULL, NULL, NULL, NULL, NULL, "
    "'The table has no column ''no_such_column''.'"
)
def key_duplicates(spark, folder):
    return duplicates.key_duplicates(table(spark, folder, "lineitem"), [*LINE_KEYS, "no_such_column"])


@query(
    with_dirty(
        "SELECT *, "
        + _duplicates_tail("duplicate_row_count", "row_count")
        + f" FROM ({_key_row('dirty', 'o_custkey, o_orderpriority', 'o_custkey,o_orderpriority')})"
    )
)
def composite_key_duplicates(spark, folder):
    return duplicates.composite_key_duplicates(dirty_orders(spark, folder), ["o_custkey", "o_orderpriority"])


def _skew_row(source: str, key: str) -> str:
    return f"""SELECT '{key}' AS key, count(*) AS group_count, max(c) AS max_count,
        CAST(quantile_disc(c, 0.5) AS DOUBLE) AS median_count,
        {div('max(c)', 'quantile_disc(c, 0.5)')} AS skew_ratio,
        {grade('skew', div('max(c)', 'quantile_disc(c, 0.5)'))} AS severity
        FROM (SELECT {key}, count(*) AS c FROM {source} GROUP BY {key})"""


@query(
    with_dirty(
        " UNION ALL ".join(
            [_skew_row("dirty", k) for k in ("o_custkey", "o_orderstatus", "o_orderpriority")]
            + [_skew_row("documents", k) for k in ("lang", "source")]
        )
    )
)
def key_skew(spark, folder):
    of_orders = duplicates.key_skew(
        dirty_orders(spark, folder), ["o_custkey", "o_orderstatus", "o_orderpriority"]
    )
    return of_orders.unionByName(duplicates.key_skew(table(spark, folder, "documents"), ["lang", "source"]))


def _outlier_row(source: str, column: str, name: str) -> str:
    out = f"count(*) FILTER (WHERE {beyond(column, name)})"
    return f"""SELECT '{column}' AS "column",
        (SELECT q1 FROM {name}) AS q1, (SELECT q3 FROM {name}) AS q3, (SELECT iqr FROM {name}) AS iqr,
        (SELECT lower_bound FROM {name}) AS lower_bound, (SELECT upper_bound FROM {name}) AS upper_bound,
        {out} AS outlier_count, count({column}) AS valid_count, count(*) AS row_count,
        CASE WHEN (SELECT iqr FROM {name}) = 0 THEN 'zero_iqr_deviation' ELSE 'iqr' END AS method,
        (SELECT iqr FROM {name}) <> 0 AS repairable,
        {div(out, 'count(*)')} AS outlier_ratio,
        {grade('outliers', div(out, 'count(*)'))} AS severity FROM {source}"""


def _outlier_table(columns: dict[str, str], before: str = "") -> str:
    fences = [fence(f"f_{c}", source, c) for c, source in columns.items()]
    rows = " UNION ALL ".join(_outlier_row(s, c, f"f_{c}") for c, s in columns.items())
    return "WITH " + ", ".join(([before] if before else []) + fences) + " " + rows


@query(_outlier_table({"value": "events", "n_chars": "documents"}))
def outlier_profile_iqr(spark, folder):
    events = outliers.outliers(table(spark, folder, "events"), ["value"])
    documents = outliers.outliers(table(spark, folder, "documents"), ["n_chars"])
    return events.unionByName(documents)


@query(_outlier_table({"quality": "labels", "toxic": "labels"}))
def outlier_profile_zero_iqr(spark, folder):
    return outliers.outliers(table(spark, folder, "labels"), ["quality", "toxic"])


LINE_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)


@query(_outlier_table({c: "lineitem" for c in LINE_NUMBERS}))
def outlier_profile_wide(spark, folder):
    return outliers.outliers(table(spark, folder, "lineitem"))


@query(_outlier_table({c: "dirty" for c in ORDER_NUMBERS}, DIRTY))
def outlier_profile_restored_type(spark, folder):
    reference = snapshot(table(spark, folder, "orders").schema)
    return outliers.outliers(drifted_orders(spark, folder), reference=reference)


ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
    "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


@query(
    with_dirty(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{t}' AS data_type, true AS nullable, count({c}) AS value_count FROM dirty"
            for c, t in ORDER_TYPES.items()
        )
    )
)
def schema_profile(spark, folder):
    return schemas.schema_profile(dirty_orders(spark, folder))


@query(
    with_dirty(
        """SELECT 'added' AS change, 'source_system' AS "column", CAST(NULL AS VARCHAR) AS reference_type,
                  'string' AS current_type, CAST(0 AS BIGINT) AS lost_values, count(*) AS row_count FROM dirty
           UNION ALL SELECT 'removed', 'o_orderdate', 'timestamp_ntz', NULL, 0, count(*) FROM dirty
           UNION ALL SELECT 'type_change', 'o_totalprice', 'double', 'string',
                  count(*) FILTER (WHERE o_totalprice IS NOT NULL
                    AND TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) IS NULL), count(*) FROM dirty
           UNION ALL SELECT 'type_change', 'o_orderpriority', 'int', 'string',
                  count(*) FILTER (WHERE o_orderpriority IS NOT NULL
                    AND TRY_CAST(o_orderpriority AS INTEGER) IS NULL), count(*) FROM dirty"""
    )
)
def schema_drift(spark, folder):
    reference = snapshot(table(spark, folder, "orders").schema)
    reference["o_orderpriority"] = {"data_type": "int", "nullable": True}
    return schemas.schema_drift(drifted_orders(spark, folder), reference)


@query(
    with_dirty(
        f"""SELECT count(*) AS row_count,
            count(*) FILTER (WHERE o_orderstatus IS NULL) AS label_null_count,
            count(DISTINCT o_orderstatus) + CASE WHEN count(*) > count(o_orderstatus) THEN 1 ELSE 0 END
              AS distinct_label_count,
            {div('count(*) FILTER (WHERE o_orderstatus IS NULL)', 'count(*)')} AS label_null_ratio
        FROM dirty"""
    )
)
def label_stats(spark, folder):
    return labels.label_stats(dirty_orders(spark, folder), "o_orderstatus")


PROFILE_KEYS = ["o_custkey", "o_orderpriority"]


def _profile(spark, folder):
    df = stored_orders(spark, folder)
    reference = snapshot(table(spark, folder, "orders").schema)
    return DataProfiler().profile(df, PROFILE_KEYS, reference)


_FENCES = [fence(f"f_{c}", "dirty", c) for c in ORDER_NUMBERS]
_GROUPS = [
    f"g_{k} AS (SELECT count(*) AS c FROM dirty GROUP BY {k})" for k in PROFILE_KEYS
] + ["g_both AS (SELECT count(*) AS c FROM dirty GROUP BY o_custkey, o_orderpriority)"]


def _fact(section: str, name: str, measure: str, value: str, source: str) -> str:
    return (
        f"SELECT '{section}' AS section, '{name}' AS name, '{measure}' AS measure, "
        f"CAST({value} AS DOUBLE) AS value FROM {source}"
    )


_FACTS = (
    [_fact("row_count", "", "", "count(*)", "dirty")]
    + [
        _fact("missingness", c, "missing_count", f"count(*) - count({c})", "dirty")
        for c in ORDER_COLUMNS
    ]
    + [
        _fact("outliers", c, "outlier_count", f"count(*) FILTER (WHERE {beyond(c, f'f_{c}')})", "dirty")
        for c in ORDER_NUMBERS
    ]
    + [_fact("outliers", c, b, b, f"f_{c}") for c in ORDER_NUMBERS for b in ("q1", "q3", "lower_bound", "upper_bound")]
    + [
        _fact(
            "duplicates", "exact", "duplicate_count",
            "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))", "dirty",
        )
    ]
    + [
        _fact("duplicates", k, m, v, f"g_{g}")
        for k, g in (("o_custkey", "o_custkey"), ("o_orderpriority", "o_orderpriority"), ("composite", "both"))
        for m, v in (
            ("duplicate_group_count", "count(*) FILTER (WHERE c > 1)"),
            ("duplicate_row_count", "coalesce(sum(c) FILTER (WHERE c > 1), 0)"),
        )
    ]
    + [
        _fact("skew", k, m, v, f"g_{k}")
        for k in PROFILE_KEYS
        for m, v in (("max_count", "max(c)"), ("median_count", "quantile_disc(c, 0.5)"))
    ]
)


@query(with_dirty(" UNION ALL ".join(_FACTS), *_FENCES, *_GROUPS))
def full_profile(spark, folder):
    report = _profile(spark, folder)
    rows = [("row_count", "", "", report["row_count"])]
    for c, e in report["missingness"].items():
        rows.append(("missingness", c, "missing_count", e["missing_count"]))
    for c, e in report["outliers"].items():
        for m in ("outlier_count", "q1", "q3", "lower_bound", "upper_bound"):
            rows.append(("outliers", c, m, e[m]))
    rows.append(("duplicates", "exact", "duplicate_count", report["duplicates"]["duplicate_count"]))
    groups = report["duplicates"]["by_key"] | {"composite": report["duplicates"]["composite_key"]}
    for k, e in groups.items():
        for m in ("duplicate_group_count", "duplicate_row_count"):
            rows.append(("duplicates", k, m, e[m]))
    for k, e in report["skew"].items():
        for m in ("max_count", "median_count"):
            rows.append(("skew", k, m, e[m]))
    return spark.createDataFrame(
        [(s, name, m, float(v)) for s, name, m, v in rows],
        "section string, name string, measure string, value double",
    )


@query(
    with_dirty(
        "SELECT "
        + " + ".join(f"(SELECT CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END FROM dirty)" for c in ORDER_COLUMNS)
        + " AS missingness_cols_flagged, "
        + "(SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates_detected, "
        + " + ".join(
            f"(SELECT CASE WHEN count(*) FILTER (WHERE {beyond(c, f'f_{c}')}) > 0 THEN 1 ELSE 0 END FROM dirty)"
            for c in ORDER_NUMBERS
        )
        + " AS outlier_cols_flagged, false AS schema_drift_detected, "
        + " + ".join(
            f"(SELECT CASE WHEN {div('max(c)', 'quantile_disc(c, 0.5)')} > 5 THEN 1 ELSE 0 END FROM g_{k})"
            for k in PROFILE_KEYS
        )
        + " AS skew_cols_flagged",
        *_FENCES,
        *_GROUPS,
    )
)
def severity_flags(spark, folder):
    counts = flagged(_profile(spark, folder))
    return spark.createDataFrame(
        [tuple(counts.values())],
        "missingness_cols_flagged int, duplicates_detected bigint, outlier_cols_flagged int, "
        "schema_drift_detected boolean, skew_cols_flagged int",
    )


@query(
    with_dirty(
        f"""SELECT 'missingness' AS dimension,
              {n(' + '.join(f'(count(*) - count({c}))' for c in ORDER_COLUMNS))} AS ground_truth,
              {n(' + '.join(f'(count(*) - count({c}))' for c in ORDER_COLUMNS))} AS profiled,
              true AS exact_match, 100.0::DOUBLE AS accuracy_pct FROM dirty
            UNION ALL SELECT 'duplicates', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)),
              count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)), true, 100.0 FROM dirty"""
    )
)
def profiler_ground_truth(spark, folder):
    df = stored_orders(spark, folder)
    found = verify_profiler_accuracy(df, DataProfiler().profile(df))
    rows = [
        (d, found[d][f"ground_truth_{c}"], found[d][f"profiler_{c}"], found[d]["exact_match"], found[d]["detection_accuracy_pct"])
        for d, c in (("missingness", "null_count"), ("duplicates", "duplicate_count"))
    ]
    return spark.createDataFrame(
        rows, "dimension string, ground_truth bigint, profiled bigint, exact_match boolean, accuracy_pct double"
    )


@query(
    with_dirty(
        """SELECT count(*) AS rows_used, true AS suspected_some_not_all, true AS confidence_in_range, true AS low_in_range FROM dirty
           WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL"""
    )
)
def label_noise_forest(spark, folder):
    """The rows used are exact; what a forest says of a real label can only be held to its range."""
    df = dirty_orders(spark, folder).select("o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    found = labels.estimate_label_noise(df, "o_orderstatus")
    rows = found.rows_used
    return spark.createDataFrame(
        [(rows, found.suspected < rows, 1 / 3 <= found.average_confidence <= 1, 0 <= found.low_confidence <= rows)],
        "rows_used bigint, suspected_some_not_all boolean, confidence_in_range boolean, low_in_range boolean",
    )


@query(
    """SELECT count(*) AS row_count, count(DISTINCT lower(o_orderpriority)) AS distinct_count,
         count(*) - count(DISTINCT lower(o_orderpriority)) AS duplicate_count, count(DISTINCT lower(o_orderpriority)) AS rows_left FROM orders"""
)
def exact_duplicates_collated(spark, folder):
    """Texts under a collation that ignores case: the profile, the count and the repair agree on copies."""
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    df = table(spark, folder, "orders").select(F.collate(mixed, "UTF8_LCASE").alias("priority"))
    profile = DataProfiler().profile(df)
    left = RepairEngine(RepairPolicy()).repair(df, profile).cleaned_df
    return duplicates.exact_duplicates(df).select(
        "row_count", "distinct_count", F.lit(profile["duplicates"]["duplicate_count"]).cast("bigint").alias("duplicate_count"),
        F.lit(left.count()).alias("rows_left"))
