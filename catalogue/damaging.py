"""Injected issues and generated datasets, driven by the ids of the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import DataProfiler, SyntheticDataGenerator, SyntheticIssueConfig
from tablewright.functions.columns import col
from tablewright.operators import inject
from tablewright.plans.synthetic import (
    CONDITION_VALUE, CONDITIONS, DEPARTMENT_PAY, DEPARTMENTS, EDUCATION, EDUCATION_PAY, EMPLOYMENT,
    GENERIC_CATEGORIES, GENERIC_OFFSETS, HOUSE_TYPE_VALUE, HOUSE_TYPES, LOCATIONS,
    NEIGHBORHOOD_VALUE, NEIGHBORHOODS, dirty_table,
)
from tablewright.plans.verify import detection_table, injected_rates

from .tables import ORDER_ID, beyond, fence, table, u

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _orders(spark, folder, *columns):
    return table(spark, folder, "orders").select("o_orderkey", *columns)


@query(f"SELECT o_orderkey, CASE WHEN {u(10)} < 0.05 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders")
def inject_missing(spark, folder):
    return inject.missing_values(_orders(spark, folder, "o_totalprice"), "o_totalprice", 0.05, ids=ORDER_ID)


@query(f"SELECT o_orderkey, CASE WHEN {u(20)} < 0.03 THEN 1e7::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def inject_outliers(spark, folder):
    df = _orders(spark, folder, "o_totalprice")
    return inject.constant_outliers(df, "o_totalprice", 1e7, 0.03, ids=ORDER_ID)


@query(f"SELECT o_orderkey, CASE WHEN {u(30)} < 0.6 THEN 7 ELSE o_custkey END AS o_custkey FROM orders")
def inject_heavy_key(spark, folder):
    return inject.heavy_key(_orders(spark, folder, "o_custkey"), "o_custkey", 7, 0.6, ids=ORDER_ID)


@query(
    f"""SELECT o_orderkey, CASE WHEN {u(40)} < 0.05 THEN CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'F' END
        ELSE o_orderstatus END AS o_orderstatus FROM orders"""
)
def inject_label_flip(spark, folder):
    df = _orders(spark, folder, "o_orderstatus")
    return inject.flipped_labels(df, "o_orderstatus", "F", "O", 0.05, ids=ORDER_ID)


@query(
    f"""SELECT o_orderkey, CASE WHEN {u(40)} < 0.05 THEN o_totalprice + 300000.0::DOUBLE ELSE o_totalprice END
        AS o_totalprice FROM orders"""
)
def inject_target_noise(spark, folder):
    df = _orders(spark, folder, "o_totalprice")
    return inject.target_noise(df, "o_totalprice", 300000.0, 0.05, ids=ORDER_ID)


@query(f"SELECT o_orderkey, CASE WHEN {u(50)} < 0.02 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders")
def inject_missing_labels(spark, folder):
    return inject.missing_labels(_orders(spark, folder, "o_orderstatus"), "o_orderstatus", 0.02, ids=ORDER_ID)


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, 'v2' AS source_system FROM orders")
def inject_drift(spark, folder):
    return inject.drifted_schema(_orders(spark, folder, "o_custkey"), {"o_custkey": "string"}, {"source_system": "v2"})


@query(
    f"""SELECT o_orderkey, o_totalprice FROM orders
        UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE {u(60)} < 0.02"""
)
def inject_duplicates(spark, folder):
    return inject.duplicate_rows(_orders(spark, folder, "o_totalprice"), 0.02, ids=ORDER_ID)


_EVENT = "event_id"
_DIRTY_EVENTS = f"""de1 AS (
  SELECT event_id, CASE WHEN {u(11, _EVENT)} < 0.04 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN {u(20, _EVENT)} < 0.05 THEN 1e6::DOUBLE WHEN {u(10, _EVENT)} < 0.04 THEN NULL ELSE value END AS value
  FROM events),
de AS (SELECT * FROM de1 UNION ALL SELECT * FROM de1 WHERE {u(60, _EVENT)} < 0.03)"""


def _dirty_events(spark, folder):
    df = table(spark, folder, "events").select("event_id", "event_type", "value")
    return dirty_table(
        df,
        missing={"value": 0.04, "event_type": 0.04},
        outliers={"value": (1e6, 0.05)},
        added={"source_system": "v2"},
        duplicate_rate=0.03,
        ids=[_EVENT],
    )


@query(f"WITH {_DIRTY_EVENTS} SELECT event_id, event_type, value, 'v2' AS source_system FROM de")
def dirty_existing_table(spark, folder):
    return _dirty_events(spark, folder)[0]


def _accuracy(detected: str, injected: float) -> str:
    return f"greatest(0.0::DOUBLE, 1 - abs({detected} - {injected}::DOUBLE) / {injected}::DOUBLE) * 100"


def _share(condition: str) -> str:
    return f"(SELECT CAST(count(*) FILTER (WHERE {condition}) AS DOUBLE) / count(*) FROM de)"


_COPIES = "(SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM de)) AS DOUBLE) / count(*) FROM de)"


@query(
    f"""WITH {_DIRTY_EVENTS}, {fence('f', 'de', 'value')}
    SELECT 'missingness' AS issue, 'value' AS "column", 0.04::DOUBLE AS injected, {_share('value IS NULL')} AS detected,
        {_accuracy(_share('value IS NULL'), 0.04)} AS accuracy
    UNION ALL SELECT 'missingness', 'event_type', 0.04, {_share('event_type IS NULL')}, {_accuracy(_share('event_type IS NULL'), 0.04)}
    UNION ALL SELECT 'outliers', 'value', 0.05, {_share(beyond('value', 'f'))}, {_accuracy(_share(beyond('value', 'f')), 0.05)}
    UNION ALL SELECT 'duplicates', NULL, 0.03, {_COPIES}, {_accuracy(_COPIES, 0.03)}"""
)
def detection_accuracy(spark, folder):
    df, issues = _dirty_events(spark, folder)
    return detection_table(spark, issues, DataProfiler().profile(df))


_MISSING, _FAR = {"value": 0.1, "event_type": 0.3}, {"value": (1e6, 0.05), "user_id": (10**9, 0.02)}


@query(
    f"""WITH de1 AS (
      SELECT event_id, CASE WHEN {u(11, _EVENT)} < 0.3 THEN NULL ELSE event_type END AS event_type,
        CASE WHEN {u(20, _EVENT)} < 0.05 THEN 1e6::DOUBLE WHEN {u(10, _EVENT)} < 0.1 THEN NULL ELSE value END AS value,
        CASE WHEN {u(21, _EVENT)} < 0.02 THEN 1000000000 ELSE user_id END AS user_id
      FROM events),
    de AS (SELECT * FROM de1 UNION ALL SELECT * FROM de1 WHERE {u(60, _EVENT)} < 0.03)
    SELECT issue, "column", rate::DOUBLE AS rate, hits, (SELECT count(*) FROM de) AS "rows" FROM (
      SELECT 'missingness' AS issue, 'value' AS "column", 0.1 AS rate, count(*) FILTER (WHERE value IS NULL) AS hits FROM de
      UNION ALL SELECT 'missingness', 'event_type', 0.3, count(*) FILTER (WHERE event_type IS NULL) FROM de
      UNION ALL SELECT 'outliers', 'value', 0.05, count(*) FILTER (WHERE value = 1e6) FROM de
      UNION ALL SELECT 'outliers', 'user_id', 0.02, count(*) FILTER (WHERE user_id = 1000000000) FROM de
      UNION ALL SELECT 'duplicates', NULL, 0.03, count(*) - count(DISTINCT event_id) FROM de)"""
)
def dirty_table_record(spark, folder):
    """The recorded rate of each damage beside the rows of the damaged table that show it."""
    events = table(spark, folder, "events").select("event_id", "event_type", "value", "user_id")
    damaged, issues = dirty_table(events, missing=_MISSING, outliers=_FAR, duplicate_rate=0.03, ids=[_EVENT])
    shown = {("missingness", c): F.count_if(col(c).isNull()) for c in _MISSING}
    shown |= {("outliers", c): F.count_if(col(c) == far) for c, (far, _) in _FAR.items()}
    shown["duplicates", None] = F.count("*") - F.count_distinct(_EVENT)
    rates = [
        F.struct(F.lit(issue).alias("issue"), F.lit(c).cast("string").alias("column"), F.lit(float(rate)).alias("rate"),
                 shown[issue, c].alias("hits"), F.count("*").alias("rows"))
        for issue, c, rate in injected_rates(issues)
    ]
    return damaged.agg(F.array(*rates).alias("rates")).select(F.inline("rates"))


# --- generated datasets -----------------------------------------------------

_SEED = 42
_CONFIG = SyntheticIssueConfig(seed=_SEED)
_IDS = "ids AS (SELECT o_orderkey AS row_id FROM orders)"


def _generator(spark, folder):
    ids = table(spark, folder, "orders").select(col("o_orderkey").alias("row_id"))
    return SyntheticDataGenerator(spark, _CONFIG, ids)


def d(offset: int) -> str:
    return u(_SEED + offset, "row_id")


def _in_turn(names) -> str:
    whens = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names))
    return f"CASE row_id % {len(names)} {whens} END"


def _worth(column: str, amounts: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in amounts.items())
    return f"CASE {column} {whens} ELSE 0.0::DOUBLE END"


def _num(value: float) -> str:
    return f"{value}::DOUBLE"


_GENERIC = f"""generic AS (
  SELECT row_id, {d(0)} * 100 AS feature_num1, {d(1)} * 50 AS feature_num2,
    {_in_turn(GENERIC_CATEGORIES)} AS category, 'key_' || (row_id % 20) AS join_key FROM ids)"""
_CLASSED = """clean AS (
  SELECT *, CASE WHEN feature_num1 + feature_num2 > 75 THEN 'yes' ELSE 'no' END AS label FROM generic)"""
_TARGETED = f"""clean AS (
  SELECT *, feature_num1 * {_num(2.4)} + feature_num2 * {_num(1.7)} + {_worth('category', GENERIC_OFFSETS)}
    + {d(2)} * {_num(10.0)} AS target FROM generic)"""
_EMPLOYEES = f"""people AS (
  SELECT row_id, CAST(trunc({d(0)} * 43 + 22) AS INTEGER) AS age, {d(1)} * 30 AS tenure_years,
    {d(2)} * {_num(4.0)} + {_num(1.0)} AS performance_score,
    CAST(trunc({d(3)} * 25 + 35) AS INTEGER) AS hours_per_week, CAST(trunc({d(4)} * 80) AS INTEGER) AS training_hours,
    {_in_turn(DEPARTMENTS)} AS department, {_in_turn(EDUCATION)} AS education_level,
    {_in_turn(EMPLOYMENT)} AS employment_type, {_in_turn(LOCATIONS)} AS location FROM ids),
paid AS (
  SELECT *, {_worth('education_level', EDUCATION_PAY)} + {_worth('department', DEPARTMENT_PAY)}
    + tenure_years * {_num(1000.0)} + ({d(7)} * {_num(20000.0)} - {_num(10000.0)}) AS salary FROM people),
clean AS (
  SELECT *, CASE WHEN performance_score < 2.0 OR hours_per_week > 57 OR salary < 50000.0 THEN 'yes' ELSE 'no' END
    AS attrition FROM paid)"""
_HOUSES = f"""houses AS (
  SELECT row_id, {d(0)} * 4500 + 500 AS sqft_living, {d(1)} * 19000 + 1000 AS sqft_lot,
    CAST(trunc({d(2)} * 6 + 1) AS INTEGER) AS bedrooms, {d(3)} * {_num(4.0)} + {_num(1.0)} AS bathrooms,
    CAST(trunc({d(4)} * 100) AS INTEGER) AS age_years, {d(5)} * {_num(29.5)} + {_num(0.5)} AS distance_to_center,
    {d(6)} * {_num(9.0)} + {_num(1.0)} AS school_rating, {_in_turn(NEIGHBORHOODS)} AS neighborhood,
    {_in_turn(HOUSE_TYPES)} AS house_type, {_in_turn(CONDITIONS)} AS condition FROM ids),
clean AS (
  SELECT *, greatest({_num(50000.0)}, sqft_living * {_num(200.0)} + sqft_lot * {_num(3.0)}
    + bedrooms * {_num(15000.0)} + bathrooms * {_num(12000.0)} - age_years * {_num(800.0)}
    + school_rating * {_num(18000.0)} - distance_to_center * {_num(4000.0)}
    + {_worth('neighborhood', NEIGHBORHOOD_VALUE)} + {_worth('house_type', HOUSE_TYPE_VALUE)}
    + {_worth('condition', CONDITION_VALUE)} + ({d(10)} * {_num(40000.0)} - {_num(20000.0)})) AS price FROM houses)"""


def _hit(offset: int, rate: float, then: str, otherwise: str) -> str:
    return f"CASE WHEN {d(offset)} < {rate}::DOUBLE THEN {then} ELSE {otherwise} END"


def _damaged(columns: str) -> str:
    return (
        f"hurt AS (SELECT row_id AS id, {columns} FROM clean), "
        f"doubled AS (SELECT * FROM hurt UNION ALL SELECT * FROM hurt WHERE "
        f"{u(_SEED + 60, 'id')} < {_CONFIG.duplicate_rate}::DOUBLE)"
    )


def _flip(column: str) -> str:
    return _hit(40, _CONFIG.label_noise_rate, f"CASE WHEN {column} = 'yes' THEN 'no' ELSE 'yes' END", column)


_M, _O, _S, _N = _CONFIG.missing_rate, _CONFIG.outlier_rate, _CONFIG.skew_rate, _CONFIG.label_noise_rate
_GENERIC_HURT = f"""row_id, {_hit(10, _M, 'NULL', 'feature_num1')} AS feature_num1,
    {_hit(20, _O, '1000.0::DOUBLE', 'feature_num2')} AS feature_num2,
    {_hit(11, _M, 'NULL', 'category')} AS category, {_hit(30, _S, "'heavy_key'", 'join_key')} AS join_key"""


def _numbered(df, column):
    """A number that drifted to text, read back: engines print numbers differently."""
    return df.withColumn(column, F.col(column).try_cast("double"))


@query(f"WITH {_IDS}, {_GENERIC}, {_CLASSED} SELECT * FROM clean")
def generate_classification(spark, folder):
    return _generator(spark, folder).generate_classification_dataset().clean_df


@query(
    f"WITH {_IDS}, {_GENERIC}, {_CLASSED}, "
    + _damaged(
        f"{_GENERIC_HURT}, {_hit(50, _CONFIG.missing_label_rate, 'NULL', _flip('label'))} AS label, "
        "'synthetic_v2' AS new_source_col"
    )
    + " SELECT * EXCLUDE (id) FROM doubled"
)
def generate_classification_dirty(spark, folder):
    return _numbered(_generator(spark, folder).generate_classification_dataset().dirty_df, "feature_num1")


@query(f"WITH {_IDS}, {_GENERIC}, {_TARGETED} SELECT * FROM clean")
def generate_regression(spark, folder):
    return _generator(spark, folder).generate_regression_dataset().clean_df


@query(
    f"WITH {_IDS}, {_GENERIC}, {_TARGETED}, "
    + _damaged(
        f"{_GENERIC_HURT}, {_hit(40, _N, 'target + 100.0::DOUBLE', 'target')} AS target, "
        "'synthetic_v2' AS new_source_col"
    )
    + " SELECT * EXCLUDE (id) FROM doubled"
)
def generate_regression_dirty(spark, folder):
    return _numbered(_generator(spark, folder).generate_regression_dataset().dirty_df, "feature_num1")


@query(f"WITH {_IDS}, {_EMPLOYEES} SELECT * EXCLUDE (row_id) FROM clean")
def generate_employees(spark, folder):
    return _generator(spark, folder).generate_employee_attrition_dataset().clean_df


@query(
    f"WITH {_IDS}, {_EMPLOYEES}, "
    + _damaged(
        f"""age, tenure_years, {_hit(10, _M, 'NULL', 'performance_score')} AS performance_score, hours_per_week,
        training_hours, {_hit(11, _M, 'NULL', 'department')} AS department, education_level, employment_type,
        {_hit(30, _S, "'OnSite'", 'location')} AS location,
        {_hit(20, _O, '500000.0::DOUBLE', 'salary')} AS salary,
        {_flip('attrition')} AS attrition, 'hr_v2' AS source_system"""
    )
    + " SELECT * EXCLUDE (id) FROM doubled"
)
def generate_employees_dirty(spark, folder):
    return _numbered(_generator(spark, folder).generate_employee_attrition_dataset().dirty_df, "salary")


@query(f"WITH {_IDS}, {_HOUSES} SELECT * EXCLUDE (row_id) FROM clean")
def generate_houses(spark, folder):
    return _generator(spark, folder).generate_house_price_dataset().clean_df


@query(
    f"WITH {_IDS}, {_HOUSES}, "
    + _damaged(
        f"""sqft_living, {_hit(20, _O, '100000.0::DOUBLE', 'sqft_lot')} AS sqft_lot, bedrooms,
        bathrooms, age_years, distance_to_center, {_hit(10, _M, 'NULL', 'school_rating')} AS school_rating,
        {_hit(30, _S, "'Suburbs'", _hit(11, _M, 'NULL', 'neighborhood'))} AS neighborhood, house_type, condition,
        {_hit(40, _N, 'price + 300000.0::DOUBLE', 'price')} AS price, 'mls_v2' AS data_source"""
    )
    + " SELECT * EXCLUDE (id) FROM doubled"
)
def generate_houses_dirty(spark, folder):
    return _numbered(_generator(spark, folder).generate_house_price_dataset().dirty_df, "sqft_living")
