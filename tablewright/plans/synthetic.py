"""Clean tables with known rules, and dirty copies with known damage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Snapshot, col, snapshot
from ..functions.draws import uniform
from ..functions.draws import row_hash
from ..operators import inject

ROW_ID = "row_id"

# Category names by row number, and the numbers of the label and
# target rules.
GENERIC_CATEGORIES = ("A", "B", "C")
GENERIC_KEYS = 20
GENERIC_OFFSETS = {"A": 15.0, "B": -8.0, "C": 3.0}
DEPARTMENTS = ("Engineering", "Sales", "HR", "Finance", "Marketing", "Operations")
EDUCATION = ("HighSchool", "Bachelor", "Master", "PhD")
EMPLOYMENT = ("FullTime", "FullTime", "FullTime", "FullTime", "PartTime", "Contract")
LOCATIONS = ("Remote", "OnSite", "Hybrid")
EDUCATION_PAY = {"PhD": 100000.0, "Master": 75000.0, "Bachelor": 55000.0, "HighSchool": 40000.0}
DEPARTMENT_PAY = {"Engineering": 20000.0, "Finance": 15000.0, "Sales": 10000.0}
NEIGHBORHOODS = ("Downtown", "Suburbs", "Rural", "Waterfront", "Industrial")
HOUSE_TYPES = ("SingleFamily", "Condo", "Townhouse", "MultiFamily")
CONDITIONS = ("Excellent", "Good", "Fair", "Poor")
NEIGHBORHOOD_VALUE = {
    "Waterfront": 150000.0, "Downtown": 80000.0, "Suburbs": 20000.0, "Industrial": -30000.0,
}
HOUSE_TYPE_VALUE = {"SingleFamily": 30000.0, "Condo": -10000.0}
CONDITION_VALUE = {"Excellent": 40000.0, "Good": 10000.0, "Fair": -15000.0, "Poor": -35000.0}


@dataclass
class SyntheticIssueConfig:
    row_count: int = 1000
    seed: int = 42
    missing_rate: float = 0.05
    duplicate_rate: float = 0.02
    outlier_rate: float = 0.03
    skew_rate: float = 0.60
    schema_drift: bool = True
    label_noise_rate: float = 0.05
    missing_label_rate: float = 0.02

    def validate(self) -> None:
        if self.row_count <= 0:
            raise ValueError("At least one row is needed (row_count).")
        for name, value in asdict(self).items():
            if name.endswith("_rate") and not 0 <= value <= 1:
                raise ValueError(f"{name} is a share of the rows, from 0 to 1.")


@dataclass
class SyntheticDataset:
    clean_df: DataFrame
    dirty_df: DataFrame
    reference_schema: Snapshot
    metadata: dict[str, Any] = field(default_factory=dict)


def by_row(names: Sequence[str], row: Column) -> Column:
    """The names in turn, by row number."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(row, F.lit(len(names))) + 1).cast("int"))


def by_value(amounts: dict[str, float], key: Column) -> Column:
    """The amount of a category, 0 for the others."""
    pairs = [F.lit(x) for pair in amounts.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0.0))


def classification_rows(ids: DataFrame, seed: int) -> DataFrame:
    """Two numbers, a category, a key and a yes/no label that is a rule of them."""
    row = col(ROW_ID)
    featured = _generic_features(ids, seed)
    total = col("feature_num1") + col("feature_num2")
    return featured.withColumn("label", F.when(total > 75, "yes").otherwise("no"))


def regression_rows(ids: DataFrame, seed: int) -> DataFrame:
    """The same features with a linear target."""
    target = (
        col("feature_num1") * 2.4
        + col("feature_num2") * 1.7
        + by_value(GENERIC_OFFSETS, col("category"))
        + uniform(seed + 2, col(ROW_ID)) * 10.0
    )
    return _generic_features(ids, seed).withColumn("target", target)


def _generic_features(ids: DataFrame, seed: int) -> DataFrame:
    row = col(ROW_ID)
    return ids.select(
        row,
        (uniform(seed, row) * 100).alias("feature_num1"),
        (uniform(seed + 1, row) * 50).alias("feature_num2"),
        by_row(GENERIC_CATEGORIES, row).alias("category"),
        F.concat(F.lit("key_"), F.pmod(row, F.lit(GENERIC_KEYS)).cast("string")).alias("join_key"),
    )


def employee_rows(ids: DataFrame, seed: int) -> DataFrame:
    """Employees with an attrition label that is a rule of score, hours and salary."""
    row = col(ROW_ID)

    def draw(offset: int) -> Column:
        return uniform(seed + offset, row)

    people = ids.select(
        row,
        (draw(0) * 43 + 22).cast("int").alias("age"),
        (draw(1) * 30).alias("tenure_years"),
        (draw(2) * 4.0 + 1.0).alias("performance_score"),
        (draw(3) * 25 + 35).cast("int").alias("hours_per_week"),
        (draw(4) * 80).cast("int").alias("training_hours"),
        by_row(DEPARTMENTS, row).alias("department"),
        by_row(EDUCATION, row).alias("education_level"),
        by_row(EMPLOYMENT, row).alias("employment_type"),
        by_row(LOCATIONS, row).alias("location"),
    )
    salary = (
        by_value(EDUCATION_PAY, col("education_level"))
        + by_value(DEPARTMENT_PAY, col("department"))
        + col("tenure_years") * 1000.0
        + (draw(7) * 20000.0 - 10000.0)
    )
    leaves = (col("performance_score") < 2.0) | (col("hours_per_week") > 57) | (col("salary") < 50000.0)
    paid = people.withColumn("salary", salary)
    return paid.withColumn("attrition", F.when(leaves, "yes").otherwise("no"))


def house_rows(ids: DataFrame, seed: int) -> DataFrame:
    """Houses with a linear price that has a floor."""
    row = col(ROW_ID)

    def draw(offset: int) -> Column:
        return uniform(seed + offset, row)

    houses = ids.select(
        row,
        (draw(0) * 4500 + 500).alias("sqft_living"),
        (draw(1) * 19000 + 1000).alias("sqft_lot"),
        (draw(2) * 6 + 1).cast("int").alias("bedrooms"),
        (draw(3) * 4.0 + 1.0).alias("bathrooms"),
        (draw(4) * 100).cast("int").alias("age_years"),
        (draw(5) * 29.5 + 0.5).alias("distance_to_center"),
        (draw(6) * 9.0 + 1.0).alias("school_rating"),
        by_row(NEIGHBORHOODS, row).alias("neighborhood"),
        by_row(HOUSE_TYPES, row).alias("house_type"),
        by_row(CONDITIONS, row).alias("condition"),
    )
    price = (
        col("sqft_living") * 200.0
        + col("sqft_lot") * 3.0
        + col("bedrooms") * 15000.0
        + col("bathrooms") * 12000.0
        - col("age_years") * 800.0
        + col("school_rating") * 18000.0
        - col("distance_to_center") * 4000.0
        + by_value(NEIGHBORHOOD_VALUE, col("neighborhood"))
        + by_value(HOUSE_TYPE_VALUE, col("house_type"))
        + by_value(CONDITION_VALUE, col("condition"))
        + (draw(10) * 40000.0 - 20000.0)
    )
    return houses.withColumn("price", F.greatest(F.lit(50000.0), price))


class _Damage:
    """Applies injectors one after the other and keeps the record of them."""

    def __init__(self, df: DataFrame, config: SyntheticIssueConfig):
        self.df, self.config = df, config
        self.issues: dict[str, Any] = {}

    def _note(self, issue: str, rate: float | None, **facts: Any) -> bool:
        if rate == 0 or (issue == "schema_drift" and not self.config.schema_drift):
            return False
        self.issues[issue] = facts | ({} if rate is None else {"rate": rate})
        return True

    def _seed(self, offset: int) -> int:
        return self.config.seed + offset

    def drift(self, column: str, added: str, value: str) -> None:
        change = {
            "removed_columns": [],
            "type_changes": [{"column": column, "to_type": "string"}],
            "added_columns": [added],
        }
        if self._note("schema_drift", None, **change):
            self.df = inject.drifted_schema(self.df, {column: "string"}, {added: value})

    def missing(self, *columns: str) -> None:
        rate = self.config.missing_rate
        if self._note("missingness", rate, columns=list(columns)):
            for i, c in enumerate(columns):
                seed = self._seed(inject.MISSING + i)
                self.df = inject.missing_values(self.df, c, rate, seed, [ROW_ID])

    def outliers(self, column: str, value: float) -> None:
        rate = self.config.outlier_rate
        if self._note("outliers", rate, column=column, outlier_value=value):
            seed = self._seed(inject.OUTLIER)
            self.df = inject.constant_outliers(self.df, column, value, rate, seed, [ROW_ID])

    def skew(self, column: str, value: str) -> None:
        rate = self.config.skew_rate
        if self._note("key_skew", rate, column=column, heavy_key=value):
            self.df = inject.heavy_key(self.df, column, value, rate, self._seed(inject.SKEW), [ROW_ID])

    def flipped(self, column: str) -> None:
        rate = self.config.label_noise_rate
        if self._note("label_noise", rate, column=column, strategy="flip_binary_label"):
            seed = self._seed(inject.LABEL_NOISE)
            self.df = inject.flipped_labels(self.df, column, "yes", "no", rate, seed, [ROW_ID])

    def noise(self, column: str, error: float) -> None:
        rate = self.config.label_noise_rate
        if self._note("target_noise", rate, column=column, strategy="add_large_positive_error"):
            seed = self._seed(inject.LABEL_NOISE)
            self.df = inject.target_noise(self.df, column, error, rate, seed, [ROW_ID])

    def unlabelled(self, column: str) -> None:
        rate = self.config.missing_label_rate
        if self._note("missing_labels", rate, column=column):
            self.df = inject.missing_labels(self.df, column, rate, self._seed(inject.LABEL_NULL), [ROW_ID])

    def duplicated(self) -> None:
        rate = self.config.duplicate_rate
        if self._note("duplicates", rate):
            self.df = inject.duplicate_rows(self.df, rate, self._seed(inject.DUPLICATE), [ROW_ID])


class SyntheticDataGenerator:
    """Four generated datasets, each as a clean table and a damaged copy.

    All draws hang on the row id, so a dataset is the same on any cluster. The
    ids can be given (a table with a ``row_id``) in place of a plain range.
    """

    def __init__(self, spark: SparkSession, config: SyntheticIssueConfig | None = None, ids: DataFrame | None = None):
        self.spark = spark
        self.config = config or SyntheticIssueConfig()
        self.config.validate()
        self.ids = spark.range(self.config.row_count).toDF(ROW_ID) if ids is None else ids.select(ROW_ID)

    def generate_classification_dataset(self) -> SyntheticDataset:
        damage = _Damage(classification_rows(self.ids, self.config.seed), self.config)
        clean = damage.df
        damage.drift("feature_num1", "new_source_col", "synthetic_v2")
        damage.missing("feature_num1", "category")
        damage.outliers("feature_num2", 1000.0)
        damage.skew("join_key", "heavy_key")
        damage.flipped("label")
        damage.unlabelled("label")
        damage.duplicated()
        return self._dataset(clean, damage, "classification")

    def generate_regression_dataset(self) -> SyntheticDataset:
        damage = _Damage(regression_rows(self.ids, self.config.seed), self.config)
        clean = damage.df
        damage.drift("feature_num1", "new_source_col", "synthetic_v2")
        damage.missing("feature_num1", "category")
        damage.outliers("feature_num2", 1000.0)
        damage.skew("join_key", "heavy_key")
        damage.noise("target", 100.0)
        damage.duplicated()
        return self._dataset(clean, damage, "regression")

    def generate_employee_attrition_dataset(self) -> SyntheticDataset:
        damage = _Damage(employee_rows(self.ids, self.config.seed), self.config)
        clean = damage.df
        damage.outliers("salary", 500000.0)
        damage.drift("salary", "source_system", "hr_v2")
        damage.missing("performance_score", "department")
        damage.skew("location", "OnSite")
        damage.flipped("attrition")
        damage.duplicated()
        return self._dataset(clean, damage, "classification", keep_id=False)

    def generate_house_price_dataset(self) -> SyntheticDataset:
        damage = _Damage(house_rows(self.ids, self.config.seed), self.config)
        clean = damage.df
        damage.drift("sqft_living", "data_source", "mls_v2")
        damage.missing("school_rating", "neighborhood")
        damage.outliers("sqft_lot", 100000.0)
        damage.skew("neighborhood", "Suburbs")
        damage.noise("price", 300000.0)
        damage.duplicated()
        return self._dataset(clean, damage, "regression", keep_id=False)

    def _dataset(self, clean: DataFrame, damage: _Damage, task: str, keep_id: bool = True) -> SyntheticDataset:
        dirty = damage.df
        if not keep_id:
            clean, dirty = clean.drop(ROW_ID), dirty.drop(ROW_ID)
        metadata = {"config": asdict(self.config), "issues": damage.issues, "task_type": task}
        return SyntheticDataset(clean, dirty, snapshot(clean.schema), metadata)


def inject_wine_issues(
    df: DataFrame,
    missing_rate: float,
    duplicate_rate: float,
    outlier_rate: float,
    schema_drift: bool,
    ids: Sequence[str] | None = None,
) -> tuple[DataFrame, dict[str, Any]]:
    """Damage an existing table of wines; returns it with the record of issues."""
    return dirty_table(
        df,
        missing={"alcohol": missing_rate, "wine_type": missing_rate},
        outliers={"residual_sugar": (100.0, outlier_rate)},
        drift={"alcohol": "string"} if schema_drift else {},
        added={"source_system": "wine_quality_v2"} if schema_drift else {},
        duplicate_rate=duplicate_rate,
        seed=91,
        ids=ids,
    )


_IDENTITY = "__identity"


def dirty_table(
    df: DataFrame,
    missing: dict[str, float] | None = None,
    outliers: dict[str, tuple[float, float]] | None = None,
    drift: dict[str, str] | None = None,
    added: dict[str, Any] | None = None,
    duplicate_rate: float = 0.0,
    seed: int = 0,
    ids: Sequence[str] | None = None,
) -> tuple[DataFrame, dict[str, Any]]:
    """Damage any table: missing values, outliers, drift and copies by rate.

    The record has the rate of every damaged column. Without ids a row is known by
    its hash before any damage, so that what one kind of damage hits does not
    depend on the others.
    """
    issues: dict[str, Any] = {}
    missing = {c: r for c, r in (missing or {}).items() if r > 0}
    outliers = {c: (v, r) for c, (v, r) in (outliers or {}).items() if r > 0}
    if not ids:
        df, ids = df.withColumn(_IDENTITY, row_hash(df)), [_IDENTITY]
    for i, (column, rate) in enumerate(missing.items()):
        df = inject.missing_values(df, column, rate, seed + inject.MISSING + i, ids)
    for i, (column, (value, rate)) in enumerate(outliers.items()):
        df = inject.constant_outliers(df, column, value, rate, seed + inject.OUTLIER + i, ids)
    if missing:
        issues["missingness"] = {"columns": list(missing), "rates": missing}
    if outliers:
        issues["outliers"] = {
            "columns": list(outliers),
            "rates": {c: r for c, (_, r) in outliers.items()},
            "outlier_values": {c: v for c, (v, _) in outliers.items()},
        }
    if drift or added:
        df = inject.drifted_schema(df, drift or {}, added)
        issues["schema_drift"] = {
            "removed_columns": [],
            "type_changes": [{"column": c, "to_type": t} for c, t in (drift or {}).items()],
            "added_columns": list(added or {}),
        }
    if duplicate_rate > 0:
        df = inject.duplicate_rows(df, duplicate_rate, seed + inject.DUPLICATE, ids)
        issues["duplicates"] = {"rate": duplicate_rate}
    return df.drop(_IDENTITY), issues
