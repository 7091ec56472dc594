"""Typed reads of the supported file shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.schemas import cast_to
from .sampling import sample_rows

# The layouts of the three known datasets.
CENSUS_COLUMNS = (
    "age", "workclass", "fnlwgt", "education", "education_num", "marital_status",
    "occupation", "relationship", "race", "sex", "capital_gain", "capital_loss",
    "hours_per_week", "native_country", "income",
)
CENSUS_TYPES = {
    "age": "int", "fnlwgt": "double", "education_num": "int",
    "capital_gain": "double", "capital_loss": "double", "hours_per_week": "int",
}
TAXI_NUMBERS = ("fare_amount", "passenger_count", "trip_distance", "PULocationID", "DOLocationID")
TAXI_CODES = ("payment_type", "RatecodeID")
TAXI_PICKUP, TAXI_LABEL = "tpep_pickup_datetime", "fare_amount"
NULL_TOKEN, TRAILING_MARK = "?", r"\.$"


def clean_token(value: Column, null_token: str = NULL_TOKEN, drop: str = TRAILING_MARK) -> Column:
    """Strip a trailing mark and blanks; the null token becomes null."""
    return F.nullif(F.trim(F.regexp_replace(value, drop, "")), F.lit(null_token))


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns; text that does not fit becomes null."""
    return df.select(
        *[cast_to(col(c), types[c]).alias(c) if c in types else col(c) for c in df.columns]
    )


def read_headerless_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str],
    types: Mapping[str, str],
    comment: str = "|",
    null_token: str = NULL_TOKEN,
) -> DataFrame:
    """CSV files without a header, read together: trim, tidy tokens, cast.

    The schema is given, so the files are not read to infer one.
    """
    raw = (
        spark.read.schema(", ".join(f"`{c}` string" for c in columns))
        .option("header", "false")
        .option("comment", comment)
        .option("ignoreLeadingWhiteSpace", "true")
        .option("ignoreTrailingWhiteSpace", "true")
        .csv(list(paths) if not isinstance(paths, str) else paths)
    )
    return typed(raw.select(*[clean_token(col(c), null_token).alias(c) for c in columns]), types)


def load_adult_dataframe(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Census income files."""
    return read_headerless_csv(spark, list(paths), CENSUS_COLUMNS, CENSUS_TYPES)


def normalize_column(name: str) -> str:
    return name.strip().replace(" ", "_")


def read_delimited_numbers(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """A delimited file with a header, tidy column names, every column a double."""
    raw = spark.read.option("header", "true").option("sep", separator).csv(str(path))
    named = raw.toDF(*[normalize_column(c) for c in raw.columns])
    return typed(named, {c: "double" for c in named.columns})


read_wine_csv = read_delimited_numbers


def union_sources(parts: Mapping[str, DataFrame], column: str) -> DataFrame:
    """Put tables of one shape together, each row marked with its source."""
    whole = None
    for name, part in parts.items():
        marked = part.withColumn(column, F.lit(name))
        whole = marked if whole is None else whole.unionByName(marked)
    return whole


def load_wine_dataframe(spark: SparkSession, red_path: str, white_path: str | None = None) -> DataFrame:
    paths = {"red": red_path} | ({"white": white_path} if white_path is not None else {})
    return union_sources({n: read_wine_csv(spark, p) for n, p in paths.items()}, "wine_type")


def calendar_parts(timestamp: str, hour: str = "hour_of_day", weekday: str = "day_of_week") -> list[Column]:
    """Hour of the day and day of the week (1 = Sunday) as doubles."""
    return [
        F.hour(col(timestamp)).cast("double").alias(hour),
        F.dayofweek(col(timestamp)).cast("double").alias(weekday),
    ]


def project_typed(
    df: DataFrame,
    numbers: Sequence[str],
    codes: Sequence[str] = (),
    timestamp: str | None = None,
    required: str | None = None,
) -> DataFrame:
    """Numbers as doubles, codes as whole-number text, parts of a timestamp.

    A plain projection and a not-null filter, so a Parquet scan reads just these
    columns and takes the filter with it.
    """
    if required is not None:
        df = df.filter(col(required).isNotNull())
    chosen = [cast_to(col(c), "double").alias(c) for c in numbers]
    chosen += [cast_to(cast_to(col(c), "int"), "string").alias(c) for c in codes]
    if timestamp is not None:
        chosen += calendar_parts(timestamp)
    projected = df.select(*chosen)
    return projected.filter(col(required).isNotNull()) if required is not None else projected


def load_taxi_dataframe(
    spark: SparkSession, path: str, sample_size: int | None = None, seed: int = 42
) -> DataFrame:
    """Taxi trips with a fare; at most ``sample_size`` of them if that is given."""
    trips = project_typed(
        spark.read.parquet(str(path)), TAXI_NUMBERS, TAXI_CODES, TAXI_PICKUP, TAXI_LABEL
    )
    return trips if sample_size is None else sample_rows(trips, sample_size, seed)
