"""Values of text columns numbered by frequency, as a table and not as a list on the driver.

Values are counted with partial sums, put in order by ranges, and numbered range
by range from the totals of the ranges before. Rows get their numbers by a join,
in which values that hold many rows cannot meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.draws import row_hash
from ..sources.storage import StoredTable, materialise

#: A column's index is broadcast whole up to so many bytes of values, 40 more counted for each.
SMALL_INDEX_BYTES = 8 << 20
#: Else its hot values are: those that hold one row in so many, hence at most so many, and are no longer than this.
HOT_SHARE, HOT_VALUE_BYTES = 1_000, 1_024


@dataclass(frozen=True)
class CategoryIndex:
    """The numbered values of some columns: ``table`` has column, value, n and rank (from 0), ``sizes`` the values a column."""

    stored: StoredTable
    sizes: dict[str, int]
    rows: dict[str, int]
    bytes: dict[str, int]

    @property
    def table(self) -> DataFrame:
        return self.stored.df

    def of(self, column: str) -> DataFrame:
        return self.table.filter(F.col("column") == column)

    def drop(self) -> None:
        """Delete the files. Frames with numbers from here must not be used afterwards."""
        self.stored.drop()


def category_index(df: DataFrame, columns: Sequence[str]) -> CategoryIndex:
    """Number the values of each column: the most frequent one is 0, of equally frequent ones the first by its bytes.

    Nulls have no number. All columns are counted in one scan; a value leaves a
    task as one row however often it occurs. The driver gets three sums a column.
    """
    pairs = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    no_pairs = F.array().cast("array<struct<column:string,value:string>>")
    values = df.select(F.inline(F.array(*pairs) if pairs else no_pairs)).filter(F.col("value").isNotNull())
    counts = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("column"), F.desc("n"), F.col("value")]
    ordered = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "categories")
    try:
        return _numbered(placed.df.withColumn("part", F.shiftright("at", 33)), columns)
    finally:
        placed.drop()


def _numbered(placed: DataFrame, columns: Sequence[str]) -> CategoryIndex:
    # a row for each range and column in it
    runs = placed.groupBy("column", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("values"))
    earlier = "sum(values) OVER (PARTITION BY column ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    shifts = runs.selectExpr("column", "part", f"coalesce({earlier}, 0) - first AS shift")
    ranked = placed.join(shifts, ["column", "part"]).select("column", "value", "n", (F.col("at") + F.col("shift")).alias("rank"))
    stored = materialise(ranked, "category-index")
    sums = stored.df.groupBy("column").agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.octet_length("value") + 40)).collect()
    found = {r[0]: r[1:] for r in sums}
    return CategoryIndex(stored, *({c: found[c][i] if c in found else 0 for c in columns} for i in range(3)))


def with_ranks(df: DataFrame, index: CategoryIndex, names: dict[str, str]) -> DataFrame:
    """Add the number of each column's value under the given name; null for null and for values not in the index."""
    for column, name in names.items():
        found = index.of(column).select(F.col("value").alias("__value"), F.col("rank").alias(name))
        text = col(column).cast("string")
        if index.bytes[column] <= SMALL_INDEX_BYTES:
            df = df.join(F.broadcast(found), text == F.col("__value"), "left").drop("__value")
            continue
        is_hot = (F.col("n") * HOT_SHARE >= index.rows[column]) & (F.octet_length("value") <= HOT_VALUE_BYTES)
        hot = index.of(column).filter(is_hot).select(F.col("value").alias("__value"), F.col("rank").alias("__hot"))
        df = df.join(F.broadcast(hot), text == F.col("__value"), "left").drop("__value")
        # rows of hot values and nulls have their answer: they are spread by their hash and meet nothing
        done = F.col("__hot").isNotNull() | text.isNull()
        key = F.when(done, row_hash(df).cast("string")).otherwise(text)
        df = df.withColumns({"__key": key, "__done": done})
        found = found.withColumn("__open", F.lit(False))
        df = df.join(found, (F.col("__key") == F.col("__value")) & (F.col("__done") == F.col("__open")), "left")
        df = df.withColumn(name, F.coalesce("__hot", name)).drop("__value", "__key", "__done", "__open", "__hot")
    return df


def sparse_vectors(
    df: DataFrame, numeric: Sequence[str], index: CategoryIndex, carried: Sequence[str], output: str
) -> StoredTable:
    """A stored table of the carried columns and one sparse vector a row.

    First come the numbers, then for each column of the index a slot for each of
    its values and one for values that it does not have.
    """
    names = {c: f"__rank_{i}" for i, c in enumerate(index.sizes)}
    ranked = with_ranks(df, index, names)
    slots: list[Column] = [F.lit(i) for i in range(len(numeric))]
    size = len(numeric)
    for column, name in names.items():
        slots.append((F.coalesce(F.col(name), F.lit(index.sizes[column])) + size).cast("int"))
        size += index.sizes[column] + 1
    if size > 2**31 - 1:
        raise ValueError(f"{size} values are more than a vector has places; encoding='hash' has no such limit.")
    numbers = [col(c).cast("double") for c in numeric] + [F.lit(1.0)] * len(names)
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.array(*slots).cast("array<int>").alias("indices"),
        F.array(*numbers).cast("array<double>").alias("values"))
    stored = materialise(ranked.select(*map(col, carried), vector.alias(output)), "vectors")
    # the stored form of a vector is this struct, so reading it as one needs no Python
    schema = T.StructType([*stored.df.schema.fields[:-1], T.StructField(output, VectorUDT())])
    return StoredTable(stored.path, df.sparkSession.read.schema(schema).parquet(stored.path))
