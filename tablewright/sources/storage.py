"""Materialised tables in the shared folder the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from dataclasses import dataclass
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, is_binary_text
from ..functions.draws import row_hash

_SETTING = "spark.checkpoint.dir"
#: Training rows go to a partition for each so many rows, up to the given number, and to more only for many more rows.
_ROWS_A_PARTITION, _SMALL_PARTITIONS, _MANY_ROWS_A_PARTITION = 10_000, 64, 1_000_000
#: Copies of a training row stay together in runs of so many.
_COPIES_TOGETHER = 256
#: Up to so many rows a learner gets every copy by itself; of more rows, copies share a weight, so that about so many are left.
SINGLE_ROWS = 1_000_000
MARK, COPIES, WEIGHT = "__row_hash", "__copies", "__weight"


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tablewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder, removed at exit. A
    cluster gets an error, for a folder of one machine would not be seen by the
    others. The session's settings stay as they are.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {_SETTING} to a folder all executors can reach.")
    return _own_folder()


@dataclass(frozen=True)
class StoredTable:
    path: str
    df: DataFrame

    def drop(self) -> None:
        """Delete the files. The DataFrame must not be used afterwards."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str = "table") -> StoredTable:
    """Write the table as Parquet and read it back.

    This cuts the lineage for good: a lost executor costs a re-read, not a
    recomputation, and later scans read only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return StoredTable(path, df.sparkSession.read.schema(df.schema).parquet(path))


def training_partitions(rows: int) -> int:
    """How many partitions rows are trained in: a function of their number, so equal tables are laid out alike."""
    few = min(_SMALL_PARTITIONS, -(-rows // _ROWS_A_PARTITION))
    return max(1, few, -(-rows // _MANY_ROWS_A_PARTITION))


def store_distinct(df: DataFrame) -> StoredTable:
    """Materialise the different rows, each with its hash and the number of its copies."""
    plain = df.select(*[
        (col(f.name) if is_binary_text(f.dataType) else F.collate(col(f.name), "UTF8_BINARY")).alias(f.name) for f in df.schema.fields])
    counted = plain.groupBy(*[col(c) for c in plain.columns]).agg(F.count(F.lit(1)).alias(COPIES))
    return materialise(counted.withColumn(MARK, row_hash(plain)), "training")


def count_copies(distinct: DataFrame) -> int:
    """How many rows a table of different rows stands for."""
    return distinct.agg(F.sum(COPIES)).first()[0] or 0


def training_runs(distinct: DataFrame, rows: int, partitions: int | None = None) -> DataFrame:
    """The rows that a table of different rows stands for, with weights, in a layout that only the rows decide.

    A forest depends on which rows share a partition and in what order. Rows go to
    partitions by their hash and are sorted by it there, so equal tables give equal
    models whatever the session's settings and the input's layout. Runs of copies
    after the first are placed by hash and number of the run, so that few different
    rows fill all partitions alike. Copies are single up to ``SINGLE_ROWS`` rows in
    all, and of more rows several are one row with their number as weight. Files are
    read back in no fixed order, so this is done on reading; the learners keep what
    they read.
    """
    part, single = "__part", "__copy"
    names = [col(c) for c in distinct.columns if c not in (MARK, COPIES)]
    alike = max(1, -(-rows // SINGLE_ROWS))
    together = _COPIES_TOGETHER * alike
    last = F.floor((F.col(COPIES) - 1) / together)
    runs = distinct.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias(part))
    place = F.when(F.col(part) == 0, F.col(MARK)).otherwise(F.xxhash64(MARK, part))
    placed = runs.repartition(partitions or training_partitions(rows), place).sortWithinPartitions(MARK, part)
    size = F.least(F.lit(together), F.col(COPIES) - F.col(part) * together)
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / alike))).alias(single)
    weight = F.least(F.lit(alike), F.col("__size") - F.col(single) * alike).cast("double")
    return placed.select(*names, size.alias("__size"), copies).select(*names, weight.alias(WEIGHT))


def store_for_training(df: DataFrame, partitions: int | None = None) -> StoredTable:
    """Materialise rows that a model will read many times: the different rows with their number, read as ``training_runs``."""
    stored = store_distinct(df)
    return StoredTable(stored.path, training_runs(stored.df, count_copies(stored.df), partitions))


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Overwrite a Parquet table at a path of the caller's choice and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
