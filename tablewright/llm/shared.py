"""What the operators share: the folder of the cluster, stored tables, words."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
from collections.abc import Callable, Hashable, Iterator
from functools import cache
from types import ModuleType
from typing import Any
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_ROWS_A_FILE = 250_000


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tablewright-llm-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_folder(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``, as a URI or path.

    Where it is unset, a local session gets a temporary folder that goes at exit
    and a cluster gets an error. No setting of the session is changed.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {_SETTING} to a folder that all executors can reach.")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends there.

    Where about how many narrow ``rows`` it has is known, it is written in tasks of
    a few hundred thousand rows, so that small tables are no crowd of tiny files.
    """
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(1 + rows // _ROWS_A_FILE)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_words(text: str) -> list[bytes]:
    """UTF-8 words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


def texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    """The texts of a column one at a time, null as empty; unused Arrow memory goes back after each batch."""
    for value in batch.column(column):
        yield value.as_py() or ""
    pa.default_memory_pool().release_unused()


def row_keys(id_column: str, text_column: str) -> dict[str, Column]:
    """Columns by whose equality rows have the same id (null or not) and text, up to a 64-bit hash."""
    number = F.col(id_column).cast("long")
    text = F.xxhash64(F.col(text_column).isNull(), F.col(text_column))
    return {"_id": F.coalesce(number, F.lit(0).cast("long")), "_no_id": number.isNull(), "_text": text}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in a worker process and kept for its later tasks."""
    state = sys.modules.setdefault("tablewright_llm_kept", ModuleType("tablewright_llm_kept")).__dict__
    if key not in state:
        state[key] = make()
    return state[key]
