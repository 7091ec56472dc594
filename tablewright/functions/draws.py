"""Uniform draws that depend on the row, not on the partitioning.

``rand(seed)`` gives each partition its own stream, so the same rows get other
draws after a repartition or a retry. A draw from a hash of the row's identity
is the same everywhere, in every engine that has md5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col, needs_canonical_form

_DIGITS = 8
_SPAN = float(16**_DIGITS)
_RANK_DIGITS = 15
#: A rank key is less than this.
RANKS = 16**_RANK_DIGITS


def _digest(seed: int, identity: Sequence[Column]) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in identity]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _leading(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def uniform(seed: int, *identity: Column) -> Column:
    """A draw in [0, 1) fixed by the seed and the identity columns."""
    return _leading(_digest(seed, identity), _DIGITS) / F.lit(_SPAN)


def rank_key(seed: int, *identity: Column) -> Column:
    """A wide integer draw, for ordering rows rather than thresholding them."""
    return _leading(_digest(seed, identity), _RANK_DIGITS)


def row_identity(df: DataFrame, id_columns: Sequence[str] | None = None) -> list[Column]:
    """Columns that identify a row: the given ones, or a hash of all of them."""
    if id_columns:
        return [col(c) for c in id_columns]
    return [row_hash(df)]


def row_hash(df: DataFrame, salt: int = 0) -> Column:
    """64-bit hash of the whole row.

    ``xxhash64`` passes over nulls, so (null, 1) and (1, null) would meet; the
    null flags keep them apart.
    """
    values: list[Column] = [F.lit(salt)]
    for f in df.schema.fields:
        value = col(f.name)
        if needs_canonical_form(f.dataType):
            value = F.to_json(F.struct(value))
        values += [value, value.isNull()]
    return F.xxhash64(*values)
