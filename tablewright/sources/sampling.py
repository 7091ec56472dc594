"""Samples of a fixed size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quantiles
from ..functions.draws import RANKS, rank_key, row_identity
from .storage import StoredTable, materialise

_DRAW = "__rank_key"
#: By how many standard deviations more rows than asked for are expected below the first line, and by how many rows.
_DEVIATIONS, _SPARE = 8, 32
#: A line with too few rows below it is raised so many times.
_RAISE = 8


def sample_rows(
    df: DataFrame, size: int, seed: int = 42, ids: Sequence[str] | None = None, total: int | None = None
) -> DataFrame:
    """A random sample of exactly ``size`` rows, or the table if it has no more.

    The rows with the smallest hash draws are kept. Draws are even, so a line can
    be drawn from the number of rows alone, below which the sample lies all but
    surely, with few rows more. One scan stores the rows below it in the shared
    folder; no sort, no shuffle, and no second scan of the input. If the number of
    rows (``total``) is not given, they are counted before, for which Parquet reads
    its footers only. If too few rows are below the line, because many rows share an
    id, it is raised until there are enough.

    With id columns the sample is the same in every run, but for the choice among
    rows whose draw is the last one taken. Without them the row's place in its
    input partition takes part in the draw, so that copies of a row are drawn one by
    one; the sample differs between layouts of the input.
    """
    if size <= 0:
        return df.limit(0)
    total = df.count() if total is None else total
    if total <= size:
        return df
    identity = row_identity(df, ids)
    if not ids:
        identity = [*identity, F.monotonically_increasing_id()]
    lowest, found = _lowest(df.withColumn(_DRAW, rank_key(seed, *identity)), size, total)
    drawn = lowest.df.withColumn(_DRAW, F.col(_DRAW).cast("double"))
    if found <= size:
        return drawn.drop(_DRAW)
    last = (size - 0.5) / found
    edge = quantiles.exact(drawn, {_DRAW: F.col(_DRAW)}, [last])[_DRAW][0]
    counted = drawn.agg(F.count_if(F.col(_DRAW) < edge), F.count_if(F.col(_DRAW) == edge)).first()
    if sum(counted) == size:
        return drawn.filter(F.col(_DRAW) <= edge).drop(_DRAW)
    of_last = drawn.filter(F.col(_DRAW) == edge).limit(size - counted[0])
    return drawn.filter(F.col(_DRAW) < edge).unionByName(of_last).drop(_DRAW)


def _lowest(drawn: DataFrame, size: int, total: int) -> tuple[StoredTable, int]:
    """The rows below a line that has at least ``size`` rows below it (or all rows), and how many they are."""
    share = (size + _DEVIATIONS * size**0.5 + _SPARE) / total
    while True:
        below = drawn if share >= 1 else drawn.filter(F.col(_DRAW) < int(share * RANKS))
        stored = materialise(below, "sample")
        found = stored.df.count()
        if found >= size or share >= 1:
            return stored, found
        stored.drop()
        share *= _RAISE
