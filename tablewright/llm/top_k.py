"""Exact top-k inner products by block-at-a-time pruning.

Vectors lie in blocks of neighbouring ids. A block knows the largest and smallest
value of each component, its term maxima, and holds its vectors as one array, its
forward index. For a query, the sum over components of the larger of query times
maximum and query times minimum bounds every score of the block.

Blocks are dealt to shards and queries to groups. A cell, one group against one
shard, takes each query's blocks in order of their bounds and scores whole blocks
until the next bound falls below the k-th score so far. That score starts from a
first pass, in which every group meets one shard, so later cells may pass over
most blocks and send on few rows. Ties go to the smaller id, so blocks whose bound
equals the k-th score are scored too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import stored

BLOCK_ROWS, SHARD_BLOCKS, GROUP_ROWS = 512, 16, 512
_EXACT = 1 << 53

_BLOCK = "part long, width int, ids binary, values binary, upper binary, lower binary"


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """id and values (array of long): floor(scale * x) of usable vectors."""
    x = F.transform(F.col(vector_column), lambda v: v.cast("double"))
    usable = F.col(vector_column).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    values = F.transform(x, lambda v: F.floor(v * F.lit(scale)))
    return vectors.filter(usable).select(F.col(id_column).cast("long").alias("id"), values.alias("values"))


def _blocked(rows: DataFrame, size: int) -> DataFrame:
    """Rows with place (0, 1, ...), packed to one row for each ``size`` places."""

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, held = None, [], []

        def block() -> pd.DataFrame:
            width = max(map(len, held))
            values = np.zeros((len(held), width), np.int64)
            for row, v in zip(values, held):
                row[: len(v)] = v
            data = (np.array(ids, np.int64), values, values.max(axis=0), values.min(axis=0))
            return pd.DataFrame([[at, width, *(d.tobytes() for d in data)]], columns=["part", "width", "ids", "values", "upper", "lower"])

        for batch in batches:
            for part, i, v in zip(batch["part"], batch["id"], batch["values"]):
                if part != at and held:
                    yield block()
                    ids, held = [], []
                at = part
                ids.append(i)
                held.append(v)
        if held:
            yield block()

    parts = rows.select(F.expr(f"place div {size}").alias("part"), "id", "values")
    return parts.repartition("part").sortWithinPartitions("part", "id").mapInPandas(pack, _BLOCK)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their place in the order of ids, counted by partition: no window over all rows."""
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("row", F.monotonically_increasing_id())
    held = stored(ranged, "vectors").withColumn("slice", F.expr("row >> 33"))
    sizes = held.groupBy("slice").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("slice", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return held.join(starts, "slice").select((F.col("row") - F.col("first") + F.col("start")).alias("place"), "id", "values")


def _array(data: bytes, width: int | None = None) -> np.ndarray:
    values = np.frombuffer(data, np.int64)
    return values if width is None else values.reshape(-1, width) if width else values.reshape(-1, 1)[:0]


def _wide(values: np.ndarray, width: int) -> np.ndarray:
    return np.pad(values, [(0, 0)] * (values.ndim - 1) + [(0, width - values.shape[-1])])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= floor], scores[scores >= floor]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _exact_kind(queries: np.ndarray, blocks: list[tuple[np.ndarray, ...]]) -> type:
    """Doubles where every sum is exact in them, else Python integers."""
    most = max((int(np.abs(b[1]).max(initial=0)) for b in blocks), default=0)
    return np.float64 if int(np.abs(queries).max(initial=0)) * most * max(1, queries.shape[1]) < _EXACT else object


def _cell(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the query, ids, scores): its k best of the shard that reach its floor."""
    width = max(int(queries["width"].max()), int(shard["width"].max()), 1)
    blocks = [
        (_array(r.ids), _wide(_array(r.values, r.width), width) if r.width else np.zeros((len(_array(r.ids)), width), np.int64),
         _wide(_array(r.upper), width), _wide(_array(r.lower), width))
        for r in shard.itertuples()
    ]
    for group in queries.itertuples():
        ids = _array(group.ids)
        own = _wide(_array(group.values, group.width), width) if group.width else np.zeros((len(ids), width), np.int64)
        floors = _array(group.floors) if group.floors is not None else np.full(len(ids), np.iinfo(np.int64).min)
        kind = _exact_kind(own, blocks)
        own = own.astype(kind)
        held = [tuple(a if i == 0 else a.astype(kind) for i, a in enumerate(b)) for b in blocks]
        upper, lower = np.array([b[2] for b in held]), np.array([b[3] for b in held])
        bounds = np.maximum(own, 0) @ upper.T + np.minimum(own, 0) @ lower.T
        for q, query in enumerate(own):
            found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            least = floors[q]
            for b in np.argsort(-bounds[q], kind="stable"):
                if bounds[q][b] < least:
                    break
                got = (held[b][1] @ query).astype(np.int64)
                near = got >= least
                found, scores = _best(np.r_[found, held[b][0][near]], np.r_[scores, got[near]], k)
                if len(scores) == k:
                    least = max(least, scores[-1])
            yield int(group.start) + q, found, scores


def _cells(queries: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """query (its place), id, score over all cells present on both sides."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = list(_cell(left, right, k)) if len(left) and len(right) else []
        places = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).astype(np.int64)
        ids, scores = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in (1, 2))
        return pd.DataFrame({"query": places, "id": ids, "score": scores})

    keys = ["group", "shard"]
    return queries.groupBy(*keys).cogroup(shards.groupBy(*keys)).applyInPandas(run, "query long, id long, score long")


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding",
    scale: float = 1024.0, block_rows: int = BLOCK_ROWS, shard_blocks: int = SHARD_BLOCKS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose id is divisible by ``every``.

    Components count as floor(``scale`` * x). Vectors that are null or hold null or
    non-finite components take no part; a shorter vector counts as filled up with
    zeros; rows without an id take no part either. A row is no match for itself,
    but another row of its id is; each row of a repeated query id gives its own
    list. Scores must fit 64 bits. Other columns are not read; an empty table gives
    no rows. The sizes of blocks, shards and groups change no result.
    """
    rows = quantised(vectors.filter(F.col(id_column).isNotNull()), id_column, vector_column, scale)
    blocks = stored(_blocked(_placed(rows), block_rows), "top-k-blocks")
    asked = stored(_placed(rows.filter(F.col("id") % every == 0)), "top-k-queries")
    groups = stored(_blocked(asked, group_rows), "top-k-groups").withColumn("start", F.col("part") * group_rows)
    n_shards = 1 + ((blocks.agg(F.max("part")).first()[0] or 0) // shard_blocks)
    n_groups = 1 + (groups.agg(F.max("part")).first()[0] or 0)

    shards = blocks.withColumn("shard", F.expr(f"part div {shard_blocks}"))
    first = F.col("part") % n_shards  # where a group's first pass goes
    seeds = shards.withColumn("group", F.explode(F.expr(f"filter(sequence(0L, {n_groups - 1}L), g -> g % {n_shards} = shard)")))
    unset = F.lit(None).cast("binary").alias("floors")
    start = groups.select(F.col("part").alias("group"), first.alias("shard"), "width", "ids", "values", "start", unset)
    begun = stored(_cells(start, seeds, k + 1), "top-k-first")

    kth = begun.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
    least = -(1 << 63)

    def floors(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, part in batch.groupby("group"):
                values = np.full(group_rows, least, np.int64)
                for places, found in zip(part["places"], part["floors"]):
                    values[places] = found
                yield pd.DataFrame({"group": [group], "floors": [values.tobytes()]})

    listed = kth.filter("floor is not null").groupBy(F.expr(f"query div {group_rows}").alias("group")).agg(
        F.collect_list(F.struct((F.col("query") % group_rows).alias("place"), "floor")).alias("f"))  # group_rows at most
    limits = listed.select("group", F.col("f.place").alias("places"), F.col("f.floor").alias("floors")).mapInPandas(
        floors, "group long, floors binary")
    others = F.explode(F.expr(f"filter(sequence(0L, {n_shards - 1}L), s -> s <> part % {n_shards})")).alias("shard")
    rest = groups.select(F.col("part").alias("group"), others, "width", "ids", "values", "start").join(limits, "group", "left")
    wide = shards.withColumn("group", F.explode(F.expr(f"filter(sequence(0L, {n_groups - 1}L), g -> g % {n_shards} <> shard)")))
    found = begun.unionByName(_cells(rest, wide, k + 1))

    norm = F.aggregate("values", F.lit(0).cast("long"), lambda a, v: a + v * v)
    own = asked.select(F.col("place").alias("query"), F.col("id").alias("query_id"), norm.alias("own"))
    itself = (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = found.join(own, "query").withColumn("same", F.when(itself, F.row_number().over(
        Window.partitionBy("query", "id").orderBy((~itself).cast("int"), F.desc("score")))))
    others_only = ranked.filter(F.coalesce(F.col("same") != 1, F.lit(True)))
    return others_only.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
