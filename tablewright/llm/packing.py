"""Packing by minimum bin slack.

Every document becomes token ids and an end id and is cut at each full window;
what is left over is a piece of 1 to ``capacity`` - 1 ids. Only the number of
pieces of each length matters for the plan, at most ``capacity`` numbers, so the
plan is made on the driver whatever the size of the corpus:

* A window starts with the longest piece left. A bitset holds which sums the
  pieces left can reach; the fullest sum is taken and traced back to counts.
* The window so found is used as often as the counts allow, so the number of
  different windows depends on the number of lengths, not on the documents.

Pieces then find their places by their rank among the pieces of their length.
Ranks come from counts per shard and length: no sort, no group in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import kept, stored, texts
from tablewright.llm.vocabulary import ByteTokenizer

CAPACITY = 1024


def _reach(counts: dict[int, int], room: int) -> list[tuple[int, int, int]]:
    """Steps of the subset sum: (length, pieces in this step, bitset of sums before it)."""
    full, sums, steps = (1 << room + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, sums))
            sums = (sums | sums << length * part) & full
            left, part = left - part, part * 2
            if sums >> room & 1:
                return [*steps, (0, 0, sums)]
    return [*steps, (0, 0, sums)]


def _fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill a window best, the longest one among them.

    A sum that is a power of two needs no padding and counts as full.
    """
    first = max(counts)
    rest = {k: v - (k == first) for k, v in counts.items() if v > (k == first)}
    steps = _reach(rest, capacity - first)
    sums = steps[-1][2]
    best = sums.bit_length() - 1
    if best < capacity - first:
        powers = (1 << k for k in range(capacity.bit_length() - 1, -1, -1))
        best = next((p - first for p in powers if first <= p and sums >> p - first & 1), best)
    chosen = {first: 1}
    for length, part, before in reversed(steps[:-1]):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + part
            best -= length * part
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Windows as {length: pieces}, each with the number of times it is used."""
    left = {int(k): int(v) for k, v in counts.items() if v}
    windows = []
    while left:
        chosen = _fullest(left, capacity)
        times = min(left[k] // n for k, n in chosen.items())
        windows.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return windows


def _segments(windows: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces in a window, first sequence, offset)."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for chosen, times in windows:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            found.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return {k: np.array(v, np.int64) for k, v in found.items()}


_PIECES = (
    "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, shard int, rank long"
)


def pieces(
    docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Pieces of every document with their shard and their rank among its pieces of that length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept(tokenizer_file, lambda: ByteTokenizer(tokenizer_file))
        shard, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            columns: list[list[int]] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch, 1)):
                ids = tokenizer.encode(text) + b"\0\0\0\0"
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(columns, (doc, start, length, zlib.crc32(part), n, shard, rank)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, _PIECES)


def pack(
    docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A null or empty text is its end id alone. Null and repeated ids are kept, each
    row being a document. An empty table gives no piece. Other columns are not read.
    """
    cut = stored(pieces(docs, tokenizer_file, capacity, id_column, text_column), "pieces")
    counts = cut.groupBy("length", "shard").count()
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    totals = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    segments = _segments(plan(totals, capacity))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for own in np.unique(length):
                at = np.flatnonzero(length == own)
                row = segments[int(own)]
                row = row[np.searchsorted(row[:, 0], rank[at], "right") - 1]
                turn = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + turn // row[:, 1]
                offset[at] = row[:, 3] + turn % row[:, 1] * own
            placed = [batch.column(0), batch.column(1), pa.array(length.astype(np.int64)), batch.column(3), batch.column(4)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*placed, pa.array(sequence), pa.array(offset)], names)

    ranked = cut.join(offsets.select("shard", "length", "before"), ["shard", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
