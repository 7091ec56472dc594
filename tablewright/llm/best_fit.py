"""Best-fit packing improved by swaps between underfull bins.

Documents become token ids and an end id. Ones longer than a bin are cut into
full bins and a rest. As only the number of pieces of each length matters, a bin
is known by the lengths in it, and a plan says how often each kind of bin is used:

1. Best fit decreasing, all pieces of a length at a time.
2. The least filled kind of bin gives a piece, or changes one piece or two for one
   or two shorter ones, with another underfull kind, so that the other gains as
   much as it can take. Each step is done in as many bins of both kinds as there
   are, and raises the sum of squared fills, so it comes to an end: when no kind of
   bin can make a step, or when there are no more bins than the pieces fill.

The plan is made on the driver and its size depends on the bin's capacity, not on
the corpus. Pieces find their places by their rank among pieces of their length;
ranks come from counts per task and length, so nothing is sorted or gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import kept, stored, texts

CAPACITY = 2048
_END = b"\0\0\0\0"
_CHARS, _AT_ONCE = 1 << 20, 5000
Kind = tuple[int, ...]  # the lengths in a bin, in order


class WordIds:
    """Ids of the tokenizers library for a vocabulary whose words end at white space, as little-endian 32-bit bytes.

    A text is cut at blanks and line feeds, which belong to no token, and each
    different chunk is encoded once, as long as ``cache_bytes`` can hold it: what
    has not been met since the last half of that was filled is forgotten. ASCII
    letters with a mark behind them are two words. Words unknown so far go to the
    library many at a time, set apart by an added token, and texts that hold an
    added token's string go there whole.
    """

    def __init__(self, path: str, cache_bytes: int = 1 << 28):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        self._added = {t.content: i for i, t in self._library.get_added_tokens_decoder().items()}
        self._half, self._held = cache_bytes // 2, 0
        self._old: dict[str, bytes] = {}
        self._new: dict[str, bytes] = {}
        self._marks = {m: self._encode(m) for m in ".,;:!?"}

    def _encode(self, text: str) -> bytes:
        return np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32).tobytes()

    def _encode_all(self, chunks: list[str]) -> dict[str, bytes]:
        if not self._added:
            return {c: self._encode(c) for c in chunks}
        (apart, number), found = next(iter(self._added.items())), {}
        for k in range(0, len(chunks), _AT_ONCE):
            part = chunks[k : k + _AT_ONCE]
            data = self._encode(apart.join(part))
            cuts = 4 * np.flatnonzero(np.frombuffer(data, np.uint32) == number)
            found.update((c, data[i:j]) for c, i, j in zip(part, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)]))
        return found

    def _word(self, chunk: str) -> tuple[str, bytes]:
        """The word to look up for a chunk, and the ids that follow it."""
        after = self._marks.get(chunk[-1:])
        word = chunk if after is None else chunk[:-1]
        if word.isascii() and word.isalpha():
            return word.lower(), after or b""
        return chunk, b""

    def _learn(self, chunks: set[str]) -> None:
        if self._held > self._half:
            self._old, self._new, self._held = self._new, {}, 0
        new, old = self._new, self._old
        missing = chunks.difference(new)
        again = {c for c in missing if c in old}
        cut = {c: self._word(c) for c in missing.difference(again)}
        words = {w for w, _ in cut.values()}.difference(new)
        both = {w for w in words if w in old}
        new.update((c, old[c]) for c in again | both)
        new.update(self._encode_all(list(words.difference(both))))
        new.update((c, new[word] + after) for c, (word, after) in cut.items())
        self._held += sum(len(c) + len(new[c]) + 200 for c in missing | words)

    def encode(self, several: list[str]) -> Iterator[bytes]:
        cut = [None if any(a in t for a in self._added) else t.replace("\n", " ").split(" ") for t in several]
        self._learn(set().union(*(chunks for chunks in cut if chunks)))
        known = self._new.__getitem__
        for text, chunks in zip(several, cut):
            yield self._encode(text) if chunks is None else b"".join(map(known, chunks))


# -- the plan ------------------------------------------------------------------


def _best_fit(counts: dict[int, int], capacity: int) -> Counter[Kind]:
    """Bins by best fit decreasing: each piece goes where it leaves least room."""
    by_room: dict[int, list[tuple[Kind, int]]] = {}
    rooms: list[int] = []

    def put(kind: Kind, room: int, bins: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((kind, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                kind, bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, kind, bins = capacity, (), left
            each = min(room // length, left)
            used = min(bins, left // each)
            put((*kind, *[length] * each), room - each * length, used)
            if bins > used and kind:
                put(kind, room, bins - used)
            left -= used * each
    found: Counter[Kind] = Counter()
    for kinds in by_room.values():
        for kind, bins in kinds:
            found[tuple(sorted(kind))] += bins
    return found


class _Underfull:
    """Kinds of bins with room left, by the lengths and sums of two lengths that they hold."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: Counter[Kind] = Counter()
        #: For each sum that a kind can give (0 for nothing): the kinds with their room, and the most room among them.
        self._kinds: dict[int, dict[Kind, int]] = defaultdict(dict)
        self.room = np.zeros(capacity + 1, np.int64)

    @staticmethod
    def sums(kind: Kind) -> dict[int, Kind]:
        """What one or two pieces of a bin add up to, and these pieces."""
        found: dict[int, Kind] = {a + b: (a, b) for a, b in combinations(kind, 2)}
        return found | {a: (a,) for a in kind}

    def add(self, kind: Kind, bins: int) -> None:
        """Adds bins, or takes them away where the number is negative."""
        if not kind or not bins:
            return
        room = self.capacity - sum(kind)
        known = kind in self.bins
        self.bins[kind] += bins
        if known and self.bins[kind]:
            return
        for s in (0, *self.sums(kind)):
            if known:
                kinds = self._kinds[s]
                del kinds[kind]
                if self.room[s] == room:
                    self.room[s] = max(kinds.values(), default=0)
            else:
                self._kinds[s][kind] = room
                self.room[s] = max(self.room[s], room)
        if known:
            del self.bins[kind]

    def step(self, source: Kind) -> tuple[Kind, Kind, Kind] | None:
        """The other kind, pieces it gets and pieces it gives, so that it gains most; None if no kind can gain.

        Only kinds at least as full as the source take part: then every gain raises the sum of squares.
        """
        self.add(source, -1)  # a bin of the same kind can be the other one
        try:
            own = self.sums(source)
            gives = np.array(sorted(own))
            takes = np.flatnonzero(self.room)
            gains = gives[:, None] - takes
            able = (gains > 0) & (gains <= self.room[takes])
            gains[~able] = 0
            for at in np.argsort(-gains, axis=None, kind="stable"):
                i, j = divmod(int(at), len(takes))
                gain, take = int(gains[i, j]), int(takes[j])
                if not gain:
                    return None
                fitting = [(room, kind) for kind, room in self._kinds[take].items() if room >= gain and sum(kind) >= sum(source)]
                if fitting:
                    other = min(fitting)[1]
                    return other, own[int(gives[i])], self.sums(other)[take] if take else ()
            return None
        finally:
            self.add(source, 1)


def _without(kind: Kind, pieces: Kind) -> list[int]:
    left = list(kind)
    for piece in pieces:
        left.remove(piece)
    return left


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Kind, int]]:
    """Kinds of bins for so many pieces of each length, with the number of bins of each."""
    bins = _best_fit({int(k): int(n) for k, n in counts.items() if n}, capacity)
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    full = Counter({k: n for k, n in bins.items() if sum(k) == capacity})
    under = _Underfull(capacity)
    for kind, n in bins.items():
        if kind not in full:
            under.add(kind, n)
    total, moved = bins.total(), True
    while moved and total > least:
        moved = False
        for source in sorted(under.bins, key=lambda k: (sum(k), k)):
            while total > least and source in under.bins and (found := under.step(source)):
                other, given, taken = found
                n = under.bins[source] // 2 if other == source else min(under.bins[source], under.bins[other])
                changed = [tuple(sorted([*_without(a, out), *into])) for a, out, into in ((source, given, taken), (other, taken, given))]
                for kind in (source, other):
                    under.add(kind, -n)
                total -= n * (not changed[0])
                under.add(changed[0], n)
                if sum(changed[1]) == capacity:
                    full[changed[1]] += n
                else:
                    under.add(changed[1], n)
                source, moved = changed[0], True
    return sorted([*full.items(), *under.bins.items()])


# -- pieces and places ---------------------------------------------------------


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts in groups of about a million characters."""
    docs, group, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), texts(batch, 1)):
        docs.append(doc)
        group.append(text)
        size += len(text)
        if size > _CHARS:
            yield docs, group
            docs, group, size = [], [], 0
    if group:
        yield docs, group


def pieces(
    docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its task and its rank among that task's pieces of the length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "rank"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("word ids", tokenizer_file), lambda: WordIds(tokenizer_file))
        shard, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            for ids_of, group in _groups(batch):
                for doc, ids in zip(ids_of, words.encode(group)):
                    ids += _END
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        length = len(part) // 4
                        rows.append((doc, piece, start, length, zlib.crc32(part), shard, seen[length]))
                        seen[length] += 1
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    chosen = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, rank long")


def _places(planned: list[tuple[Kind, int]]) -> np.ndarray:
    """Rows (length, first rank, pieces of it in a bin, first bin, offset) in order: where runs of ranks lie."""
    rows, used, bins = [], Counter(), 0
    for kind, n in planned:
        offset = 0
        for length, each in sorted(Counter(kind).items()):
            rows.append((length, used[length], each, bins, offset))
            used[length] += each * n
            offset += length * each
        bins += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5).T


def pack(
    docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Only a document of more than ``capacity`` ids is cut. A null or empty text is
    its end id alone. Null and repeated ids are kept, each row being a document; an
    empty table gives no piece. Other columns are not read, whatever their names.
    """
    cut = stored(pieces(docs, tokenizer_file, capacity, id_column, text_column), "cut")
    counts = stored(cut.groupBy("shard", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    length_of, first, each, bin_of, offset_of = _places(plan(totals, capacity))
    starts = length_of << 44 | first

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = np.searchsorted(starts, length << 44 | rank, "right") - 1
            turn = rank - first[row]
            sequence, offset = bin_of[row] + turn // each[row], offset_of[row] + turn % each[row] * length
            placed = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(placed, [*batch.schema.names[:5], "sequence_id", "offset"])

    before = "coalesce(sum(n) OVER (PARTITION BY length ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    ranked = cut.join(counts.selectExpr("shard", "length", f"{before} AS before"), ["shard", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
