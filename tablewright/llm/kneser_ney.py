"""Interpolated modified Kneser-Ney trigram model, counted and scored in Spark.

Words are known by the 64-bit hash of their bytes. All files hold sorted arrays
that workers map into memory; nothing of the model but a few numbers is sent.

1. Tasks count their words and send sorted hashes to buckets of the hash space. A
   bucket writes its hashes and counts; a word's number is its place among all.
2. Tasks number the words of their texts and send triples (two words before, word)
   to the bucket of the middle word. Words that alone would fill a bucket are
   split: their triples go to a bucket of the first two words, and once more to one
   of the last two, where the pairs are counted.
3. A bucket of triples writes them nested: middle words, first words of each, last
   words of each pair with counts. Beside them it writes pairs (middle, last) with
   the number of different words before; sums of a context are sums of a slice.
   It sends on how many different words have stood before each last word.
4. A bucket of words adds these up and writes them in the order of its words.

Sums reach the driver, and the totals of words that were split: of these there are
at most as many as buckets. Files are whole or absent, every bucket writes its
files, and a missing one is an error.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.shared import kept, lower_words, new_path, texts

_END = b"\n"  # no word holds white space
_GROUP, _CACHE_BYTES, _HELD = 2_000_000, 5 << 24, 3_000_000
_BYTES_A_TOKEN, _WORDS_A_BUCKET = 6, 1 << 21
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Hashes of words met lately, up to a number of bytes."""

    def __init__(self) -> None:
        super().__init__()
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        self.bytes += len(word) + 130
        return value


def _token_groups(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Runs of texts: (batch, first row, hash of each token, tokens of each text)."""
    hashes = kept("word hashes", _Hashes)

    def arrays(words: list[bytes]) -> np.ndarray:
        if hashes.bytes > _CACHE_BYTES:
            hashes.clear()
            hashes.bytes = 0
        return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))

    for batch in batches:
        parts, words, sizes, row = [], [], [], 0
        for i, text in enumerate(texts(batch, column)):
            own = lower_words(text)
            words += own
            words.append(_END)
            sizes.append(len(own) + 1)
            if len(words) > _GROUP // 8:
                parts.append(arrays(words))
                words = []
                if sum(map(len, parts)) > _GROUP:
                    yield batch, row, np.concatenate(parts), np.array(sizes)
                    parts, sizes, row = [], [], i + 1
        if sizes:
            yield batch, row, np.concatenate([*parts, arrays(words)]), np.array(sizes)


# -- arrays --------------------------------------------------------------------


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, all of them sorted together."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.r_[starts, size]).astype(np.int64)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def _order(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """The order of keys, of which the first one decides first; equal ones come in any order."""
    if len(keys) > 1 and all(not len(k) or k.max() < 1 << 32 for k in keys[:2]):  # two keys as one
        keys = (keys[0].astype(np.uint64) << np.uint64(32) | keys[1].astype(np.uint64), *keys[2:])
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def _summed(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys in order (the first one decides first) without repeats, and the sums of n."""
    order = _order(keys)
    keys = tuple(k[order] for k in keys)
    starts = _runs(*keys)
    return [k[starts] for k in keys], _sums(n[order], starts)


def _counted(keys: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    return _summed(keys, np.ones(len(keys[0]), np.int64))


def _packed(values: np.ndarray, rising: bool = False) -> bytes:
    """An array of whole numbers as bytes: differences where it rises, byte planes, zstandard."""
    wide = np.diff(values, prepend=values[:1] * 0) if rising else values
    kind = np.min_scalar_type(int(wide.max())) if len(wide) else np.dtype("u1")
    planes = np.ascontiguousarray(wide.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)
    return kind.str.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    kind = np.dtype(data[:3].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[3:]), np.uint8)
    values = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel().astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if rising else values


_NOTHING = _packed(np.zeros(0, np.uint64))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The array in the narrowest kind that holds its largest value."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values.astype("u1")


def _by_bucket(bucket: np.ndarray, columns: tuple[np.ndarray, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The slices of the columns that belong to each bucket, in their order."""
    if len(bucket):
        bucket = bucket.astype(np.min_scalar_type(int(bucket.max())))  # the fewer bytes, the faster sorted
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], tuple(c[order] for c in columns)
    starts = _runs(bucket)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), [c[a:b] for c in columns]


# -- files ---------------------------------------------------------------------


def _write(folder: str, name: str, *columns: np.ndarray) -> None:
    """A file of arrays, each padded to eight bytes, after their kinds and sizes. Whole or absent, however often it is tried."""
    system, path = FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    trial = f"{path}/.{name}-{uuid4().hex}"
    with system.open_output_stream(trial) as out:
        for c in columns:
            out.write(c.dtype.str.encode().ljust(8) + np.int64(c.nbytes).tobytes())
        for c in columns:
            out.write(c.tobytes())
            out.write(b"\0" * (-c.nbytes % 8))
    system.move(trial, f"{path}/{name}")


class _Files:
    """The arrays of files, mapped into memory once for a task."""

    def __init__(self, words: _Words):
        self._words = words
        self._open: dict[str, list[np.ndarray]] = {}

    def read(self, name: str, columns: int) -> list[np.ndarray]:
        if name not in self._open:
            path = f"{_local(self._words.folder if name.startswith('words-') else self._words.grams)}/{name}"
            if not os.path.exists(path):
                raise FileNotFoundError(f"The model's file {path} is gone or not seen from here; train again in a shared folder.")
            with open(path, "rb") as file:
                data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
            at, found = 16 * columns, []
            for k in range(columns):
                kind = np.dtype(data[16 * k : 16 * k + 8].decode().strip())
                size = int(np.frombuffer(data, np.int64, 1, 16 * k + 8)[0])
                found.append(np.frombuffer(data, kind, size // kind.itemsize, at))
                at += size + -size % 8
            self._open[name] = found
        return self._open[name]


def _uri(spark: SparkSession, path: str) -> str:
    """The path as Spark's writers resolve it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _reachable(spark: SparkSession, folder: str) -> None:
    """A shared folder that is no mounted file system: Spark brings the files to executors."""
    if urlparse(folder).scheme != "file":
        spark.sparkContext.addFile(folder, recursive=True)


def _local(folder: str) -> str:
    where = urlparse(folder)
    return unquote(where.path) if where.scheme == "file" else SparkFiles.get(where.path.rpartition("/")[2])


# -- words ---------------------------------------------------------------------


@dataclass(frozen=True)
class _Words:
    """The numbered words: ``firsts`` has the first number of each of 2^bits buckets, then the number of words."""

    folder: str
    bits: int
    firsts: tuple[int, ...]
    tokens: int
    hot: tuple[int, ...]  # numbers of the words that are split

    @property
    def distinct(self) -> int:
        return self.firsts[-1]

    @property
    def grams(self) -> str:
        """The folder of all that is counted after the words."""
        return f"{self.folder}-grams"

    @property
    def kind(self) -> type:
        """The kind of a word's number, with room for the marks before a text and for unknown words."""
        return np.uint32 if self.distinct + 3 < 1 << 32 else np.uint64

    def look_up(self, files: _Files, hashes: np.ndarray, more: bool = False) -> tuple[np.ndarray, ...]:
        """Numbers of words (sorted hashes); with ``more`` also their counts and the words before. An unknown one is number distinct + 2."""
        numbers = np.full(len(hashes), self.distinct + 2, self.kind)
        counts, before = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        bucket = hashes >> np.uint64(64 - self.bits)
        starts = _runs(bucket)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(hashes)]):
            k = int(bucket[a])
            known, times = files.read(f"words-{k}", 2)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
            there = known[at] == hashes[a:b]
            numbers[a:b][there] = (at + self.firsts[k])[there]
            if more:
                counts[a:b] = np.where(there, times[at], 0)
                before[a:b] = np.where(there, files.read(f"before-{k}", 1)[0][at], 0)
        return (numbers, counts, before) if more else (numbers,)

    def is_hot(self, numbers: np.ndarray) -> np.ndarray:
        hot = np.array(self.hot, self.kind).astype(numbers.dtype)
        if not len(hot):
            return np.zeros(len(numbers), bool)
        return hot[np.minimum(np.searchsorted(hot, numbers), len(hot) - 1)] == numbers


def _count_words(docs: DataFrame, text_column: str, folder: str, bits: int, hot_tokens: int) -> _Words:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            (keys,), n = _summed((np.concatenate([k for k, _ in held]),), np.concatenate([c for _, c in held]))
            found = list(_by_bucket((keys >> np.uint64(64 - bits)).astype(np.int64), (keys, n)))
            columns = [pa.array([k for k, _ in found], pa.int32()), *(pa.array([_packed(c[i], i == 0) for _, c in found], pa.binary()) for i in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, _, tokens, _ in _token_groups(batches, 0):
            held.append(np.unique(tokens, return_counts=True))
            if sum(len(k) for k, _ in held) > _HELD:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            parts = [(_unpacked(a, True), _unpacked(b)) for a, b in rows]
            (keys,), n = _summed((np.concatenate([k for k, _ in parts]),), np.concatenate([c for _, c in parts]))
            _write(folder, f"words-{bucket}", keys, _narrow(n))
            hot = np.flatnonzero(n >= hot_tokens)
            names = ["bucket", "distinct", "tokens", "hot"]
            found = [[bucket], [len(keys)], [int(n.sum())], [hot.tolist()]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], names)

    spark, buckets = docs.sparkSession, 1 << bits
    counted = docs.select(text_column).mapInArrow(count, "bucket int, a binary, b binary")
    placed = counted.unionByName(_every_bucket(spark, buckets, 2)).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    # a row a bucket, and in it no more words than have hot_tokens each
    found = sorted(placed.mapInArrow(write, "bucket long, distinct long, tokens long, hot array<long>").collect())
    firsts = np.cumsum([0, *(r["distinct"] for r in found)])
    hot = sorted(int(firsts[r["bucket"]]) + i for r in found for i in r["hot"])
    return _Words(folder, bits, tuple(firsts.tolist()), sum(r["tokens"] for r in found), tuple(hot))


def _every_bucket(spark: SparkSession, buckets: int, columns: int) -> DataFrame:
    """An empty row for each bucket, so that each has its files."""
    empty = [F.lit(_NOTHING).alias(c) for c in "abcd"[:columns]]
    return spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), *empty)


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each bucket, without the bucket; they come in order of buckets."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at:
                if held:
                    yield at, held
                at, held = row[0], []
            held.append(row[1:])
    if held:
        yield at, held


# -- triples -------------------------------------------------------------------


def _contexts(numbers: np.ndarray, sizes: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each token; before a text stand two marks."""
    starts = np.cumsum(sizes) - sizes
    first, second = np.empty_like(numbers), np.empty_like(numbers)
    second[1:], first[2:] = numbers[:-1], numbers[:-2]
    first[:2] = distinct
    second[starts], first[starts] = distinct + 1, distinct
    longer = starts[sizes > 1] + 1
    first[longer] = distinct + 1
    return first, second


def _spread(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    mixed = (a * _MIX ^ (b + _SPREAD)) * _SPREAD
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIX) >> np.uint64(33)).astype(np.int64) % buckets


def _home(words: _Words, buckets: int, middle: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The bucket of a middle word, or of it and the other word where it is split."""
    home = np.minimum((middle * (buckets / (words.distinct + 3))).astype(np.int64), buckets - 1)
    hot = np.flatnonzero(words.is_hot(middle))
    home[hot] = _spread(middle[hot], other[hot], buckets)
    return home


def _nested(keys: list[np.ndarray], values: np.ndarray) -> list[np.ndarray]:
    """Sorted keys as, for each key, its different values and how many of the next one each has, then the values."""
    found, starts = [], _runs(keys[0])
    for k in range(len(keys) - 1):
        below = _runs(*keys[: k + 2])
        found += [keys[k][starts], np.diff(np.r_[np.searchsorted(below, starts), len(below)])]
        starts = below
    return [*map(_narrow, [*found, keys[-1], values])]


def _shares(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


_SUMS = "kind string, key long, a long, b long, c long, d long"


def _write_bucket(words: _Words, bucket: int, rows: list[tuple]) -> tuple[list[np.ndarray], list[tuple]]:
    """Writes the files of a bucket; gives last words with the different words before each, and rows of sums."""
    parts = [[_unpacked(data, k == 0) for k, data in enumerate(row[1:])] for row in rows if row[0] == 0]
    none = np.zeros(0, np.uint64)
    middle, first, last, n = (np.concatenate([none, *c]) for c in (zip(*parts) if parts else [[]] * 4))
    (middle, first, last), n = _summed((middle, first, last), n.astype(np.int64))
    _write(words.grams, f"triples-{bucket}", *_nested([middle, first, last], n))
    own = ~words.is_hot(middle)
    pairs, before = _counted((middle[own], last[own]))
    parts = [[_unpacked(data, k == 0) for k, data in enumerate(row[1:4])] for row in rows if row[0] == 1]
    split = tuple(np.concatenate([none, *c]) for c in (zip(*parts) if parts else [[]] * 3))
    (m, w, _), _ = _counted((split[0], split[2], split[1]))
    hot, of_hot = _counted((m, w))
    sums = [("triples", 0, *_shares(n)), ("pairs", 0, *_shares(np.r_[before, of_hot]))]
    starts = _runs(hot[0])
    totals = [_sums(x, starts).tolist() for x in (of_hot, of_hot == 1, of_hot == 2, of_hot > 2)]
    sums += [("split", int(k), *t) for k, *t in zip(hot[0][starts], *totals)]
    pairs, before = _summed((np.r_[pairs[0], hot[0]], np.r_[pairs[1], hot[1]]), np.r_[before, of_hot])
    _write(words.grams, f"pairs-{bucket}", *_nested(pairs, before))
    (ends,), contexts = _counted((pairs[1],))
    return [ends, contexts], sums


def _count_triples(docs: DataFrame, text_column: str, words: _Words, buckets: int) -> dict[tuple[str, int], list[int]]:
    """Writes the files of triples, pairs and words before; the sums by kind and key."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(words)

        def rows(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
            keys, n = _counted(tuple(np.concatenate(c) for c in zip(*held)))
            hot = words.is_hot(keys[0])
            for role, chosen, other in ((0, slice(None), 1), (1, hot, 2)):
                own = tuple(k[chosen] for k in (*keys, n))
                for bucket, columns in _by_bucket(_home(words, buckets, own[0], own[other]), own):
                    yield bucket, role, *(_packed(c, k == 0) for k, c in enumerate(columns))

        def batch(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows(held)), kinds)], ["bucket", "role", *"abcd"])

        held: list[tuple[np.ndarray, ...]] = []
        for _, _, tokens, sizes in _token_groups(batches, 0):
            several, place = np.unique(tokens, return_inverse=True)
            numbers = words.look_up(files, several)[0][place]
            first, second = _contexts(numbers, sizes, words.distinct)
            held.append((second, first, numbers))
            if sum(len(x[0]) for x in held) > _HELD:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    word_buckets = len(words.firsts) - 1

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            (ends, contexts), sums = _write_bucket(words, bucket, rows)
            home = np.searchsorted(np.array(words.firsts[1:], np.uint64), ends, "right")
            sent = [(k, _packed(e, True), _packed(c), None) for k, (e, c) in _by_bucket(home, (ends, contexts))]
            told = [(0, _NOTHING, _NOTHING, s) for s in sums]
            kinds = [pa.int32(), pa.binary(), pa.binary(), _SUM_TYPE]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sent, *told), kinds)], ["bucket", "a", "b", "told"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _buckets(batches):
            size, first = words.firsts[bucket + 1] - words.firsts[bucket], words.firsts[bucket]
            before = np.zeros(size, np.int64)
            for a, b, _ in rows:
                at = _unpacked(a, True).astype(np.int64) - first
                before[at] += _unpacked(b).astype(np.int64)  # a row has no word twice
            _write(words.grams, f"before-{bucket}", _narrow(before))
            more = [("words", 0, *_shares(before)), ("contexts", 0, int(before.sum()), int((before > 2).sum()), 0, 0)]
            found = [*(tuple(s.values()) for *_, s in rows if s is not None), *more]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), _SUM_TYPE)], [t.name for t in _SUM_TYPE])

    spark = docs.sparkSession
    counted = docs.select(text_column).mapInArrow(count, "bucket int, role int, a binary, b binary, c binary, d binary")
    empty = _every_bucket(spark, buckets, 4).withColumn("role", F.lit(0))
    placed = counted.unionByName(empty).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    sent = placed.mapInArrow(write, f"bucket int, a binary, b binary, told struct<{_SUMS.replace(' ', ':').replace(',:', ',')}>")
    nobody = _every_bucket(spark, word_buckets, 2).withColumn("told", F.lit(None).cast(sent.schema["told"].dataType))
    home = sent.unionByName(nobody).repartitionById(word_buckets, "bucket").sortWithinPartitions("bucket")
    # one row for each kind, and for each word that was split
    sums = home.mapInArrow(add, _SUMS).groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in "abcd")).collect()
    return {(r["kind"], r["key"]): [r[c] for c in "abcd"] for r in sums}


_SUM_TYPE = pa.struct([("kind", pa.string()), *((c, pa.int64()) for c in ("key", *"abcd"))])


def _discounts(counts: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from how many entries have counts 1 to 4.

    Where a small corpus lacks one of these, three quarters stand in.
    """
    n1, n2, n3, n4 = counts
    found = [0.0, 0.75, 0.75, 0.75]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            value = k - (k + 1) * y * high / low if low else 0.75
            found[k] = value if 0 < value < k else 0.75
    return np.array(found)


@dataclass(frozen=True)
class Model:
    words: _Words
    buckets: int
    discounts: tuple[tuple[float, ...], ...]  # of words, pairs and triples
    contexts: int  # different pairs
    unseen: float  # what the lowest order gives to a token never seen
    split: tuple[tuple[int, ...], ...]  # of words that were split: number, total, entries with 1, 2 and more

    @property
    def tokens(self) -> int:
        return self.words.tokens

    @property
    def distinct(self) -> int:
        return self.words.distinct


def train(docs: DataFrame, text_column: str = "text", bucket_tokens: int = 1 << 20) -> Model:
    """Count the texts (null as empty) and store the model.

    ``bucket_tokens`` says how many tokens a bucket of triples is made for, some 50
    bytes each, and from how many on a word is split; it does not change the
    result. The number of buckets follows the bytes of the texts.
    """
    spark = docs.sparkSession
    folder = _uri(spark, new_path(spark, "kneser-ney"))
    size, rows = docs.agg(F.sum(F.octet_length(text_column)), F.count("*")).first()
    guess = (size or 0) // _BYTES_A_TOKEN + rows
    bits = max(3, (guess // _WORDS_A_BUCKET).bit_length())
    buckets = max(8, -(-guess // bucket_tokens))
    words = _count_words(docs, text_column, folder, bits, bucket_tokens)
    _reachable(spark, folder)
    sums = _count_triples(docs, text_column, words, buckets)
    contexts, more = sums[("contexts", 0)][:2]
    kinds = tuple(tuple(_discounts(sums[(k, 0)]).tolist()) for k in ("words", "pairs", "triples"))
    m1, m2 = sums[("words", 0)][:2]
    share = (kinds[0][1] * m1 + kinds[0][2] * m2 + kinds[0][3] * more) / contexts if contexts else 1.0
    split = tuple(sorted((k, *v) for (kind, k), v in sums.items() if kind == "split"))
    return Model(words, buckets, kinds, contexts, share / (words.distinct + 1), split)


# -- scores --------------------------------------------------------------------


def _find(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands in its slice [low, high) of sorted values, and whether it is there."""
    if not len(values):
        return low, np.zeros(len(low), bool)
    at, stop = low.copy(), high.copy()
    live = np.flatnonzero(at < stop)
    while len(live):
        a, b = at[live], stop[live]
        middle = a + b >> 1
        less = values[middle] < wanted[live]
        a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
        at[live], stop[live] = a, b
        live = live[a < b]
    return at, (at < high) & (values[np.minimum(at, len(values) - 1)] == wanted)


def _before(values: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Sums of the values before each place, and of all."""
    found = np.zeros(len(values) + 1, kind)
    np.cumsum(values, dtype=kind, out=found[1:])
    return found


def _slice_sums(values: np.ndarray, low: np.ndarray, high: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values and of their discounts over slices [low, high); only the slices are read, not all values."""
    total, left = np.zeros(len(low), np.int64), np.zeros(len(low))
    sizes = high - low
    singles = np.flatnonzero(sizes == 1)  # most contexts have been seen with one word only
    own = values[low[singles]]
    total[singles], left[singles] = own, off[np.minimum(own, 3)]
    several = np.flatnonzero(sizes > 1)
    ends = np.cumsum(sizes[several])
    a = 0
    while a < len(several):  # so many values at once as memory is meant for, or one slice
        gone = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, gone + _HELD, "right")))
        chosen = several[a:b]
        starts = ends[a:b] - sizes[chosen] - gone
        places = np.repeat(low[chosen] - starts, sizes[chosen])
        places += np.arange(len(places))
        own = values[places]
        total[chosen] = _sums(own, starts)
        left[chosen] = np.add.reduceat(off[np.minimum(own, 3)], starts)
        a = b
    return total, left


def _nested_counts(arrays: list[np.ndarray], keys: list[np.ndarray], off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nested arrays the value under each key, and the sums of values and of discounts over keys that differ in the last part only.

    Neighbours with equal first parts are looked up once, so keys are best sorted by these.
    """
    firsts, starts = arrays[0], _runs(keys[0])
    low, there = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    if len(firsts):
        own = keys[0][starts]
        low = np.searchsorted(firsts, np.minimum(own, firsts[-1]).astype(firsts.dtype))
        there = firsts[low] == own
    for k, key in enumerate(keys[1:], 1):
        stops = _before(arrays[2 * k - 1])
        at = np.where(there, low, 0)
        low, end = np.where(there, stops[at], 0), np.where(there, stops[np.minimum(at + 1, len(stops) - 1)], 0)
        if k < len(keys) - 1:
            finer = _runs(*keys[: k + 1])
            run = np.searchsorted(starts, finer, "right") - 1
            starts = finer
            low, there = _find(arrays[2 * k], low[run], end[run], key[starts])
    values, times = arrays[-1], _lengths(starts, len(keys[0]))
    total, left = (np.repeat(x, times) for x in _slice_sums(values, low, end, off))
    low, there = _find(arrays[-2], np.repeat(low, times), np.repeat(end, times), keys[-1])
    found = np.zeros(len(low), np.int64)
    found[there] = values[low[there]]
    return found, total, left


def _level(
    files: _Files, kind: str, home: np.ndarray, keys: tuple[np.ndarray, ...], discounts: tuple[float, ...]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of keys in their buckets, and of their contexts the sums of counts and of discounts."""
    count, total, left = (np.zeros(len(home), kind) for kind in (np.int64, np.int64, np.float64))
    off = np.array(discounts)
    for bucket, (place, *own) in _by_bucket(home, (np.arange(len(home), dtype=np.int32), *keys)):
        found = _nested_counts(files.read(f"{kind}-{bucket}", 2 * len(keys)), own, off)
        for values, part in zip((count, total, left), found):
            values[place] = part
    return count, total, left


def _interpolated(count: np.ndarray, total: np.ndarray, left: np.ndarray, discounts: tuple[float, ...], lower: np.ndarray) -> np.ndarray:
    off = np.array(discounts)
    upper = np.maximum(count - off[np.minimum(count, 3)], 0)
    return np.where(total > 0, (upper + left * lower) / np.maximum(total, 1), lower)


def _chances(model: Model, files: _Files, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token after the two before, and its training count."""
    words = model.words
    several, place = np.unique(tokens, return_inverse=True)
    numbers, times, before = words.look_up(files, several, more=True)
    off = np.array(model.discounts[0])
    chance = np.maximum(before - off[np.minimum(before, 3)], 0) / max(1, model.contexts) + model.unseen
    last = numbers[place]
    first, middle = _contexts(last, sizes, words.distinct)
    order = _order((middle, first))
    first, middle, last, place = first[order], middle[order], last[order], place[order]
    _, lower, upper = model.discounts
    count, total, left = _level(files, "pairs", _home(words, model.buckets, middle, last), (middle, last), lower)
    if model.split:
        split = np.array(model.split, np.int64)
        hot = np.flatnonzero(words.is_hot(middle))
        own = middle[hot].astype(np.int64)
        at = np.minimum(np.searchsorted(split[:, 0], own), len(split) - 1)
        there = split[at, 0] == own
        total[hot] = np.where(there, split[at, 1], 0)
        left[hot] = np.where(there, split[at, 2:] @ np.array(lower[1:]), 0)
    chance = _interpolated(count, total, left, lower, chance[place])
    found = _level(files, "triples", _home(words, model.buckets, middle, first), (middle, first, last), upper)
    chances, counts = np.empty(len(order)), np.empty(len(order), np.int64)
    chances[order], counts[order] = _interpolated(*found, upper, chance), times[place]
    return chances, counts


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", flag: Column | None = None) -> DataFrame:
    """doc_id, flag, n_tokens, n_known, base_score, score of every row.

    Tokens are the words of the whole text, then one end. ``score`` is the model's
    log10 probability of the text, ``base_score`` that of add-one unigrams. A null
    or empty text is its end alone. Null and repeated ids are kept, equal texts get
    equal scores, an empty table gives no rows, and other columns are not read. A
    model whose files are gone is an error.
    """
    for folder in (model.words.folder, model.words.grams):
        _reachable(docs.sparkSession, folder)
    floor = model.tokens + model.distinct + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(model.words)
        for batch, row, tokens, sizes in _token_groups(batches, 2):
            chance, times = _chances(model, files, tokens, sizes)
            starts = np.cumsum(sizes) - sizes
            values = [
                sizes,
                np.add.reduceat((times > 0).astype(np.int64), starts),
                np.add.reduceat(np.log10((times + 1.0) / floor), starts),
                np.add.reduceat(np.log10(chance), starts),
            ]
            part = batch.slice(row, len(sizes))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *map(pa.array, values)],
                ["doc_id", "flag", "n_tokens", "n_known", "base_score", "score"],
            )

    flag = F.lit(False) if flag is None else flag
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), flag.alias("flag"), F.col(text_column))
    return chosen.mapInArrow(run, "doc_id long, flag boolean, n_tokens long, n_known long, base_score double, score double")


def held_out(id_column: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    """Whether the CRC-32 of the id as text falls into the fold; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds == fold


def drop_model(spark: SparkSession, model: Model) -> None:
    for folder in (model.words.folder, model.words.grams):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
