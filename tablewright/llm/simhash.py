"""SimHash near duplicates: pigeonhole blocks, then Hamming distance, then components.

A fingerprint is 64 bits. Cut into seven blocks, two fingerprints that differ in
at most four bits agree on at least three blocks, so they meet in at least one
of the 35 buckets "these three blocks have these values". A bucket fixes 27 or
28 bits: among N random fingerprints it holds about N / 2^27.

* Exact copies are one fingerprint before anything is compared.
* In a bucket, a search from one fingerprint to the next takes away all that it
  reaches, so a group of m near copies gives m - 1 links and not m * m / 2.
* A bucket over ``bucket_rows`` is passed on, not compared: its open bits are
  cut into eight, of which a close pair shares four, and its rows go to 70
  narrower buckets each. These leave at most 20 bits open, so none can have
  more than 2^20 fingerprints (8 MB).

Texts that share four fifths of their shingles differ in about ten bits of 64, and
a pigeonhole for so many leaves buckets of a few bits. ``drop_near_duplicates``
therefore takes wider fingerprints: 192 bits and more, of the sets of shingles,
each shingle with votes of its own weight for each bit. Blocks of 12 bits and more
are the buckets, so many of them that a pair is lost as rarely as stated at
``_LOST``; in a bucket fingerprints link by their distance over 192 bits, and
shingle sets are compared in full in the components of these links, each set once.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import lower_words, row_keys, stored, texts

DISTANCE = 4
SEED = 42
_SMALL = 8
#: Longs of a wide fingerprint that are compared, and the differing bits at which they link. A pair with Jaccard 0.8
#: differs in 29 of 192 on the average (standard deviation 5), unrelated texts in 96 (7).
_LONGS, _WIDE_DISTANCE = 3, 50
#: The chance that such a pair shares no block, and the share of bits in which it differs: its angle over pi.
_LOST, _DIFFERING = 1 / 13_800, 0.1515
#: Rows a bucket aimed at; blocks are of 12 bits at least.
_ROWS, _LEAST_BITS = 512, 12
_DRAW = np.random.Generator(np.random.PCG64(SEED))
_TIMES, _PLUS = (_DRAW.integers(0, 1 << 64, 1024, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def _shingles(text: str, width: int) -> np.ndarray:
    """Hashes of the text's word shingles in order, repeats included; a shorter text is one shingle, an empty one none."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - width)].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(text: str, width: int = 4) -> int:
    """SimHash of the text's word shingles, repeats included, as unsigned 64 bits."""
    hashes = _shingles(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4) -> DataFrame:
    """doc_id, text_hash, fingerprint (as signed long) of every row; a null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in texts(batch, 2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "text_hash", "fingerprint"]
            )

    chosen = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), row_keys(id_column, text_column)["_text"].alias("text_hash"), F.col(text_column)
    )
    return chosen.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def _blocks(bits: list[int], n: int) -> list[int]:
    """n masks that cut the given bit positions into nearly equal runs."""
    edges = np.linspace(0, len(bits), n + 1).astype(int)
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(edges, edges[1:])]


def _joint(masks: list[int], shared: int) -> list[int]:
    return [sum(c) for c in combinations(masks, shared)]


def _narrower(mask: int, distance: int) -> list[int]:
    """Masks that add to a bucket's mask, so that a close pair agrees on one of them."""
    open_bits = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in _joint(_blocks(open_bits, 2 * distance), distance)]


def _search(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the values of a bucket as all close pairs would."""
    left, right = [], []
    rest = values
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), at))
                right.append(found)
                reached.extend(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links_of(new_bucket: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets; ``new_bucket`` is true where a row begins one."""
    starts = np.flatnonzero(new_bucket)
    sizes = np.diff(np.r_[starts, len(values)])
    number, of_row = np.cumsum(new_bucket), np.repeat(sizes, sizes)
    left, right = [], []
    for step in range(1, min(_SMALL, int(sizes.max(initial=0)))):
        i = np.flatnonzero((of_row[step:] <= _SMALL) & (number[step:] == number[:-step]))
        i = i[np.bitwise_count(values[i] ^ values[i + step]) <= distance]
        left.append(values[i])
        right.append(values[i + step])
    for k in np.flatnonzero(sizes > _SMALL):
        a, b = _search(values[starts[k] : starts[k] + sizes[k]], distance)
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _matcher(distance: int, bucket_rows: int | None):
    """Reads rows sorted by bucket; gives links with mask -1, and the rows of buckets over the limit as they are."""

    def rows(mask: int, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"mask": np.full(len(a), mask, np.int32), "a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks, buckets, values = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        over = None
        for batch in batches:
            m, b = batch["mask"].to_numpy(), batch["bucket"].to_numpy()
            v = batch["fingerprint"].to_numpy().view(np.uint64)
            if over is not None:
                n = int(((m == over[0]) & (b == over[1])).sum())
                yield rows(over[0], v[:n], v[:n])
                m, b, v = m[n:], b[n:], v[n:]
            if not len(m):
                continue
            over = None
            masks, buckets, values = np.r_[masks, m], np.r_[buckets, b], np.r_[values, v]
            new = np.r_[True, (masks[1:] != masks[:-1]) | (buckets[1:] != buckets[:-1])]
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield rows(-1, *_links_of(new[:last], values[:last], distance))
            masks, buckets, values = masks[last:], buckets[last:], values[last:]
            if bucket_rows is not None and len(values) > bucket_rows:
                over = int(masks[0]), int(buckets[0])
                yield rows(over[0], values, values)
                masks, buckets, values = masks[:0], buckets[:0], values[:0]
        if len(values):
            yield rows(-1, *_links_of(np.arange(len(values)) == 0, values, distance))

    return run


def links(marks: DataFrame, distance: int = DISTANCE, bucket_rows: int = 65_536) -> DataFrame:
    """a, b: links between different fingerprints that join all that close pairs join.

    ``marks`` has one column, ``fingerprint``, without repeats. ``bucket_rows``
    only decides where a bucket is compared; no pair is lost beyond it.
    """
    masks = _joint(_blocks(list(range(64)), distance + 3), 3)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    in_bucket = F.explode(
        F.array(*(
            F.struct(F.lit(i).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bucket"))
            for i, m in enumerate(signed)
        ))
    ).alias("at")
    wide = marks.select(in_bucket, "fingerprint").select("at.mask", "at.bucket", "fingerprint")
    found = stored(_matched(wide, distance, bucket_rows), "simhash-links")

    def narrow(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, part in batch.groupby("mask"):
                own = _narrower(masks[number], distance)
                values = part["a"].to_numpy().view(np.uint64)
                for k, mask in enumerate(own):
                    yield pd.DataFrame({
                        "mask": np.full(len(values), number * len(own) + k, np.int32),
                        "bucket": (values & np.uint64(mask)).view(np.int64),
                        "fingerprint": values.view(np.int64),
                    })

    crowded = found.filter("mask >= 0").mapInPandas(narrow, "mask int, bucket long, fingerprint long")
    apart = _matched(crowded, distance, None)
    return found.filter("mask < 0").select("a", "b").unionByName(apart.select("a", "b"))


def _matched(rows: DataFrame, distance: int, bucket_rows: int | None) -> DataFrame:
    by_bucket = rows.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket")
    return by_bucket.mapInPandas(_matcher(distance, bucket_rows), "mask int, a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the component's smallest node.

    Alternates two steps until nothing changes: every larger neighbour of a node
    moves to the smallest one, then every smaller one does. Each step is a
    grouped minimum and a join with it, and ends in a stored table.
    """
    larger, smaller = F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")
    rows = edges.count()
    current = stored(edges.select(larger, smaller).filter("v != u").distinct(), "components", rows)
    before = None
    while True:
        both = current.unionByName(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        moved = both.join(lowest, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        moved = stored(moved.distinct(), "components", rows)
        lowest = moved.groupBy("v").agg(F.min("u").alias("m"))
        joined = moved.join(lowest, "v").filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        current = stored(joined.unionByName(lowest.withColumnRenamed("m", "u")).distinct(), "components", rows)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before, rows = state, state[0]


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, distance: int = DISTANCE
) -> DataFrame:
    """doc_id, text_hash, fingerprint, root, component_id for every row.

    Fingerprints that differ in at most ``distance`` bits are linked; root is the
    smallest fingerprint reachable over links and component_id the smallest id,
    null only if all ids there are null. A null or empty text has fingerprint
    zero and is linked like any other. Repeated rows, also of one id, each give a
    row. An empty table gives none. Other columns are not read, whatever their names.
    """
    rows = stored(fingerprints(docs, id_column, text_column, width), "fingerprints")
    firsts = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fingerprint"), distance)).withColumnRenamed("node", "fingerprint")
    placed = firsts.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(names, "root").select("fingerprint", "root", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "text_hash", "fingerprint", "root", "component_id")


def hex_digits(mark: Column) -> Column:
    return F.lpad(F.lower(F.hex(mark)), 16, "0")


def _block_sizes(rows: int) -> tuple[int, int]:
    """Bits of a block and number of blocks for so many fingerprints."""
    bits = max(_LEAST_BITS, math.ceil(math.log2(max(rows, 1) / _ROWS)))
    return bits, math.ceil(math.log(_LOST) / math.log1p(-((1 - _DIFFERING) ** bits)))


def wide_fingerprint(shingles: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of a set of shingles with a byte as each shingle's vote for a bit; ``bits`` is a multiple of 64."""
    plus, times = _PLUS[: bits // 8], _TIMES[: bits // 8]
    total = np.full(bits, len(shingles), np.int64)
    for k in range(0, len(shingles), 64):
        votes = shingles[k : k + 64, None] ^ plus
        votes *= times
        votes ^= votes >> np.uint64(32)
        total += 2 * votes.view(np.int8).sum(axis=0, dtype=np.int32)
    return np.packbits(total > 0, bitorder="little").view("<u8")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _set_rows(width: int, bits: int | None):
    """Reads rows whose last column is a text; gives its set's hash and, in its place, the set's wide fingerprint or the set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys, found = batch.columns[:-1], [], []
            for text in texts(batch, len(own)):
                shingles = np.unique(_shingles(text, width))
                data = shingles.tobytes()
                keys.append(_signed(xxhash.xxh64_intdigest(data)))
                found.append(data if bits is None or not data else wide_fingerprint(shingles, bits).tobytes())
            added = [pa.array(keys, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *added], [*batch.schema.names[:-1], "shingle_set", "shingles" if bits is None else "mark"])

    return run


def _in_buckets(block: int, blocks: int, bits: int):
    """Reads shingle_set, mark; gives bucket, shingle_set and the longs to compare, a row for each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.int64(1) << np.arange(block, dtype=np.int64)
        number = np.arange(blocks, dtype=np.int64) << block
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                marks = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(part), bits // 8)
                single = np.unpackbits(marks, axis=1, bitorder="little")[:, : block * blocks]
                buckets = single.reshape(len(part), blocks, block) @ places + number
                longs = np.ascontiguousarray(marks[:, : 8 * _LONGS]).view("<i8")
                columns = [buckets.ravel(), *(np.repeat(v, blocks) for v in (part.column(0).to_numpy(), *longs.T))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "shingle_set", *(f"m{i}" for i in range(_LONGS))])

    return run


def _wide_search(marks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as pairs of places, that join the fingerprints of a bucket as all close pairs would; a column of ``marks`` is one."""
    n = marks.shape[1]
    if n <= _ROWS:
        left, right = np.nonzero(np.triu(np.bitwise_count(marks[:, :, None] ^ marks[:, None, :]).sum(axis=0, dtype=np.uint8) <= distance, 1))
        if len(left) <= 4 * n:
            return left, right
    left, right, rest = [], [], np.arange(n)
    while len(rest):
        reached, rest, open_marks = [rest[0]], rest[1:], marks[:, rest[1:]]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(open_marks ^ marks[:, at, None]).sum(axis=0, dtype=np.uint8) <= distance
            if near.any():
                found, rest, open_marks = rest[near], rest[~near], open_marks[:, ~near]
                left.append(np.full(len(found), at))
                right.append(found)
                reached.extend(found)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _wide_matcher(distance: int):
    """Reads rows sorted by bucket; gives links a, b of sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # pieces of the bucket that the last batch ended in

        def links_of(table: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            buckets, keys, marks = table[0], table[1], np.stack(table[2:]).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            found = [
                (i + a, j + a) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)]) if b - a > 1
                for i, j in (_wide_search(marks[:, a:b], distance),) if len(i)
            ]
            if found:
                left, right = (keys[np.concatenate([f[k] for f in found])] for k in (0, 1))
                pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if not len(batch):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if held and (last or columns[0][0] != held[0][0][0]):
                stop = last or 0
                yield from links_of([np.concatenate([*(h[k] for h in held), c[:stop]]) for k, c in enumerate(columns)])
                held = []
            elif last:
                yield from links_of([c[:last] for c in columns])
            held.append([c[last:].copy() for c in columns])
        if held:
            yield from links_of([np.concatenate([h[k] for h in held]) for k in range(len(held[0]))])

    return run


def wide_links(sets: DataFrame, block: int, blocks: int, bits: int, distance: int = _WIDE_DISTANCE) -> DataFrame:
    """a, b: links of shingle_sets that join all whose marks share a block and differ in at most ``distance`` of 192 bits."""
    schema = "bucket long, shingle_set long, " + ", ".join(f"m{i} long" for i in range(_LONGS))
    rows = sets.filter(F.length("mark") > 0).select("shingle_set", "mark").mapInArrow(_in_buckets(block, blocks, bits), schema)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_wide_matcher(distance), "a long, b long").distinct()


def _alike(sets: list[np.ndarray], sizes: np.ndarray, at: int, rest: np.ndarray, least: float) -> np.ndarray:
    """Which sets of ``rest`` have a Jaccard index of at least ``least`` with the set ``at``."""
    own, near = sets[at], np.zeros(len(rest), bool)
    possible = np.flatnonzero(np.minimum(sizes[rest], len(own)) / np.maximum(sizes[rest], len(own)) >= least)
    for k in range(0, len(possible), 1024):
        part = possible[k : k + 1024]
        n = sizes[rest[part]]
        values = np.concatenate([sets[i] for i in rest[part]])
        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        common = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
        near[part] = common / (n + len(own) - common) >= least
    return near


def _set_links(keys: list[int], sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Links that join the sets of a bucket as all alike pairs would."""
    sizes, rest = np.array([len(s) for s in sets]), np.arange(len(sets))
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = _alike(sets, sizes, at, rest, least)
            found, rest = rest[near], rest[~near]
            yield from ((keys[at], keys[i]) for i in found)
            reached.extend(found)


def _set_matcher(least: float, held_bytes: int):
    """Reads rows sorted by bucket; gives links. What a bucket holds beyond ``held_bytes`` lies in a temporary file."""

    def buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        at, keys, parts, sizes, held, file = None, [], [], [], 0, None

        def of_bucket() -> tuple[list[int], list[np.ndarray]]:
            if file is None:
                return keys, [np.frombuffer(p, np.uint64) for p in parts]
            for p in parts:
                file.write(p)
            file.flush()
            data, stops = np.memmap(file, np.uint64, "r"), np.cumsum(sizes) // 8
            return keys, [data[b - n // 8 : b] for n, b in zip(sizes, stops.tolist())]

        for batch in batches:
            for bucket, key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != at:
                    if len(keys) > 1:
                        yield of_bucket()
                    at, keys, parts, sizes, held, file = bucket, [], [], [], 0, None
                part = data.as_py()
                keys.append(key)
                parts.append(part)
                sizes.append(len(part))
                held += len(part)
                if held > held_bytes:
                    file = file or tempfile.TemporaryFile()
                    for p in parts:
                        file.write(p)
                    parts, held = [], 0
        if len(keys) > 1:
            yield of_bucket()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in buckets(batches):
            found = list(_set_links(keys, sets, least))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, least: float = 0.8,
    held_bytes: int = 1 << 26, distance: int = _WIDE_DISTANCE,
) -> DataFrame:
    """One row of each component stays: that of the smallest id, of its texts the first by hash.

    Texts whose sets of ``width``-word shingles have a Jaccard index of at least
    ``least`` are linked. Sets are compared in full where links of their wide
    fingerprints, at most ``distance`` bits apart, join them; blocks and distance are
    laid out for 0.8, and a lower ``least`` would miss more. Texts without words are
    alike. Rows without an id take part; one stays only where its component has no
    id. Of rows with equal id and text any one stays. ``held_bytes`` only decides
    where a component's sets lie. Columns are those of ``docs``.
    """
    keys = row_keys(id_column, text_column)
    block, blocks = _block_sizes(docs.count())
    bits = -(-block * blocks // 64) * 64
    rows = docs.select(*(c.alias(k) for k, c in keys.items()), F.col(text_column))
    rows = rows.mapInArrow(_set_rows(width, bits), "_id long, _no_id boolean, _text long, shingle_set long, mark binary")
    first = F.min(F.struct("_no_id", "_id", "_text", "mark")).alias("first")
    sets = stored(rows.groupBy("shingle_set").agg(first).select("shingle_set", "first.*"), "shingle-sets")
    near = stored(wide_links(sets, block, blocks, bits, distance), "wide-links")
    roots = components(near).select(F.col("root").alias("bucket"), F.col("node").alias("shingle_set"))
    own = roots.select("bucket", F.col("bucket").alias("shingle_set"))  # the smallest node of a component has no row there
    members = stored(roots.unionByName(own).distinct(), "shingle-buckets")
    wanted = sets.join(members.select("shingle_set"), "shingle_set", "left_semi").select(*keys)
    whole = docs.select(*(c.alias(k) for k, c in keys.items()), F.col(text_column).alias("_value")).join(wanted, list(keys), "left_semi")
    whole = whole.select("_value").mapInArrow(_set_rows(width, None), "shingle_set long, shingles binary").dropDuplicates(["shingle_set"])
    placed = members.join(whole, "shingle_set").select("bucket", "shingle_set", "shingles")
    placed = placed.repartition("bucket").sortWithinPartitions("bucket")
    edges = stored(placed.mapInArrow(_set_matcher(least, held_bytes), "a long, b long"), "shingle-links")
    roots = components(edges).select(F.col("node").alias("shingle_set"), "root")
    root = F.coalesce("root", "shingle_set").alias("root")
    first = F.min(F.struct("_no_id", "_id", "_text")).alias("first")
    kept = sets.join(roots, "shingle_set", "left").groupBy(root).agg(first).select("first.*")
    staying = docs.withColumns(keys).join(kept.hint("shuffle_hash"), list(keys), "left_semi")
    return staying.dropDuplicates(list(keys)).select(*docs.columns)
