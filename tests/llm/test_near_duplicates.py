"""SimHash against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from oddities import TEXTS, documents, nothing
from pyspark.sql import functions as F

from tablewright.llm import simhash
from tablewright.llm.queries import op2_simhash
from tablewright.llm.shared import table

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows: list[tuple[int | None, int]]) -> list[int | None]:
    """Smallest id reachable, for each (id, fingerprint), comparing all pairs."""
    marks = np.array([m for _, m in rows], np.uint64)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(marks[i + 1 :] ^ marks[i]) <= 4) + i + 1:
            parent[root(j)] = root(i)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return [smallest.get(root(i)) for i in range(len(rows))]


def plain_sets(texts: list[str | None], width: int = 5) -> list[frozenset[str]]:
    """The word shingles of each text; a shorter text is one shingle."""
    found = []
    for text in texts:
        words = (text or "").encode().lower().split()
        shingles = (b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))
        found.append(frozenset(shingles) if words else frozenset())
    return found


def plain_alike(texts: list[str | None], least: float = 0.8) -> list[tuple[int, int]]:
    """All pairs of places whose shingle sets have a Jaccard index of at least ``least``, counted over every shared shingle."""
    sets = plain_sets(texts)
    holders, common = {}, Counter()
    for i, shingles in enumerate(sets):
        for shingle in shingles:
            for j in holders.setdefault(shingle, []):
                common[j, i] += 1
            holders[shingle].append(i)
    empty = [i for i, shingles in enumerate(sets) if not shingles]
    pairs = [(i, j) for (i, j), n in common.items() if n >= least * (len(sets[i]) + len(sets[j]) - n)]
    return pairs + list(zip(empty, empty[1:]))


def plain_survivors(rows: list[tuple[int, str | None]]) -> set[int]:
    """The smallest id of each component of alike texts; ids differ."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in plain_alike([t for _, t in rows]):
        parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return set(smallest.values())


def expected_rows(texts):
    marks = [(i, plain_fingerprint(t or "")) for i, t in texts]
    return sorted(((i, f"{m:016x}", c) for (i, m), c in zip(marks, plain_components(marks))), key=str)


def test_query(spark):
    texts = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op2_simhash(spark, FOLDER).collect()), key=str) == expected_rows(texts)


def test_odd_rows(spark):
    found = simhash.near_duplicates(documents(spark)).select("doc_id", simhash.hex_digits(F.col("fingerprint")), "component_id")
    assert sorted(map(tuple, found.collect()), key=str) == expected_rows(TEXTS)
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    assert simhash.drop_near_duplicates(nothing(spark)).count() == 0


def crowd(seed: int) -> list[int]:
    """Fingerprints around two centres, a chain, and noise."""
    draw = random.Random(seed)
    marks = {0, (1 << 64) - 1}
    for centre in (draw.getrandbits(64), draw.getrandbits(64)):
        for _ in range(300):
            marks.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))))
    step = draw.getrandbits(64)
    for k in range(12):
        step ^= sum(1 << b for b in range(5 * k, 5 * k + 4))
        marks.add(step)
    return sorted(marks | {draw.getrandbits(64) for _ in range(400)})


def test_links_join_what_all_pairs_join_with_and_without_crowded_buckets(spark):
    marks = crowd(5)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    expected = plain_components([(i, m) for i, m in enumerate(marks)])
    groups = {}
    for m, c in zip(signed, expected):
        groups.setdefault(c, set()).add(m)
    for limit in (65_536, 20):
        edges = simhash.links(spark.createDataFrame([(m,) for m in signed], "fingerprint long").repartition(3), bucket_rows=limit)
        roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        found = {}
        for m in signed:
            found.setdefault(roots.get(m, m), set()).add(m)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_links_are_fewer_than_pairs(spark):
    draw = random.Random(1)
    near = {sum(1 << b for b in draw.sample(range(64), 2)) for _ in range(500)}
    values = np.array(sorted(near), np.uint64)
    left, _ = simhash._search(values, 4)
    assert len(left) == len(values) - 1


def test_one_of_each_group_stays(spark):
    kept = simhash.drop_near_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in kept.collect())
    assert ids == sorted([("1", "The q"), ("2", ""), ("4", "lorem"), ("6", "Mail "), ("1", "Anoth"), ("5", "  \n\t ")])


def copies_with(shared: float, n: int, base: int) -> tuple[str, str]:
    """Two texts of n five-word shingles each; as many of their last words differ as leave that Jaccard index or a little more."""
    changed = int(n * (1 - shared) / (1 + shared))
    words = [f"w{base}x{i}" for i in range(n + 4)]
    return " ".join(words), " ".join(words[: n + 4 - changed] + [f"other{base}x{i}" for i in range(changed)])


def test_copies_that_share_four_fifths_of_their_shingles_go(spark):
    shares = (0.8, 0.82, 0.85, 0.9, 0.95)
    pairs = [copies_with(s, n, 1000 * b + n) for b, s in enumerate(shares * 8) for n in (60, 500)]
    below = [copies_with(0.78, 500, 90_000 + b) for b in range(8)]
    rows = [(i, t) for i, pair in enumerate([*pairs, *below]) for t in pair]
    rows = [(2 * i + k, t) for k in (0, 1) for i, t in rows[k::2]]
    for limit in (1 << 26, 1000):
        kept = simhash.drop_near_duplicates(documents(spark, rows), held_bytes=limit)
        firsts, seconds = {2 * i for i in range(len(pairs) + 8)}, {2 * i + 1 for i in range(len(pairs), len(pairs) + 8)}
        assert {r["doc_id"] for r in kept.collect()} == firsts | seconds


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_stage_links_all_alike_texts(spark, folder):
    """No alike pair is lost: the rows that stay are those of a search over all pairs."""
    docs = table(spark, folder, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()]
    assert sorted(kept) == sorted(plain_survivors(rows))
    assert len(kept) < len(rows)


def test_stage_links_come_of_fingerprints(spark):
    rows = [(2 * i + k, t) for i in range(6) for k, t in enumerate(copies_with(0.9, 60, i))]
    kept = {d: simhash.drop_near_duplicates(documents(spark, rows), distance=d).count() for d in (-1, simhash._WIDE_DISTANCE)}
    assert kept == {-1: 12, simhash._WIDE_DISTANCE: 6}


@pytest.mark.parametrize("common, more, other", [(4, 1, 0), (5, 1, 0), (8, 1, 1), (8, 2, 0), (90, 11, 11), (80, 20, 0)])
def test_fingerprints_of_alike_sets_share_a_block_and_are_near(common, more, other):
    draw = np.random.default_rng(common)
    for rows in (1000, 10_000_000):
        block, blocks = simhash._block_sizes(rows)
        bits = -(-block * blocks // 64) * 64
        for _ in range(400):
            drawn = draw.integers(0, 1 << 64, common + more + other, np.uint64)
            apart = simhash.wide_fingerprint(drawn[: common + more], bits) ^ simhash.wide_fingerprint(np.r_[drawn[:common], drawn[common + more :]], bits)
            open_bits = np.unpackbits(apart.view(np.uint8), bitorder="little")[: block * blocks].reshape(blocks, block)
            assert not open_bits.any(axis=1).all() and open_bits.ravel()[: 64 * simhash._LONGS].sum() <= simhash._WIDE_DISTANCE


def test_wide_links_join_what_all_pairs_join():
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 1 << 64, (40, 3), np.uint64)
    for n in (1, 2, 60, 500, 900):
        marks = centres[draw.integers(0, max(1, n // 25), n)]
        for _ in range(25):
            marks = marks ^ (np.uint64(1) << draw.integers(0, 64, (n, 3), np.uint64)) * (draw.random((n, 3)) < 0.4)
        near = np.bitwise_count(marks[:, None] ^ marks[None]).sum(axis=2) <= 20
        i, j = simhash._wide_search(np.ascontiguousarray(marks.T), 20)
        assert near[i, j].all() and len(i) <= 4 * n
        names = []
        for links in (zip(i.tolist(), j.tolist()), zip(*map(np.ndarray.tolist, np.nonzero(near)))):
            name, before, links = np.arange(n), None, list(links)
            while before is None or (before != name).any():
                before = name.copy()
                for a, b in links:
                    name[a] = name[b] = min(name[a], name[b])
            names.append(name.tolist())
        assert names[0] == names[1]
