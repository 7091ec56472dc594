"""Best-fit packing: ids of the library, every id in one place, and few bins."""

import random
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from oddities import TEXTS, documents, nothing
from test_tokens import WORDS, drawn
from tokenizers import Tokenizer

from tablewright.llm import best_fit
from tablewright.llm.queries import op11_best_fit
from tablewright.llm.shared import table

FOLDER = "/root/testdata/sf0.001"


def test_ids_are_those_of_the_library():
    library = Tokenizer.from_file(WORDS)
    texts = [*drawn(2000, 4), "Word, word. WORD! don't İstanbul. naïve, x" * 3, "a" * 3000]
    for cache in (1 << 27, 5000):  # a small cache forgets all the time
        ours = best_fit.WordIds(WORDS, cache)
        for k in range(0, len(texts), 50):
            for text, ids in zip(texts[k : k + 50], ours.encode(texts[k : k + 50])):
                assert np.frombuffer(ids, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, text


def fewest(counts, capacity):
    """The fewest bins, by trying all ways to place piece after piece."""
    pieces, best = sorted(Counter(counts).elements(), reverse=True), [sum(counts.values())]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= pieces[i]}:
            left = list(rooms)
            left.remove(room)
            place(i + 1, [*left, room - pieces[i]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best[0]


def bins_of(counts, capacity):
    """Number of bins of a plan that holds every piece once."""
    planned = best_fit.plan(counts, capacity)
    used = Counter()
    for kind, n in planned:
        assert n > 0 and 0 < sum(kind) <= capacity
        for length in kind:
            used[length] += n
    assert used == +Counter(counts)
    return sum(n for _, n in planned)


def test_plan_against_all_ways():
    draw, over = random.Random(5), Counter()
    for _ in range(150):
        counts = Counter(draw.randint(1, 20) for _ in range(draw.randint(1, 10)))
        over[bins_of(counts, 20) - fewest(counts, 20)] += 1
    assert set(over) <= {0, 1} and over[1] <= 3


def test_swaps_save_bins():
    draw = random.Random(1)
    for low, high, n in ((300, 1500, 20_000), (500, 900, 2000)):
        counts = Counter(draw.randint(low, high) for _ in range(n))
        assert bins_of(counts, 2048) < 0.999 * best_fit._best_fit(counts, 2048).total()
    assert bins_of({}, 8) == 0 and bins_of({8: 3}, 8) == 3
    counts = {700: 10**9, 650: 10**8, 300: 7}
    assert bins_of(counts, 2048) <= 525_000_001  # the plan's size and time follow the lengths, not the pieces


def test_steps_gain():
    """A step leaves both bins within the capacity and raises the sum of squares."""
    draw, seen = random.Random(2), Counter()
    for _ in range(100):
        under = best_fit._Underfull(30)
        kinds = {tuple(sorted(draw.randint(1, 12) for _ in range(draw.randint(1, 4)))) for _ in range(8)}
        for kind in kinds:
            if sum(kind) < 30:
                under.add(kind, draw.randint(1, 2))
        for source in list(under.bins):
            found = under.step(source)
            if found is None:
                continue
            other, given, taken = found
            gain = sum(given) - sum(taken)
            assert 0 < gain <= 30 - sum(other) and sum(other) >= sum(source)
            assert (sum(other) + gain) ** 2 + (sum(source) - gain) ** 2 > sum(other) ** 2 + sum(source) ** 2
            seen[len(given), len(taken)] += 1
    assert {(1, 0), (2, 0)} & set(seen) and {(a, b) for a, b in product((1, 2), (1, 2))} & set(seen)


def check(rows, texts, capacity):
    library = Tokenizer.from_file(WORDS)
    expected, total = Counter(), 0
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[i, piece, start, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins) - -(-total // capacity)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_odd_rows(spark, capacity):
    assert check(best_fit.pack(documents(spark), WORDS, capacity).collect(), TEXTS, capacity) <= 2
    assert best_fit.pack(nothing(spark), WORDS, capacity).count() == 0


def test_query(spark):
    texts = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    assert check(op11_best_fit(spark, FOLDER).collect(), texts, 2048) <= 1
