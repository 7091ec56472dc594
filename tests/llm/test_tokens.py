"""Tokens and packing against the tokenizers library."""

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import pytest
from oddities import TEXTS, documents, nothing
from tokenizers import Tokenizer

from tablewright.llm import bpe, packing
from tablewright.llm.queries import op1_bpe, tokenizer_file
from tablewright.llm.shared import table
from tablewright.llm.vocabulary import ByteTokenizer

WORDS, BYTES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
PARTS = list(" \n  aabcdeéßΣİ 12.'st’llre\t€日　!̈ωKÅ") + [
    "<|endoftext|>", "<|startoftext|>", "the", "ing", "Σ ", "\U0001f600", "'S", "'ll", "՘", "﻿", "word.", " end,",
]


def drawn(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 16))) for _ in range(n)]


def test_word_ids_are_those_of_the_library():
    ours, library = bpe.WordBpe(WORDS), Tokenizer.from_file(WORDS)
    texts = drawn(3000, 1) + ["a" * 3000, "ab" * 700, "the" * 200 + "é" * 300]
    for text, ids in zip(texts, ours.encode(texts)):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected, text
        assert ours.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_both_trees_merge_alike():
    ours = bpe.WordBpe(WORDS)
    words = [w.encode() for w in ("international", "aaaaaaaaa", "th", "z", "étés")]
    long = [tuple(ours._merge_long([*map(ours._inner.__getitem__, w[:-1]), ours._final[w[-1]]])) for w in words]
    assert ours.merge(words) == long


def test_byte_ids_are_those_of_the_library():
    ours, library = ByteTokenizer(BYTES), Tokenizer.from_file(BYTES)
    for text in drawn(3000, 2):
        assert array("I", ours.encode(text)).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_digests_of_odd_rows(spark):
    library = Tokenizer.from_file(WORDS)

    def expected(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        return (len(ids), *sha)

    rows = bpe.digests(documents(spark), WORDS).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(((i, *expected(t)) for i, t in TEXTS), key=key)
    assert bpe.digests(nothing(spark), WORDS).count() == 0


def test_query_is_the_library(spark):
    library, folder = Tokenizer.from_file(WORDS), "/root/testdata/sf0.001"
    expected = {}
    for i, text in table(spark, folder, "documents").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        written = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        expected[i] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in written))
    assert {r[0]: tuple(r)[1:] for r in op1_bpe(spark, folder).collect()} == expected


def test_encode_then_decode(spark):
    encoded = bpe.encode(documents(spark), WORDS)
    decoded = {(r["doc_id"], r["text"]) for r in bpe.decode(encoded, WORDS).collect()}
    library = Tokenizer.from_file(WORDS)
    assert decoded == {(i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in TEXTS}


def check_packing(rows, texts, capacity):
    """Every id in one piece, sequences gapless and within capacity; gives the share of padding."""
    library = Tokenizer.from_file(BYTES)
    by_sequence, lengths = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        lengths[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    expected = defaultdict(list)
    for i, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            expected[i].append((start, len(part), zlib.crc32(array("I", part).tobytes()), len(ids)))
    assert {k: sorted(v) for k, v in lengths.items()} == {k: sorted(v) for k, v in expected.items()}
    return padding / max(1, total)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_of_odd_rows(spark, capacity):
    check_packing(packing.pack(documents(spark), BYTES, capacity).collect(), TEXTS, capacity)
    assert packing.pack(nothing(spark), BYTES, capacity).count() == 0


def test_packing_of_documents(spark):
    from tablewright.llm.queries import op4_packing
    from tablewright.llm.shared import table

    folder = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert check_packing(op4_packing(spark, folder).collect(), texts, 1024) < 0.02


def test_plan_uses_every_piece():
    draw = random.Random(3)
    counts = {length: draw.randint(1, 50) for length in draw.sample(range(1, 1024), 300)}
    windows = packing.plan(counts)
    used = defaultdict(int)
    for chosen, times in windows:
        assert sum(k * n for k, n in chosen.items()) <= 1024
        for k, n in chosen.items():
            used[k] += n * times
    assert used == counts
    assert packing.plan({}) == [] and packing.plan({600: 2, 424: 1}) == [({600: 1, 424: 1}, 1), ({600: 1}, 1)]
