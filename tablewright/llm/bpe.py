"""BPE encoding and decoding with a segment tree over adjacent pairs.

The leaf at position i holds the rank of the pair (symbol i, next symbol), with
i below it, so that the root is the leftmost pair of the lowest rank. A merge
changes three leaves and the path above each. Words of like length are merged
together, one merge of each a step, as rows of one array of trees; long words,
where a step for one word would cost as much as for many, use the same tree in
plain Python. Both take a number of steps that grows as n log n.

A worker remembers the words of its texts up to a fixed number.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import kept, texts
from tablewright.llm.vocabulary import byte_letters

_NEVER = 1 << 62
_LONGEST_ROW, _ROWS, _MOST_CHUNKS, _CHARS, _MARKS = 256, 20_000, 300_000, 1 << 20, ".,;:!?"


class WordBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file whose words drop white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self._library = Tokenizer.from_file(path)
        model, vocab = content["model"], content["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = {byte: letter for letter, byte in byte_letters().items()}
        self._inner = [vocab[letters[b]] for b in range(256)]
        self._final = [vocab[letters[b] + end] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[side]] for p in pairs], np.int64) for side in (0, 1))
        self._merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left << 32 | right, kind="stable")
        self._pairs, self._ranks = (left << 32 | right)[order], order
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in content["added_tokens"]}
        self._added = {t["content"]: t["id"] for t in content["added_tokens"]}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self._added, key=len, reverse=True))) + ")")
        split = next(p for p in content["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._word = regex.compile(split["pattern"]["Regex"])
        #: Of words, and of chunks made of them: number of ids, ids and tokens joined by blanks.
        self._words: dict[str, tuple[int, str, str]] = {}
        self._chunks: dict[str, tuple[int, str, str] | None] = {}

    # -- merging ---------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where((self._pairs[at] == pair) & (left >= 0) & (right >= 0), self._ranks[at], -1)

    @cached_property
    def _pair_ranks(self) -> dict[int, int]:
        return dict(zip(self._pairs.tolist(), self._ranks.tolist()))

    def _merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merge every row (ids, then -1 at least once) to its end; merged symbols leave -1 behind."""
        rows, size = symbols.shape
        bits = size.bit_length() - 1
        place, row = np.arange(size), np.arange(rows)
        after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
        after[:, -1] = before[:, 0] = size - 1  # the last place is always empty
        rank = self._rank(symbols, np.roll(symbols, -1, axis=1))
        tree = np.full((rows, 2 * size), _NEVER)
        tree[:, size:] = np.where(rank >= 0, rank << bits | place, _NEVER)
        for level in range(bits - 1, -1, -1):
            below = tree[:, 2 << level : 4 << level]
            tree[:, 1 << level : 2 << level] = np.minimum(below[:, ::2], below[:, 1::2])
        row = row[tree[:, 1] < _NEVER]
        while len(row):
            root = tree[row, 1]
            i = root & size - 1
            gone, last = after[row, i], before[row, i]
            follow = after[row, gone]
            new = self._merged[root >> bits]
            symbols[row, i], symbols[row, gone] = new, -1
            after[row, i], before[row, follow] = follow, i
            ahead, behind = self._rank(new, symbols[row, follow]), self._rank(symbols[row, last], new)
            tree[row, size + gone] = _NEVER
            tree[row, size + i] = np.where(ahead >= 0, ahead << bits | i, _NEVER)
            tree[row, size + last] = np.where(behind >= 0, behind << bits | last, _NEVER)
            for leaf in (gone, i, last):
                node = size + leaf >> 1
                for _ in range(bits):
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                    node >>= 1
            row = row[tree[row, 1] < _NEVER]
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one word of any length."""
        n, ranks, merged = len(symbols), self._pair_ranks, self._merged.tolist()
        bits = n.bit_length()
        size = 1 << bits
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int, j: int) -> int:
            rank = ranks.get(symbols[i] << 32 | symbols[j], -1) if i >= 0 and j < n else -1
            return rank << bits | i if rank >= 0 else _NEVER

        tree = [_NEVER] * (2 * size)
        tree[size : size + n] = [leaf(i, i + 1) for i in range(n)]
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < _NEVER:
            i = tree[1] & size - 1
            symbols[i] = merged[tree[1] >> bits]
            gone = after[i]
            symbols[gone], after[i] = -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, _NEVER)
            put(i, leaf(i, after[i]))
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        return [s for s in symbols if s >= 0]

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of words of at least one byte each."""
        result: list[tuple[int, ...]] = [()] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) >= _LONGEST_ROW:
                inner = [*map(self._inner.__getitem__, word[:-1]), self._final[word[-1]]]
                result[i] = tuple(self._merge_long(inner))
            else:
                by_size.setdefault(max(4, 1 << len(word).bit_length()), []).append(i)
        inner, final = np.array(self._inner), np.array(self._final)
        for size, members in by_size.items():
            step = max(1, _ROWS * 8 // size)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                lengths = np.array([len(words[i]) for i in part])
                filled = np.arange(size) < lengths[:, None]
                symbols = np.full((len(part), size), -1, np.int64)
                symbols[filled] = inner[np.frombuffer(b"".join([words[i] for i in part]), np.uint8)]
                ends = np.array([words[i][-1] for i in part])
                symbols[np.arange(len(part)), lengths - 1] = final[ends]
                merged = self._merge_rows(symbols)
                present = merged >= 0
                cuts = np.cumsum(present.sum(axis=1))[:-1]
                flat = merged[present].tolist()
                for i, a, b in zip(part, [0, *cuts.tolist()], [*cuts.tolist(), len(flat)]):
                    result[i] = tuple(flat[a:b])
        return result

    # -- texts -----------------------------------------------------------------

    def _cut_words(self, chunk: str) -> list[str]:
        """Normalised words of a chunk. Letters newer than Python's tables are left to the library."""
        if not chunk.isascii():
            if max(chunk) >= "ɐ" and any(unicodedata.category(c) == "Cn" for c in chunk):
                normal = self._library.normalizer.normalize_str(chunk)
                letters = byte_letters()
                cut = self._library.pre_tokenizer.pre_tokenize_str(normal)
                return [bytes(map(letters.__getitem__, word)).decode() for word, _ in cut]
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in _MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self._word.findall(chunk)

    def _learn(self, chunks: set[str]) -> None:
        known, token = self._words, self.token.__getitem__
        cut = {c: self._cut_words(c) for c in chunks}
        several = list(set(chain.from_iterable(cut.values())).difference(known))
        for word, ids in zip(several, self.merge([w.encode() for w in several])):
            known[word] = (len(ids), " ".join(map(str, ids)), " ".join(map(token, ids)))
        for chunk, words in cut.items():
            if len(words) == 1:
                self._chunks[chunk] = known[words[0]]
            else:
                n, ids, tokens = zip(*map(known.__getitem__, words)) if words else ((), (), ())
                self._chunks[chunk] = (sum(n), " ".join(ids), " ".join(tokens)) if words else None

    def _prepare(self, several: list[str]) -> list[list[str]]:
        """Chunks of texts, all learnt; an added token's string is a chunk of its own.

        No word spans a blank or line feed, and normalisation joins nothing across one.
        """
        if len(self._chunks) > _MOST_CHUNKS:
            self._chunks.clear()
            self._words.clear()
        for content, i in self._added.items():
            self._chunks[content] = (1, str(i), content)
        cut, new = [], set()
        for text in several:
            parts = self._cut.split(text) if any(a in text for a in self._added) else [text]
            chunks = [c for p in parts for c in ([p] if p in self._added else p.replace("\n", " ").split(" ")) if c]
            cut.append(chunks)
            new.update(set(chunks).difference(self._chunks))
        self._learn(new)
        return cut

    def written(self, several: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, the ids joined by blanks, and the text they decode to."""
        get = self._chunks.__getitem__
        for chunks in self._prepare(several):
            found = list(map(get, chunks))
            if None in found:
                found = [w for w in found if w]
            n, ids, tokens = zip(*found) if found else ((), (), ())
            yield sum(n), " ".join(ids), " ".join(tokens)

    def encode(self, several: list[str]) -> list[list[int]]:
        return [[int(i) for i in ids.split()] for _, ids, _ in self.written(several)]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by blanks, as the library does for a file without a decoder."""
        return " ".join(map(self.token.__getitem__, ids))


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[list[str]]:
    """Texts in groups of about a million characters."""
    group, size = [], 0
    for text in texts(batch, column):
        group.append(text)
        size += len(text)
        if size > _CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; a null text gives no ids.

    Null and repeated ids are kept, an empty table gives no rows, and other
    columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(("word", tokenizer_file), lambda: WordBpe(tokenizer_file))
        for batch in batches:
            ids = [i for group in _groups(batch, 1) for i in bpe.encode(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(("word", tokenizer_file), lambda: WordBpe(tokenizer_file))
        for batch in batches:
            found = (ids.as_py() for ids in batch.column(1))
            decoded = [None if ids is None else bpe.decode(ids) for ids in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded and decoded in one pass, as both functions do."""

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(("word", tokenizer_file), lambda: WordBpe(tokenizer_file))
        for batch in batches:
            rows = [(n, digest(ids), digest(text)) for g in _groups(batch, 1) for n, ids, text in bpe.written(g)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
