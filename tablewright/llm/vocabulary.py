"""Ids of a public byte-level BPE vocabulary, fast enough for whole corpora."""

from __future__ import annotations

import json
import re
from array import array

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+$")
#: White space besides blank and line feed, in any definition of it.
_OTHER_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0 ᠎" + "".join(map(chr, range(0x2000, 0x200C))) + "    ⁠　﻿"
_MOST_CHUNKS = 250_000
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """Ids as the tokenizers library gives them for a byte-level BPE file, as little-endian 32-bit bytes.

    No token spans a change from other characters to blanks or line feeds, so a
    text is cut there and each different chunk is encoded once per task, as long
    as there is room for it. Where the file numbers its tokens in the order of
    its merges, chunks of known letters go to the quicker tiktoken library, which
    gives the same ids. All else, and texts with other white space or an added
    token's string, go to the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self._added = [t["content"] for t in content["added_tokens"]]
        self._quick = self._quick_encoder(content["model"])
        self._marks = {c: self._encode(c) for c in ".,;:!?"}
        self._after_blank: dict[str, bytes] = {}
        self._alone: dict[str, bytes] = {}

    @staticmethod
    def _quick_encoder(model: dict):
        letters, vocab = byte_letters(), model["vocab"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if [vocab[m] for m in merged] != list(range(256, len(vocab))):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def _encode(self, text: str) -> bytes:
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def _known_letters(self, text: str) -> bool:
        """Whether both libraries surely agree on the kind of every character."""
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return max(text) < "ɐ"
        return True

    def _learn(self, chunks: list[str], before: str, known: dict[str, bytes], quick) -> None:
        for chunk in set(chunks).difference(known):
            if quick is None:
                known[chunk] = self._encode(before + chunk)
                continue
            word, mark = chunk[:-1], self._marks.get(chunk[-1:])
            if mark is None or not word.isalpha():
                known[chunk] = array("I", quick(before + chunk)).tobytes()
                continue
            ids = known.get(word)  # a mark after letters is a token of its own
            if ids is None:
                ids = known[word] = array("I", quick(before + word)).tobytes()
            known[chunk] = ids + mark

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        after, alone = self._after_blank, self._alone
        if len(after) + len(alone) > _MOST_CHUNKS:
            after.clear()
            alone.clear()
        if any(s in text for s in _OTHER_SPACE) or any(a in text for a in self._added):
            return self._encode(text)
        quick = self._quick if self._known_letters(text) else None
        if "  " in text or " \n" in text or "\n " in text:
            chunks = _CHUNK.findall(text)
            self._learn(chunks, "", alone, quick)
            return b"".join(map(alone.__getitem__, chunks))
        head, *chunks = text.split(" ")
        self._learn([head], "", alone, quick)
        self._learn(chunks, " ", after, quick)
        return b"".join([alone[head], *map(after.__getitem__, chunks)])
