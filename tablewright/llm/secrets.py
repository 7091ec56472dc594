"""Secrets: an Aho-Corasick pass finds keywords, expressions run only where one is.

Every expression is anchored at a keyword hit. Tokens that carry a checksum are
reported only if it holds. Long hexadecimal runs have no keyword; they are found
by a search for a run of that length that cannot restart inside a run.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import kept, texts

#: Base kinds in the order in which they are listed, then kinds with a checksum.
BASE = ("assign", "access", "hex")
CHECKED = ("github", "npm", "xprv", "bech32")
KINDS = (*BASE, *CHECKED)

#: Keywords in lower case, and the kind each begins.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github",
    "ghs_": "github", "ghr_": "github", "npm_": "npm", "xprv": "xprv", "age-secret-key-1": "bech32",
    "nsec1": "bech32",
}
#: The public alphabets of the formats.
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

_AT = {
    "assign": re.compile(
        r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", re.ASCII | re.IGNORECASE
    ),
    "access": re.compile(r"AKIA[A-Z0-9]++"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"),
    "bech32": re.compile(r"(?:AGE-SECRET-KEY-1[A-Z0-9]{58}|nsec1[a-z0-9]{58})(?![A-Za-z0-9])"),
}
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")


def crc_holds(token: str) -> bool:
    """The last six of the characters after the prefix are the CRC-32 of those before, in base 62."""
    body = token[4:]
    value = 0
    for c in body[-6:]:
        value = value * 62 + _BASE62.index(c)
    return value == zlib.crc32(body[:-6].encode())


def base58_holds(token: str) -> bool:
    """The last four bytes are the first of the double SHA-256 of those before."""
    value = 0
    for c in token:
        value = value * 58 + _BASE58.index(c)
    data = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return len(data) == 82 and sha256(sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32_holds(token: str) -> bool:
    """The checksum over prefix and data is one."""
    token = token.lower()
    prefix, data = token[: token.rindex("1")], token[token.rindex("1") + 1 :]
    if any(c not in _BECH32 for c in data):
        return False
    check = 1
    for value in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(_BECH32.index, data)]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ value
        for i, step in enumerate(_BECH32_STEPS):
            check ^= step if top >> i & 1 else 0
    return check == 1


_HOLDS = {"github": crc_holds, "npm": crc_holds, "xprv": base58_holds, "bech32": bech32_holds}


def automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        words.add_word(word, (len(word), kind))
    words.make_automaton()
    return words


def find(text: str, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind, without overlaps within a kind."""
    found = []
    done = dict.fromkeys(KINDS, 0)
    lower = text.lower() if text.isascii() else text.encode().lower().decode()  # A-Z only: places stay
    for last, (length, kind) in words.iter(lower):
        start = last + 1 - length
        if start < done[kind]:
            continue
        match = _AT[kind].match(text, start)
        if match is None:
            continue
        done[kind] = match.end()
        if kind == "assign":
            good = match.end(1) - match.start(1) >= 8
        elif kind == "access":
            good = match.end() - start >= 16
        else:
            good = _HOLDS[kind](match[0])
        if good:
            found.append((kind, start, match.end()))
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, stop) of every row; a null text has none.

    Null and repeated ids are kept, an empty table gives no rows, and other
    columns are not read.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept("secret keywords", automaton)
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "stop"), s)) for s in find(t, words)] for t in texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], ["doc_id", "spans"])

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column))
    return chosen.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,stop:int>>")


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
