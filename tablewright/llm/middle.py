"""Fill-in-middle rows from texts kept as seekable compressed frames.

A text is stored as zstandard frames of at most ``FRAME`` bytes that each can be
read alone. A frame knows how many units, code points and bytes lie before it, so

* a cut "after k units" is found by bisection over these numbers and by opening
  the one frame that holds it, however long the text or a single unit is;
* an output is the ranges between two cuts in another order, read frame by frame
  and framed again as it goes; digests and the way back are streams, too.

What a worker holds of one text is its compressed frames and one open frame.

A unit is white space and the word after it, or white space at the end of the
text. Units end where a word does, so they are counted from the bytes alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_LEVEL, _BATCH = 3, 1 << 24
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FRAMED = "units long, frames array<struct<units:long,chars:long,start:long,inside:boolean,data:binary>>, chars long, bytes long"
_FRAME_TYPE = pa.struct(
    [("units", pa.int64()), ("chars", pa.int64()), ("start", pa.int64()), ("inside", pa.bool_()), ("data", pa.binary())])
_FRAMED_TYPES = [pa.int64(), pa.list_(_FRAME_TYPE), pa.int64(), pa.int64()]


def _code_points(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def _ends(data: bytes, inside: bool) -> np.ndarray:
    """Where in the bytes a unit ends: at white space after a word; ``inside`` tells that a word's byte stands before."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    before = np.r_[not inside, space[:-1]]
    return np.flatnonzero(space & ~before)


def _pieces(chunks: Iterable[bytes], size: int) -> Iterator[bytes]:
    """The bytes of the chunks in pieces of at most ``size`` bytes, never cut inside a character."""
    held = b""
    for chunk in chunks:
        held = held + chunk if held else chunk
        at = 0
        while len(held) - at > size:
            stop = at + size
            while held[stop] & 0xC0 == 0x80:
                stop -= 1
            yield held[at:stop]
            at = stop
        held = held[at:]
    if held:
        yield held


def framed(chunks: Iterable[bytes], size: int = FRAME) -> tuple[int, list[dict], int, int]:
    """Units, frames, code points and bytes of a text that comes in chunks of UTF-8. A frame holds at least four bytes."""
    pack = zstandard.ZstdCompressor(level=_LEVEL).compress
    frames, ends, chars, start, inside = [], 0, 0, 0, False
    for piece in _pieces(chunks, max(4, size)):
        frames.append({"units": ends, "chars": chars, "start": start, "inside": inside, "data": pack(piece)})
        ends += len(_ends(piece, inside))
        chars += _code_points(piece)
        start += len(piece)
        inside = not _SPACE[piece[-1]]
    return ends + bool(start), frames, chars, start


class Frames:
    """A framed text to seek in."""

    def __init__(self, units: int, frames: list[dict], chars: int, size: int):
        self.units, self.chars, self.size, self._frames = units, chars, size, frames
        self._units, self._starts = [f["units"] for f in frames], [f["start"] for f in frames]
        self._open: tuple[int, bytes] = (-1, b"")
        self.opened = 0

    def _read(self, k: int) -> bytes:
        if self._open[0] != k:
            self._open = k, zstandard.ZstdDecompressor().decompress(self._frames[k]["data"])
            self.opened += 1
        return self._open[1]

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points that the first ``units`` units take; opens one frame at most."""
        if units <= 0:
            return 0, 0
        if units >= self.units:
            return self.size, self.chars
        k = bisect_left(self._units, units) - 1
        frame, data = self._frames[k], self._read(k)
        at = int(_ends(data, frame["inside"])[units - frame["units"] - 1])
        return frame["start"] + at, frame["chars"] + _code_points(data[:at])

    def stream(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """The bytes of a range, frame by frame; frames beside it stay closed."""
        stop = self.size if stop is None else stop
        k = max(0, bisect_right(self._starts, start) - 1)
        while start < stop:
            first, data = self._starts[k], self._read(k)
            yield data[start - first : stop - first]
            start, k = first + len(data), k + 1

    def find(self, mark: bytes, start: int = 0) -> int:
        """Where the mark stands first from ``start`` on, or -1, also where it lies across frames."""
        tail, at = b"", start
        for chunk in self.stream(start):
            found = (tail + chunk).find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(chunk)
            tail = (tail + chunk)[-(len(mark) - 1) :]
        return -1


def _sha256(chunks: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for chunk in chunks:
        digest.update(chunk)
    return digest.hexdigest()


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def _arranged(text: Frames, form: str, a: int, b: int) -> Iterator[bytes]:
    """The output in a form, cut at bytes a and b."""
    if form == "plain":
        yield from text.stream()
        return
    prefix, suffix = (PREFIX, 0, a), (SUFFIX, b, text.size)
    for mark, start, stop in (*((prefix, suffix) if form == "psm" else (suffix, prefix)), (MIDDLE, a, b)):
        yield mark
        yield from text.stream(start, stop)


def _restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text that an output was made of, found by its marks: a text that holds one of them itself stays plain."""
    if form == "plain":
        yield from output.stream()
        return
    second = output.find(SUFFIX if form == "psm" else PREFIX, 3)
    third = output.find(MIDDLE, second + 3)
    parts = [(3, second), (second + 3, third)]
    prefix, suffix = parts if form == "psm" else parts[::-1]
    for start, stop in (prefix, (third + 3, output.size), suffix):
        yield from output.stream(start, stop)


def _batches(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number of bytes; the last value of a row is its weight and no column."""
    held, weight = [], 0
    for row in rows:
        held.append(row[:-1])
        weight += row[-1]
        if weight > _BATCH or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _read_rows(batches: Iterable[pa.RecordBatch], extra: int) -> Iterator[tuple[list, Frames]]:
    """Of each row the first ``extra`` values, and the framed text in the four columns after them."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            values = [c[i].as_py() for c in columns]
            yield values[:extra], Frames(*values[extra:])


_COLUMNS = ["units", "frames", "chars", "bytes"]


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", frame_bytes: int = FRAME) -> DataFrame:
    """doc_id, units, frames, chars, bytes of every row, to be written as a table.

    A null text counts as empty; an empty one has no frame and no unit. Null and
    repeated ids are kept, an empty table gives no rows, and other columns are not
    read. ``frame_bytes`` is the most that a frame holds, and changes no result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    found = framed([text.as_py() or b""], frame_bytes)
                    yield doc.as_py(), *found, found[3]

        yield from _batches(rows(), [pa.int64(), *_FRAMED_TYPES], ["doc_id", *_COLUMNS])

    chosen = docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("binary"))
    return chosen.mapInArrow(run, f"doc_id long, {_FRAMED}")


def transform(stored: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, frame_bytes: int = FRAME) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output, framed as in the store, of each of its rows.

    The id's hash with ``seed`` draws both cuts and the form: of 100 texts ``rate``
    are rearranged, of 100 of these ``spm_rate`` with the suffix first. A text that
    is empty or holds one of the marks stays plain, with null counts. A null id is
    drawn as an empty one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (doc,), text in _read_rows(batches, 1):
                h1, h2, h3, h4 = _draws(doc, seed)
                low, high = sorted(h % (text.units + 1) for h in (h1, h2))
                form, a, b = "plain", (0, None), (0, None)
                if text.size and h3 % 100 < rate and all(text.find(m) < 0 for m in (PREFIX, SUFFIX, MIDDLE)):
                    form, a, b = "spm" if h4 % 100 < spm_rate else "psm", text.cut(low), text.cut(high)
                output = framed(_arranged(text, form, a[0], b[0]), frame_bytes)
                yield doc, text.units, form, a[1], None if b[1] is None else b[1] - a[1], *output, output[3]

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *_FRAMED_TYPES]
        yield from _batches(rows(), kinds, ["doc_id", "n", "form", "prefix_chars", "middle_chars", *_COLUMNS])

    return stored.select("doc_id", *_COLUMNS).mapInArrow(
        run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {_FRAMED}")


def texts_of(stored: DataFrame) -> DataFrame:
    """doc_id and text of rows of a store, or the outputs of transformed rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, b"".join(text.stream()).decode(), text.size) for (doc,), text in _read_rows(batches, 1))
        yield from _batches(rows, [pa.int64(), pa.string()], ["doc_id", "text"])

    return stored.select("doc_id", *_COLUMNS).mapInArrow(run, "doc_id long, text string")


def restore(transformed: DataFrame) -> DataFrame:
    """doc_id and text of transformed rows, rebuilt from output and form alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, b"".join(_restored(output, form)).decode(), output.size) for (doc, form), output in _read_rows(batches, 2))
        yield from _batches(rows, [pa.int64(), pa.string()], ["doc_id", "text"])

    return transformed.select("doc_id", "form", *_COLUMNS).mapInArrow(run, "doc_id long, text string")


def digests(transformed: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of transformed rows."""
    own = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for values, output in _read_rows(batches, len(own)):
                yield *values, _sha256(output.stream()), _sha256(_restored(output, values[2])), 200

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield from _batches(rows(), kinds, [*own, "output_sha256", "restored_sha256"])

    return transformed.select(*own, *_COLUMNS).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
