"""Fill-in-middle rows against plain strings, and seeking in frames."""

import hashlib
import random
import re

import duckdb
import pytest
from oddities import TEXTS, documents, nothing
from pyspark.sql import functions as F

from tablewright.llm import middle
from tablewright.llm.queries import ORACLES, op12_fill_in_middle
from tablewright.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = ["a", "é", "日本", "\U0001f600", " ", "\n", "\t ", "word ", "<", ">", "P", "S>", "<M", "\x85", "\xa0", "\x1f"]


def drawn(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def plain(doc, text):
    """The row, and the output, of one text."""
    text = text or ""
    digits = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, inner, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, output = "plain", text
    elif h[3] % 100 < 80:
        form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{inner}"
    else:
        form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{inner}"
    chars = (None, None) if form == "plain" else (len(prefix), len(inner))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (output, text)]
    return (doc, len(units), form, *chars, *sha), output


def test_frames_seek():
    for text in [*drawn(300, 1), "x" * 5000, " " * 700, "ab " * 900, "日" * 333, ""]:
        data, units = text.encode(), UNIT.findall(text)
        for size in (4, 7, 64, 1 << 16):
            chunks = [data[i : i + 5] for i in range(0, len(data), 5)]
            made = middle.framed(chunks, size)
            assert made == middle.framed([data], size)
            frames = middle.Frames(*made)
            assert (frames.units, frames.chars, frames.size) == (len(units), len(text), len(data))
            assert b"".join(frames.stream()) == data
            for k in {0, 1, len(units) // 2, len(units) - 1, len(units)} - {-1}:
                head, before = "".join(units[:k]), frames.opened
                assert frames.cut(k) == (len(head.encode()), len(head))
                assert frames.opened - before <= 1
            start, stop = len(data) // 3, 2 * len(data) // 3
            before = frames.opened
            assert b"".join(frames.stream(start, stop)) == data[start:stop]
            assert frames.opened - before <= (stop - start) // max(1, min(size, 4) - 3) + 2
            for mark in (b"<S>", b"<M>", "日本".encode()):
                assert frames.find(mark) == data.find(mark) and frames.find(mark, start) == data.find(mark, start)


@pytest.mark.parametrize("size", [5, 1 << 16])
def test_rows_outputs_and_the_way_back(spark, size):
    rows = [*TEXTS, *((100 + i, t) for i, t in enumerate(drawn(300, 2))), (7, "<P> kept plain"), (8, "a<S>"), (9, "b <M> c")]
    expected = [plain(i, t) for i, t in rows]
    done = middle.transform(middle.store(documents(spark, rows), frame_bytes=size), frame_bytes=size)
    assert sorted(map(tuple, middle.digests(done).collect()), key=str) == sorted((r for r, _ in expected), key=str)
    assert sorted(map(tuple, middle.texts_of(done).collect()), key=str) == sorted(((r[0], o) for r, o in expected), key=str)
    assert sorted(map(tuple, middle.restore(done).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r[2] for r, _ in expected} == {"plain", "spm", "psm"}
    assert middle.digests(middle.transform(middle.store(nothing(spark)))).count() == 0


def test_query_is_its_sql(spark):
    rows = table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    expected = sorted((plain(*r)[0] for r in rows), key=str)
    assert sorted(map(tuple, op12_fill_in_middle(spark, FOLDER).collect()), key=str) == expected
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
        assert sorted(con.execute(ORACLES["op12_fill_in_middle"]).fetchall(), key=str) == expected


def test_store_keeps_rows_and_order_of_numbers(spark):
    frames = middle.store(documents(spark), frame_bytes=1024).select(F.explode("frames").alias("f"), "bytes")
    assert frames.filter("f.start >= bytes OR octet_length(f.data) = 0").count() == 0
