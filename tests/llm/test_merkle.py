"""The manifest against a tree built node by node, and against SQL."""

import hashlib
import zlib

import duckdb
import pytest
from oddities import TEXTS, documents, nothing
from pyspark.sql import functions as F

from tablewright.llm import merkle
from tablewright.llm.queries import ORACLES, op13_merkle
from tablewright.llm.shared import table

FOLDER = "/root/testdata/sf0.001"
LANGS = ["en", None, "", "é", "en", "z", "en", "en", None, "\U0001f600"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS))


def tree(nodes, arity):
    """The root, and for each node the (left, right) flanks up to it."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = at[k] - at[k] % arity
            path.append(("".join(nodes[run : at[k]]), "".join(nodes[at[k] + 1 : run + arity])))
            at[k] //= arity
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain(rows, arity=2):
    by_lang, result = {}, []
    for row in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        by_lang.setdefault(row["lang"], []).append(row)
    names = sorted(by_lang, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: tree([leaf(r) for r in by_lang[n]], arity) for n in names}
    root, tops = tree([trees[n][0] for n in names], arity) if names else ("", [])
    for name, top in zip(names, tops):
        for row, path in zip(by_lang[name], trees[name][1]):
            bent = dict(row)
            if row["n_chars"] is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
                bent["n_chars"] += 1
            node = leaf(bent)
            for left, right in path + top:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path + top))
            result.append((row["doc_id"], leaf(row), trees[name][0], root, proof, node, node == root))
    return sorted(result, key=str)


def found(docs, **layout):
    bent = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.col("n_chars").cast("decimal(38,0)") + F.when(bent, 1).otherwise(0)
    rows = merkle.verified(merkle.manifest(docs, claimed={"n_chars": n_chars}, **layout))
    return sorted(map(tuple, rows.collect()), key=str)


def odd(spark):
    """Odd rows with langs, and a name of an internal column; number 7 is bent, once with a null."""
    rows = [(i, text, lang, None if k % 3 else k) for k, ((i, text), lang) in enumerate(zip(TEXTS, LANGS))]
    rows += [(7, "x", "en", 1 << 62), (18, "x", "en", None), *[(n, "many", "fr", n) for n in range(40)], (5, "many", "fr", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    return frame.selectExpr("*", "if(doc_id = 4, null, 'web') AS source", "1 AS index", "2 AS digest", "3 AS size", "4 AS group").repartition(3)


@pytest.mark.parametrize("layout", [{}, {"height": 2}, {"arity": 3, "height": 2}])
def test_odd_rows(spark, layout):
    docs = odd(spark)
    expected = plain([r.asDict() for r in docs.collect()], layout.get("arity", 2))
    assert found(docs, **layout) == expected
    assert 0 < sum(r[-1] for r in expected) < len(expected)


def test_small_tables(spark):
    columns = [F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    assert found(nothing(spark).select("*", *columns, F.lit(1).alias("n_chars"))) == []
    one = documents(spark, [(1, "a")]).select("doc_id", "text", *columns, F.lit(1).alias("n_chars"))
    [row] = found(one)
    assert row[1] == row[2] == row[3] and row[4] == sha("")  # a lone leaf is the root, and has no siblings


def test_query_is_its_sql(spark):
    rows = [r.asDict() for r in table(spark, FOLDER, "documents").collect()]
    expected = plain(rows)
    assert sorted(map(tuple, op13_merkle(spark, FOLDER).collect()), key=str) == expected
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
        assert sorted(con.execute(ORACLES["op13_merkle"]).fetchall(), key=str) == expected
