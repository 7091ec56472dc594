"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeats, clashing names."""

from pyspark.sql import DataFrame, SparkSession

LONG = "lorem ipsum dolor sit amet " * 4000 + "x" * 30_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today."),
    (2, None),
    (3, ""),
    (None, "The quick brown fox jumps over the lazy dog again and again today."),
    (4, LONG),
    (5, "  \n\t   "),
    (1, "The quick brown fox jumps over the lazy dog again and again today."),
    (6, "Mail jo@ex.org or +1 (415) 555-2671, 10.0.0.1; token = \"abcdefgh1234\" İΣ <|endoftext|>"),
    (1, "Another text under the same number, with other words than the one before it."),
    (None, None),
]
#: Names that operators use for columns of their own.
CLASHING = "id string, fingerprint string, kept int, spans string, rank int, votes int, bucket int, row int, shard int, page int"


def documents(spark: SparkSession, rows=None) -> DataFrame:
    docs = spark.createDataFrame(TEXTS if rows is None else rows, "doc_id long, text string")
    names = [part.split() for part in CLASHING.split(", ")]
    return docs.selectExpr("*", *(f"cast(1 as {kind}) as {name}" for name, kind in names)).repartition(3)


def nothing(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
