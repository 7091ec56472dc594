"""Quality by weak supervision.

Rules look at one document each and vote keep, vote reject or abstain. What they
are worth is not set by hand: expectation-maximisation estimates how often each
rule casts each vote on good and on bad documents, and every document gets the
posterior probability of being good. Rules see the whole text and all documents
count; only the table of vote patterns, at most 2^11 rows, reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablewright.llm.shared import row_keys, stored, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_BLANKS = " \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))

#: Fixed values: (rule, its vote, from, below). A rule votes where its value lies in the range and else abstains.
KEEP, REJECT = 1, -1
RULES = (
    ("symbols_per_word", REJECT, 0.20, float("inf")),
    ("upper_share", REJECT, 0.40, float("inf")),
    ("shouts_per_word", REJECT, 0.20, float("inf")),
    ("repeat_share", REJECT, 0.20, float("inf")),
    ("top_word_share", REJECT, 0.22, float("inf")),
    ("dup_line_share", REJECT, 0.30, float("inf")),
    ("words_per_stop", REJECT, 100.0, float("inf")),
    ("word_length", REJECT, 14.0, float("inf")),
    ("stutter_share", REJECT, 0.20, float("inf")),
    ("plain_word_share", KEEP, 0.60, float("inf")),
    ("short_word_share", KEEP, 0.12, float("inf")),
)
_VALUES = list(dict.fromkeys(name for name, _, _, _ in RULES))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A rule's accuracy before any data, what part of the data this weighs, and the change at which EM rests.
_ACCURACY, _PRIOR_WEIGHT, _REST = {REJECT: 0.95, KEEP: 0.70}, 0.02, 1e-9


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more. ``window`` must be a power of two."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ranks = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    width = 1
    while width < window:  # equal ranks stand for equal runs of width words
        ranks = np.unique(ranks[:-width] * (len(words) + 1) + ranks[width:], return_inverse=True)[1]
        width *= 2
    often = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    change[often] += 1
    change[often + window] -= 1
    return int((np.cumsum(change) > 0).sum())


def measure(text: str) -> tuple[list[int], list[float | None]]:
    """The five counts of a text, and the value each rule looks at (null: abstain)."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(b"".join(words).decode())
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    copies, repeats = len(lines) - len(set(lines)), repeated_words(words)
    counts = [n, chars, symbols, copies, repeats]
    if not n:
        return counts, [None] * len(_VALUES)
    upper = len(data) - len(data.translate(None, _UPPER))
    lower = len(data) - len(data.translate(None, _LOWER))
    long_enough = n >= 20
    spoken = text.split()
    plain = [w for w, before in zip(spoken, ["", *spoken]) if w.isalpha() and w != before]
    short = sum(len(w) < 4 and w.islower() for w in plain)
    values = [
        symbols / n,
        upper / (upper + lower) if 2 * (upper + lower) > chars else None,
        text.count("!") / n,
        repeats / n,
        Counter(words).most_common(1)[0][1] / n if long_enough else None,
        copies / len(lines) if len(lines) > 3 else None,
        n / max(1, sum(map(text.count, ".!?。！？"))) if long_enough else None,
        chars / n if long_enough else None,
        sum(map(eq, words, words[1:])) / n,
        len(plain) / n if long_enough else None,
        short / n if long_enough else None,
    ]
    return counts, values


def votes(values: list[float | None]) -> int:
    """The rules that vote, one bit a rule."""
    of = dict(zip(_VALUES, values))
    return sum(1 << i for i, (name, _, low, high) in enumerate(RULES) if of[name] is not None and low <= of[name] < high)


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carried: Column | None = None) -> DataFrame:
    """doc_id, the five counts and the votes of every row; ``carried`` travels along as ``carried``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*counts, votes(values)) for counts, values in map(measure, texts(batch, 2))]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", "carried", *_COUNTS, "votes"],
            )

    carried = F.lit(0).cast("long") if carried is None else carried
    chosen = docs.select(F.col(id_column).cast("long"), carried.alias("carried"), F.col(text_column))
    schema = ", ".join(f"{c} long" for c in ("doc_id", "carried", *_COUNTS, "votes"))
    return chosen.mapInArrow(run, schema)


def posteriors(patterns: dict[int, int]) -> dict[int, float]:
    """Probability of a good document for each pattern of votes, from how often each occurs.

    EM: a rule that votes is right with its own accuracy, rules are independent,
    abstaining says nothing, and without votes good and bad are equally likely. The
    prior accuracies weigh as ``_PRIOR_WEIGHT`` of the documents, which also keeps
    good and bad from changing places. Rounds go on until no accuracy changes by more
    than ``_REST``.
    """
    if not patterns:
        return {}
    sides = np.array([side for _, side, _, _ in RULES])
    cast = np.array([[p >> i & 1 for i in range(len(RULES))] for p in patterns])
    times = np.array(list(patterns.values()), float)
    prior = np.array([_ACCURACY[s] for s in sides])
    accuracy, weight = prior, _PRIOR_WEIGHT * times.sum()
    while True:
        odds = cast @ (sides * np.log(accuracy / (1 - accuracy)))
        good = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        right = np.where(sides == KEEP, good[:, None], 1 - good[:, None])
        before, accuracy = accuracy, (times @ (cast * right) + weight * prior) / (times @ cast + weight)
        if np.abs(accuracy - before).max() <= _REST:
            break
    return dict(zip(patterns, good.tolist()))


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carried: Column | None = None) -> DataFrame:
    """doc_id, carried, five counts, votes, base_failed, quality, kept for every row.

    ``quality`` is the posterior probability of a good document. ``base_failed``
    holds under 20 words or if over 30 % of the words are repeated; such rows are
    never kept, others are from a quality of 0.5. A null text is one without
    words. Repeated rows and null ids are judged like others; an empty table gives
    no rows. Other columns are not read.
    """
    found = stored(features(docs, id_column, text_column, carried), "quality")
    patterns = {r["votes"]: r["count"] for r in found.groupBy("votes").count().collect()}
    spark = docs.sparkSession
    table = spark.createDataFrame([Row(votes=k, quality=v) for k, v in posteriors(patterns).items()], "votes long, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        found.join(F.broadcast(table), "votes")  # 2^11 rows at most
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )


def drop_rejected(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept; columns stay as they are."""
    keys = row_keys(id_column, text_column)
    kept = judged(docs, id_column, text_column, keys["_text"]).filter("kept").select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.col("doc_id").isNull().alias("_no_id"),
        F.col("carried").alias("_text")).distinct()
    return docs.withColumns(keys).join(kept.hint("shuffle_hash"), list(keys), "left_semi").select(*docs.columns)
