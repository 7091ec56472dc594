"""Personal data: base patterns, and identifiers that turn up in the same contexts.

The base patterns find emails, IP addresses, card and phone numbers. They are the
seeds of a bootstrap: the words around them become lexical patterns, and words, or
runs of number words, that look like identifiers but match no base pattern are candidates. Patterns and
instances form a graph that Spark scores in rounds: a pattern is as good as the
share of its instances that are believed, a candidate as good as the patterns it
occurs in say together. Candidates believed at the end are found everywhere.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored, texts

KINDS = ("email", "ip", "card", "phone")
ALONE = len(KINDS)
MASKS = {kind: f"[{kind.upper()}]" for kind in KINDS}

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NUMBER = re.compile(r"[\"'`\[{<]*(\+?\(?[0-9](?:[0-9()./-]*[0-9)])?)[\"'`\]}>,;:!?(./-]*$")
_EDGES = ".,;:!?()[]{}<>\"'`*#$%&|="


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search would find them, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then by start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return found


def _number(*parts: str | int) -> int:
    value = xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode())
    return value - (1 << 64) if value >> 63 else value


def _trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    """Without marks at the ends, but with the bracket that another one inside belongs to."""
    word = text[start:stop]
    inner = word.strip(_EDGES)
    a = start + word.index(inner)
    b = a + len(inner)
    if inner.count(")") > inner.count("(") and text[start:a].endswith("("):
        a -= 1
    elif inner.count("(") > inner.count(")") and text[b:stop].startswith(")"):
        b += 1
    return a, b


def number_runs(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of two and more neighbouring words of digits and phone or card marks with 7 to 19 digits in all.

    ``words`` are the words with a digit. Blanks join them, line ends do not; a mark
    that belongs to the sentence ends a run, a plus begins one, and so does a bracket
    that follows more than a country code. Fewer digits are no phone or card number,
    and more are several, whose words are candidates one by one.
    """
    run: list[tuple[int, int]] = []
    open_, digits = False, 0

    def closed() -> Iterator[tuple[int, int]]:
        if len(run) > 1 and 7 <= digits <= 19:
            yield _trimmed(text, run[0][0], run[-1][1])

    for a, b in words:
        m = _NUMBER.match(text, a, b)
        goes_on = open_ and m and m.start(1) == a and not text[run[-1][1] : a].strip(" \t")
        if goes_on and (text[a] == "+" or (text[a] == "(" and digits > 3)):
            goes_on = False
        if not goes_on:
            yield from closed()
            run, digits = [], 0
        if m:
            run.append((m.start(1), m.end(1)))
            digits += len(_DIGITS.findall(m[1]))
        open_ = bool(m) and m.end(1) == b
    yield from closed()


def _patterns(text: str, places: list[tuple[int, int]]) -> list[list[int]]:
    """For each place the hashes of two words before it, and of one before and one after, in lower case.

    Words are taken whole, however long. Of a word that a place is a part of, the rest
    up to the next place counts as a word.
    """
    words = [m.span() for m in _TOKEN.finditer(text)] if places else []
    begins = [a for a, _ in words]
    starts, stops = sorted(a for a, _ in places), sorted(b for _, b in places)
    known: dict[int, int] = {}

    def whole(i: int) -> int:
        if i not in known:
            known[i] = _number(text[slice(*words[i])].lower())
        return known[i]

    result = []
    for a, b in places:
        first, last = bisect_right(begins, a) - 1, bisect_right(begins, b - 1) - 1
        k = bisect_right(stops, a)
        lead = text[max(begins[first], stops[k - 1] if k else 0) : a]
        before = [_number(lead.lower())] if lead else []
        before += [whole(i) for i in range(first - 1, max(first - 3, -1), -1)]
        k = bisect_left(starts, b)
        trail = text[b : min(words[last][1], starts[k] if k < len(starts) else len(text))]
        after = [_number(trail.lower())] if trail else [whole(i) for i in range(last + 1, len(words))[:1]]
        found = [_number("L", *before[1::-1])] if len(before) > 1 else []
        if before and after:
            found.append(_number("B", before[0], after[0]))
        result.append(found)
    return result


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int, int | None, list[int]]]:
    """(start, end, kind number, instance, run, patterns) of base spans and candidates.

    A candidate is a word outside the base spans that keeps four or more digits, or
    an @ with text on both sides, once marks at its ends are off; or a run of number
    words. Its kind is -1; if it fits a base pattern on its own, as each of two card
    numbers side by side does, the pattern's number and ``ALONE``. A word in a run
    names the run's instance and has only those patterns that the run does not have.
    """
    ordered = sorted((a, b, KINDS.index(k)) for k, a, b in spans)
    found = [(*s, None) for s in ordered]
    starts, furthest, reach = [a for a, _, _ in ordered], [], 0
    for _, b, _ in ordered:
        reach = max(reach, b)
        furthest.append(reach)

    def add(a: int, b: int, run: tuple[int, int] | None) -> bool:
        i = bisect_right(starts, b - 1) - 1
        if i >= 0 and furthest[i] > a:
            return False
        alone = [k for k, *place in base_spans(text[a:b]) if place == [0, b - a]]
        found.append((a, b, ALONE + KINDS.index(alone[0]) if alone else -1, run))
        return True

    words = [m.span() for m in _WITH_DIGITS.finditer(text)]
    runs = [r for r in number_runs(text, words) if add(*r, None)]
    first = [a for a, _ in runs]
    for a, b in words:
        a, b = _trimmed(text, a, b)
        word = text[a:b]
        if sum(map(word.count, "0123456789")) >= 4 or "@" in word[1:-1]:
            i = bisect_right(first, a) - 1
            add(a, b, runs[i] if i >= 0 and b <= runs[i][1] else None)
    patterns = _patterns(text, [(a, b) for a, b, _, _ in found])
    of = {(a, b): p for (a, b, _, _), p in zip(found, patterns)}
    result = []
    for (a, b, kind, run), own in zip(found, patterns):
        if run:
            own = [p for p in own if p not in of[run]]
        result.append((a, b, kind, _instance(text, a, b), _instance(text, *run) if run else None, own))
    return result


def _instance(text: str, start: int, stop: int) -> int:
    return _number("I", text[start:stop].lower())


#: Words with a digit or an @; the lookbehind keeps the search linear.
_WITH_DIGITS = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")

_FOUND = (
    "doc_id long, carried string, base array<struct<kind:string,start:int,stop:int>>, "
    "seen array<struct<start:int,stop:int,kind:int,instance:bigint,run:bigint,patterns:array<bigint>>>"
)


def scan(docs: DataFrame, id_column: str, text_column: str, carried: Column | None = None) -> DataFrame:
    """doc_id, carried, base spans and occurrences of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        seen = pa.list_(pa.struct([
            ("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("instance", pa.int64()),
            ("run", pa.int64()), ("patterns", pa.list_(pa.int64())),
        ]))
        names = ("start", "stop", "kind", "instance", "run", "patterns")
        for batch in batches:
            spans, others = [], []
            for text in texts(batch, 2):
                base = base_spans(text)
                spans.append([dict(zip(("kind", "start", "stop"), s)) for s in base])
                others.append([dict(zip(names, o)) for o in occurrences(text, base)])
            columns = [batch.column(0), batch.column(1), pa.array(spans, span), pa.array(others, seen)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "carried", "base", "seen"])

    carried = F.lit("") if carried is None else carried
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), carried.alias("carried"), F.col(text_column))
    return chosen.mapInArrow(run, _FOUND)


def bootstrap(seen: DataFrame, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """instance, kind number, belief (in thousandths) of seeds and of all candidates believed in the end.

    ``seen`` has instance, kind, patterns. A pattern counts once ``support``
    different instances of one kind in it are believed; its confidence is the
    share of believed instances among its instances and one more. Rounds go on until
    no belief changes: a candidate keeps the kind it was first believed as, and a belief
    only rises, in whole thousandths, so that they end, and sums do not depend on order.
    Each round reads the graph once; both sides are grouped before they are joined, and
    of a hot pattern the graph holds each instance once.
    """
    rows = seen.count()
    seeds = seen.filter("kind >= 0").groupBy("instance").agg(F.max(F.col("kind") % ALONE).alias("kind"))
    seeds = stored(seeds.withColumn("belief", F.lit(1000)), "pii-seeds", rows)
    graph = stored(seen.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "pii-graph", 2 * rows)
    per_kind = [F.sum(F.when(F.col("kind") == k, F.col("belief")).otherwise(0)).alias(f"k{k}") for k in range(ALONE)]
    best = F.greatest(*(f"k{k}" for k in range(ALONE)))
    of = F.coalesce(*(F.when(F.col(f"k{k}") == best, F.lit(k)) for k in range(ALONE)))
    found, state = seeds.limit(0), None
    while True:
        believed = seeds.unionByName(found)
        patterns = graph.join(believed, "instance", "left").groupBy("pattern").agg(F.count("*").alias("n"), *per_kind)
        good = patterns.filter(best >= 1000 * support).select("pattern", of.alias("kind"), (best / (1000 * (F.col("n") + 1))).alias("sure"))
        offers = graph.join(good.filter(F.col("sure") >= 0.5), "pattern").join(seeds.select("instance"), "instance", "left_anti")
        each = offers.groupBy("instance", "kind").agg(F.sum(F.log1p(-F.col("sure"))).alias("doubt"))
        belief = F.floor(F.round(1000 * (1 - F.exp("doubt")), 6)).cast("int")
        offered = each.select("instance", "kind", belief.alias("belief"), F.lit(1).alias("late"))
        known = found.withColumn("late", F.lit(0)).unionByName(offered.filter(F.col("belief") >= 1000 * confidence))
        kinds = known.groupBy("instance", "kind").agg(F.max("belief").alias("belief"), F.min("late").alias("late"))
        first = kinds.groupBy("instance").agg(F.min(F.struct("late", (-F.col("belief")).alias("less"), "kind")).alias("top"))
        found = stored(first.select("instance", "top.kind", (-F.col("top.less")).alias("belief")), "pii-believed", rows)
        before, state = state, tuple(found.agg(F.count("*"), F.coalesce(F.sum("belief"), F.lit(0))).first())
        if state == before or not state[0]:
            return seeds.unionByName(found)


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carried: Column | None = None) -> DataFrame:
    """doc_id, carried, base and spans (arrays of kind, start, stop) of every row.

    ``spans`` holds the base spans and the candidates that fit a base pattern on
    their own, are found as base spans elsewhere, or are believed after the
    bootstrap, which gives them the kind of their contexts; words of a run that is
    among them are not listed again. Both are ordered by kind, then start. A null text has none; repeated rows and null ids are kept; an
    empty table gives no rows. Other columns are not read.
    """
    found = stored(scan(docs, id_column, text_column, carried).withColumn("row", F.monotonically_increasing_id()), "pii")
    each = found.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    believed = bootstrap(each).select("instance", F.col("kind").alias("of"))
    new = each.filter(f"kind < 0 OR kind >= {ALONE}").join(believed, "instance")
    new = new.join(believed.select(F.col("instance").alias("run")), "run", "left_anti").groupBy("row").agg(
        F.collect_set(F.struct(F.col("of").alias("kind"), "start", "stop")).alias("new"))
    numbered = F.transform("base", lambda s: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), s.kind).cast("int").alias("kind"), s.start, s.stop))
    more = F.transform(F.coalesce("new", F.expr("array()")), lambda s: F.struct(
        (s.kind + 1).alias("kind"), s.start.alias("start"), s.stop.alias("stop")))
    named = F.transform(F.array_sort(F.concat(numbered, more)), lambda s: F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), s.kind).alias("kind"), s.start.alias("start"), s.stop.alias("stop")))
    return found.join(new, "row", "left").select("doc_id", "carried", "base", named.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def masked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with a mark such as [EMAIL] in place of every span; overlapping spans give way to one mark."""

    def cover(text: pd.Series, spans: pd.Series) -> pd.Series:
        result = []
        for value, found in zip(text, spans):
            if value is None or found is None or not len(found):
                result.append(value)
                continue
            parts, done = [], 0
            for start, stop, kind in sorted((s["start"], s["stop"], s["kind"]) for s in found):
                if start >= done:
                    parts += [value[done:start], MASKS[kind]]
                done = max(done, stop)
            result.append("".join(parts) + value[done:])
        return pd.Series(result, dtype=object)

    key = F.sha2(F.col(text_column), 256)
    hits = find(docs, id_column, text_column, key).filter(F.size("spans") > 0)
    hits = hits.groupBy("carried").agg(F.first("spans").alias("_spans")).withColumnRenamed("carried", "_hash").hint("shuffle_hash")
    covered = F.pandas_udf(cover, "string")(F.col(text_column), F.col("_spans"))
    joined = docs.join(hits, key == F.col("_hash"), "left")
    return joined.select(*(covered.alias(c) if c == text_column else F.col(c) for c in docs.columns))
