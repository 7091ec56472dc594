"""Personal data, secrets and quality against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

from oddities import TEXTS, documents, nothing
from pyspark.sql import functions as F

from tablewright.llm import pii, quality, secrets
from tablewright.llm.queries import op6_pii, op8_quality, op10_secrets
from tablewright.llm.shared import table

FOLDER = "/root/testdata/sf0.001"


def texts_of(spark):
    return [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]


def plain_pii(text):
    digits = lambda s: [c for c in s if c in "0123456789"]
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        weights = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if 13 <= len(d) <= 19 and sum(w - 9 if w > 9 else w for w in weights) % 10 == 0:
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def plain_secrets(text):
    found = [("assign", *m.span()) for m in re.finditer(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.IGNORECASE | re.ASCII
    ) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_of_drawn_texts():
    draw = random.Random(4)
    parts = list("ab.@-_%+1 2") + ["a@b.c", "1.2.3.4", "256.1.1.1", "+1 (415) 555-2671", "4465758382889437", "é", "\n", "000012.3.4.5"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 16)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_secrets_of_drawn_texts():
    draw = random.Random(5)
    words = secrets.automaton()
    parts = ["token", "secret", "PASSWD", "api_key", "apikey", "AKIA", "=", ":", " ", '"', "'", "abcd1234", "x", "Z9",
             "0123456789abcdef" * 2, "é", "K", "İ", "ſ", "\n", "AKIA0123456789ABCD", ".", "-"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert secrets.find(text, words) == plain_secrets(text), text


def test_checksums():
    words = secrets.automaton()
    body, value, check = "0123456789abcdefghijABCDEFGHIJ", zlib.crc32(b"0123456789abcdefghijABCDEFGHIJ"), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        check = secrets._BASE62[digit] + check
    assert secrets.find(f"x ghp_{body}{check} y", words) == [("github", 2, 42)]
    assert secrets.find(f"x ghp_{body}zzzzzz y", words) == []
    nostr = "nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5"  # a published example
    assert secrets.find(nostr, words) == [("bech32", 0, 63)] and secrets.find(nostr[:-1] + "6", words) == []


def test_secret_query(spark):
    for docs, rows in ((op10_secrets(spark, FOLDER), texts_of(spark)),):
        expected = sorted(
            (i, *(sum(k == kind for k, _, _ in s) for kind in secrets.BASE), sha256(joined(s).encode()).hexdigest())
            for i, s in ((i, plain_secrets(t or "")) for i, t in rows))
        assert sorted(tuple(r)[:5] for r in docs.collect()) == expected
    assert secrets.scan(nothing(spark)).count() == 0
    found = secrets.scan(documents(spark)).select("doc_id", secrets.written(F.col("spans")))
    assert Counter(map(tuple, found.collect())) == Counter((i, joined(plain_secrets(t or ""))) for i, t in TEXTS)


def test_personal_data_query(spark):
    found = {r["doc_id"]: r for r in op6_pii(spark, FOLDER).collect()}
    for i, text in texts_of(spark):
        base = plain_pii(text or "")
        assert found[i]["base_sha256"] == sha256(joined(base).encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert set(joined(base).split(",")) <= set(found[i]["spans"].split(",")) or not base
    assert pii.find(nothing(spark)).count() == 0 and pii.masked(nothing(spark)).count() == 0


def test_contexts_find_what_patterns_miss(spark):
    rows = [(k, f"Please call me on +1 415 555-26{k:02d} today or tomorrow.") for k in range(20)]
    rows += [(100, "Please call me on 0044/20/79460000 today or never."), (101, "In total 20794600 people came here.")]
    rows += [(102, "Twice: 4465758382889437 4465758382889437 there.")]
    found = {r["doc_id"]: r["s"] for r in pii.find(documents(spark, rows)).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert found[100] == "phone:18:34" and found[101] == ""
    assert found[102] == "card:7:23,card:24:40"
    masked = {r["doc_id"]: r["text"] for r in pii.masked(documents(spark, rows)).collect()}
    assert masked[100] == "Please call me on [PHONE] today or never." and masked[102] == "Twice: [CARD] [CARD] there."
    assert masked[101] == rows[21][1]


def test_numbers_in_several_words(spark):
    rows = [(k, f"Please call me on +1 415 555-26{k:02d} today or tomorrow.") for k in range(20)]
    rows += [(100, "Please call me on (415) 555-2671 today."), (101, "Please call me on 44 20 7946 0000."), (102, "In 2019 and 2020 7946 came.")]
    rows += [(103, "Please call me on (020)79460000 today"), (104, "Please call me on\n2079 4600 now or (020) 7946-1111")]
    masked = {r["doc_id"]: r["text"] for r in pii.masked(documents(spark, rows)).collect()}
    assert masked[100] == "Please call me on [PHONE] today." and masked[101] == "Please call me on [PHONE]."
    assert masked[102] == rows[22][1] and masked[103] == "Please call me on [PHONE] today"
    assert masked[104] == "Please call me on\n[PHONE] now or (020) 7946-1111"


def runs_of(text):
    words = [m.span() for m in pii._WITH_DIGITS.finditer(text)]
    return [text[a:b] for a, b in pii.number_runs(text, words)]


def test_number_runs():
    assert runs_of("a (415) 555-2671. 20 7946 0000, 12") == ["(415) 555-2671", "20 7946 0000"]
    assert runs_of("+44 (20) 7946 0000 (415) 555 2671 (call 020 7946 1111)") == ["+44 (20) 7946 0000", "(415) 555 2671", "020 7946 1111"]
    assert runs_of("2079\n4600 1111") == ["4600 1111"] and runs_of("1 2 3") == [] and runs_of("1234 " * 5) == []


def test_contexts_are_whole_words():
    long = "w" * 5000
    first, second = f"{long}a {long}b 20794600 {long}c", f"{long}a {long}b 20794601 {long}d"
    [one], [two] = (pii.occurrences(t, []) for t in (first, second))
    assert len(one[-1]) == 2 and one[-1][0] == two[-1][0] and one[-1][1] != two[-1][1]
    assert pii.occurrences("x" * 5000 + first, [])[0][-1][0] != one[-1][0]
    packed = ",".join(f"a{k}@b.co" for k in range(20_000))
    found = pii.occurrences(f"{long} {long} {packed}", pii.base_spans(f"{long} {long} {packed}"))
    assert len([f for f in found if f[2] == 0]) == 20_000


def plain_bootstrap(seen, support, confidence):
    """The rounds on sets and dictionaries."""
    seeds, graph = {}, set()
    for instance, kind, patterns in seen:
        if kind >= 0:
            seeds[instance] = max(seeds.get(instance, 0), kind % pii.ALONE)
        graph |= {(p, instance) for p in patterns}
    found = {}
    while True:
        believed = {i: (k, 1000) for i, k in seeds.items()} | found
        offers = defaultdict(float)
        for pattern in {p for p, _ in graph}:
            of = [i for p, i in graph if p == pattern]
            sums = [sum(believed[i][1] for i in of if i in believed and believed[i][0] == k) for k in range(pii.ALONE)]
            sure = max(sums) / (1000 * (len(of) + 1))
            if max(sums) >= 1000 * support and sure >= 0.5:
                for i in of:
                    if i not in seeds:
                        offers[i, sums.index(max(sums))] += math.log1p(-sure)
        after = dict(found)
        for (i, kind), doubt in sorted(offers.items(), key=lambda o: (o[0][0], o[1], o[0][1])):
            belief = math.floor(round(1000 * (1 - math.exp(doubt)), 6))
            if belief >= 1000 * confidence and (i not in after or (after[i][0] == kind and after[i][1] < belief)):
                after[i] = kind, belief
        if after == found:
            return believed
        found = after


def test_bootstrap_against_plain_rounds(spark):
    draw = random.Random(6)
    seen = []
    for chain in range(3):  # each group of patterns leads from the seeds to candidates several rounds away
        for step in range(6):
            for member in range(20 - 3 * step):
                instance = chain * 1000 + step * 10 + member
                patterns = [chain * 100 + 4 * step + k for k in range(4)]
                patterns += [p + 4 for p in patterns if draw.random() < 0.9]
                seen.append((instance, chain % 3 if step == 0 else -1, patterns))
    seen += [(9000 + draw.randrange(40), draw.choice([-1, -1, 1, pii.ALONE + 2]), [draw.randrange(1000, 1008)]) for _ in range(150)]
    for support, confidence in ((3, 0.8), (2, 0.6)):
        rows = spark.createDataFrame(seen, "instance long, kind int, patterns array<long>")
        got = {r["instance"]: (r["kind"], r["belief"]) for r in pii.bootstrap(rows, support, confidence).collect()}
        expected = plain_bootstrap(seen, support, confidence)
        assert got == expected
    assert any(i % 1000 >= 40 for i in got if i < 3000), "no candidate more than three rounds away"


def test_masking_keeps_odd_rows(spark):
    docs = documents(spark)
    masked = pii.masked(docs)
    assert masked.columns == docs.columns and masked.count() == len(TEXTS)
    [text] = [r["text"] for r in masked.collect() if r["doc_id"] == 6]
    assert text.startswith("Mail [EMAIL] or [PHONE], [IP];")


def plain_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(covered), failed


def test_quality_query(spark):
    found = op8_quality(spark, FOLDER).collect()
    assert sorted(tuple(r)[:7] for r in found) == sorted((i, *plain_counts(t or "")) for i, t in texts_of(spark))
    assert all(not (r["kept"] and r["base_failed"]) for r in found)


def test_quality_of_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("good"))
    rows = op8_quality(spark, folder).join(labels, "doc_id").filter("n_words >= 20").collect()
    good, bad = [r for r in rows if r["good"]], [r for r in rows if not r["good"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.85 * len(bad)


def test_quality_of_odd_rows(spark):
    found = quality.judged(documents(spark))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter((i, *plain_counts(t or "")) for i, t in TEXTS)
    assert quality.judged(nothing(spark)).count() == 0 and quality.drop_rejected(nothing(spark)).count() == 0
    assert quality.posteriors({}) == {}


def test_repeated_words_of_drawn_texts():
    draw = random.Random(6)
    for _ in range(500):
        text = " ".join(draw.choice("abc") for _ in range(draw.randint(0, 60)))
        assert quality.measure(text)[0][4] == plain_counts(text)[4]


def test_accuracies_follow_the_votes():
    """Two rules that agree with the keep rules' silence are believed, one against them is not."""
    keep, reject = [1 << i for i, r in enumerate(quality.RULES) if r[1] == quality.KEEP], [1 << i for i, r in enumerate(quality.RULES) if r[1] == quality.REJECT]
    found = quality.posteriors({sum(keep): 800, reject[0] | reject[1]: 100, reject[2] | sum(keep): 60, reject[3]: 5, 0: 10})
    assert found[sum(keep)] > 0.9 and found[reject[0] | reject[1]] < 0.1 and found[reject[2] | sum(keep)] > 0.5
    assert found[reject[3]] < 0.5 and found[0] == 0.5


def test_posteriors_against_plain_rounds():
    """Each document by itself, in plain Python, for many more rounds."""
    draw = random.Random(8)
    for n in (1, 30, 400):
        docs = [sum(1 << i for i in range(len(quality.RULES)) if draw.random() < 0.3) for _ in range(n)]
        accuracy = [quality._ACCURACY[side] for _, side, _, _ in quality.RULES]
        for _ in range(400):
            right, cast = [0.0] * len(accuracy), [0] * len(accuracy)
            good = {}
            for votes in docs:
                odds = 1.0
                for i, (_, side, _, _) in enumerate(quality.RULES):
                    odds *= (accuracy[i] / (1 - accuracy[i])) ** (side * (votes >> i & 1))
                good[votes] = odds / (1 + odds)
                for i, (_, side, _, _) in enumerate(quality.RULES):
                    if votes >> i & 1:
                        cast[i] += 1
                        right[i] += good[votes] if side == quality.KEEP else 1 - good[votes]
            weight = quality._PRIOR_WEIGHT * n
            accuracy = [(r + weight * quality._ACCURACY[side]) / (c + weight) for r, c, (_, side, _, _) in zip(right, cast, quality.RULES)]
        found = quality.posteriors(dict(Counter(docs)))
        assert all(abs(found[v] - good[v]) < 1e-6 for v in good)
