"""Kneser-Ney and top-k search against plain versions; pages and URL lists on odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oddities import TEXTS, documents, nothing
from pyspark.sql import functions as F

from tablewright.llm import html_text, kneser_ney, top_k, url_lists
from tablewright.llm.queries import op7_kneser_ney, op9_html
from tablewright.llm.shared import table

FOLDER = "/root/testdata/sf0.001"


# -- language model ------------------------------------------------------------


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + ["\n"]


class Plain:
    """The model by its formulas, with dictionaries."""

    def __init__(self, texts):
        self.counts, self.triples = Counter(), Counter()
        for text in texts:
            own = tokens(text)
            self.counts.update(own)
            self.triples.update(zip(["\t\t", "\t", *own], ["\t", *own], own))
        self.n, self.v = sum(self.counts.values()), len(self.counts)
        self.pairs = Counter((b, c) for _, b, c in self.triples)
        self.ends = Counter(b for _, b in self.pairs)
        self.d3, self.d2, self.d1 = map(self.discounts, (self.triples, self.pairs, self.ends))
        self.rest = sum(self.d1[min(c, 3)] for c in self.ends.values()) / len(self.pairs) if self.pairs else 1
        self.above = [self.sums(counts, off) for counts, off in ((self.pairs, self.d2), (self.triples, self.d3))]

    @staticmethod
    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        found = [0, 0.75, 0.75, 0.75]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            for k in (1, 2, 3):
                value = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.75
                found[k] = value if 0 < value < k else 0.75
        return found

    @staticmethod
    def sums(counts, off):
        total, left = Counter(), defaultdict(float)
        for key, c in counts.items():
            total[key[:-1]] += c
            left[key[:-1]] += off[min(c, 3)]
        return total, left

    def chance(self, a, b, w):
        c = self.ends[w]
        p = max(c - self.d1[min(c, 3)], 0) / max(1, len(self.pairs)) + self.rest / (self.v + 1)
        levels = (((b, w), self.pairs, self.d2, self.above[0]), ((a, b, w), self.triples, self.d3, self.above[1]))
        for key, counts, off, (total, left) in levels:
            if total[key[:-1]]:
                p = (max(counts[key] - off[min(counts[key], 3)], 0) + left[key[:-1]] * p) / total[key[:-1]]
        return p

    def row(self, text):
        own = tokens(text)
        base = sum(math.log10((self.counts[w] + 1) / (self.n + self.v + 1)) for w in own)
        score = sum(math.log10(self.chance(*x)) for x in zip(["\t\t", "\t", *own], ["\t", *own], own))
        return len(own), sum(w in self.counts for w in own), base, score


def held_out(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2


def test_model_query(spark):
    texts = dict(tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect())
    plain = Plain([t for i, t in texts.items() if not held_out(i)])
    rows = op7_kneser_ney(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    gain = 0
    for r in rows:
        n, known, base, score = plain.row(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(r["doc_id"]), n, known, plain.n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-6)
        gain += (score - base) * r["held_out"]
    assert gain > 0


def test_model_sums_to_one():
    plain = Plain(["a b a b c", "b c a", "a a d"])
    for context in (("a", "b"), ("b", "c"), ("\t\t", "\t"), ("\t", "a"), ("c", "unseen"), ("unseen", "a")):
        assert sum(plain.chance(*context, w) for w in [*plain.counts, "never"]) == pytest.approx(1)


@pytest.mark.parametrize("bucket_tokens", [1 << 20, 2000, 300])
def test_model_of_odd_rows(spark, bucket_tokens):
    """Small buckets: frequent words are split, some of them over all buckets."""
    docs = documents(spark)
    plain = Plain([t for _, t in TEXTS])
    model = kneser_ney.train(docs, bucket_tokens=bucket_tokens)
    assert (model.tokens, model.distinct) == (plain.n, plain.v)
    hot = sum(c >= bucket_tokens for c in plain.counts.values())
    assert len(model.words.hot) == hot and (hot > 0) == (bucket_tokens < 1 << 20)
    found = sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in kneser_ney.score(docs, model).collect())
    assert found == sorted((n, k, round(b, 6), round(s, 4)) for n, k, b, s in (plain.row(t) for _, t in TEXTS))
    assert kneser_ney.score(nothing(spark), model).count() == 0
    kneser_ney.drop_model(spark, model)
    with pytest.raises(Exception, match="gone or not seen"):
        kneser_ney.score(docs, model).collect()


def test_arrays_come_back():
    for values in ([], [0], [5, 5, 9, 1 << 40], [255, 256, 65_536, 1 << 63]):
        array = kneser_ney.np.array(values, kneser_ney.np.uint64)
        for rising in (False, True):
            assert kneser_ney._unpacked(kneser_ney._packed(array, rising), rising).tolist() == values


def test_model_of_nothing(spark):
    model = kneser_ney.train(nothing(spark))
    assert (model.tokens, model.distinct, model.unseen) == (0, 0, 1.0)
    assert {r["score"] for r in kneser_ney.score(documents(spark), model).collect()} == {0.0}


# -- search --------------------------------------------------------------------


def plain_top(rows, k, every):
    usable = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    result = []
    for q, (i, v) in enumerate(usable):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(usable) if c != q)
            result += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(result)


@pytest.mark.parametrize("sizes", [(4, 2, 3), (512, 16, 512)])
def test_search_of_odd_rows(spark, sizes):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [math.sin(i * 7.3 + d) for d in range(5)]) for i in range(120)]
    rows += [(0, rows[0][1]), (100, [9.0, 9.0, 9.0, 9.0, 9.0]), (300, None), (400, [nan] * 5), (500, [inf] + [0.0] * 4), (600, [None] * 5)]
    rows += [(700, []), (None, [1.0] * 5), (800, [1.0, 2.0]), (801, rows[3][1]), (802, rows[3][1]), (900, [1e12, -1e12, 0.0, 0.0, 0.0])]
    rows = [(i, v) for i, v in rows if i != 900]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as id", "3 as values")
    block, shard, group = sizes
    found = top_k.top_k(vectors.repartition(3), 3, 10, block_rows=block, shard_blocks=shard, group_rows=group)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 3, 10)
    assert top_k.top_k(vectors.limit(0)).count() == 0


def test_search_beyond_exact_doubles(spark):
    rows = [(i, [float(i * 40_000 + 1), 3.0]) for i in range(12)]
    found = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4, 5)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 4, 5)


# -- pages ---------------------------------------------------------------------

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Top</header>'
    '<div id="cookie-notice">We use cookies</div><nav><a href="x>y">Menu</a></nav><article><h1>Head &amp; shoulders</h1>'
    '<p>One<br>two <b>b</b>old&nbsp; text<p>three <i>four</i><form>no</form><script>var t="</p>";</script><div class="ad"><p>Buy</div>'
    '<ul><li>five</ul><aside>side</aside><div class="Comments"><p>bad</p></div><!-- <p>gone</p> --><p hidden>unseen</p>six &lt;7</article>'
    "<div>outside</div><footer>Foot</footer>"
)


def test_markup_decides():
    texts = html_text._chosen(html_text.blocks(PAGE), set())
    assert texts == ["Head & shoulders", "One", "two bold text", "three four", "five", "six <7"]


@pytest.mark.parametrize("icon", ["<svg class='i'/>", '<svg viewBox="0 0 1 1" />', "<math/>", "<svg><path d='M0 0'/>"])
def test_icons_take_no_text_after_them(icon):
    closed = "<svg><title>Icon</title></svg>" if icon.endswith("/>") and "path" not in icon else ""
    page = f"<p>Before</p>{icon}<article><p>One {icon} two</p>{closed}<p>three</p></article>"
    assert html_text._chosen(html_text.blocks(page), set()) == ["One two", "three"]


def test_pages_query_keeps_whole_articles(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in table(spark, FOLDER, "pages").collect()}
    for r in op9_html(spark, FOLDER).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|br|h1)>", inside))
        text = "\n".join(filter(None, blocks))
        assert (r["text"], r["n_chars"]) == (text, len(text))


def test_repeated_runs_of_a_host_go(spark):
    menu = "<div>Home</div><div>About our small firm</div><div>Write to us</div><div>All rights are reserved here</div>"
    stories = [f"<p>Story {k} tells of {' and '.join(f'thing{k * 100 + i}' for i in range(30))}</p>" for k in range(4)]
    rows = [(k, f"http://a.example/{k}", f"<body>{menu}{s}{menu}") for k, s in enumerate(stories[:3])]
    rows += [(10, "http://a.example/0?copy", rows[0][2]), (11, "http://b.example/", f"<body>{menu}{stories[3]}")]
    rows += [(12, "http://c.example/", "<p>same page, a copy of which has the same content</p>")] * 2
    rows += [(13, None, None), (14, "no url", ""), (None, "http://a.example/x", "<p>a < b &amp; c"), (15, "http://a.example/y", "<nav>only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as page", "2 as host", "3 as text")
    found = Counter((r["page_id"], r["text"]) for r in html_text.extract(pages.repartition(3)).collect())
    plain = [re.sub("</?p>", "", s) for s in stories]
    menu_text = "Home\nAbout our small firm\nWrite to us\nAll rights are reserved here"
    expected = [(0, plain[0]), (1, plain[1]), (2, plain[2]), (10, plain[0]), (11, f"{menu_text}\n{plain[3]}")]
    expected += [(12, "same page, a copy of which has the same content")] * 2
    expected += [(13, ""), (14, ""), (None, "a < b & c"), (15, "")]
    assert found == Counter(expected)
    assert html_text.extract(pages.limit(0)).count() == 0


def main_texts(spark, pages: list[str]) -> list[str]:
    rows = [(i, f"http://h.org/{i}", page) for i, page in enumerate(pages)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    return [r["text"] for r in found.orderBy("page_id").collect()]


def words_of(name: str, n: int) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


def test_long_repeated_block_goes_up_to_its_own_tail(spark):
    notice = words_of("law", 200)
    pages = [f"<p>{words_of(k, 30)}</p><p>{notice} {k}tail</p>" for k in "abc"]
    assert main_texts(spark, pages) == [f"{words_of(k, 30)}\n{k}tail" for k in "abc"]


def test_page_that_repeats_its_boilerplate_loses_every_copy(spark):
    notice = words_of("law", 20)
    # sorted by what follows, the copies of the first page are next to each other and only one is next to the second page
    first = f"<p>{notice}</p><p>aa {words_of('x', 20)}</p><p>{notice}</p><p>ab {words_of('y', 20)}</p><p>{notice}</p><p>ac {words_of('u', 20)}</p>"
    texts = main_texts(spark, [first, f"<p>{notice}</p><p>zz {words_of('z', 20)}</p>"])
    assert texts == ["\n".join(f"{a} {words_of(k, 20)}" for a, k in (("aa", "x"), ("ab", "y"), ("ac", "u"))), f"zz {words_of('z', 20)}"]


def test_repeats_go_from_main_elements_and_stay_in_articles(spark):
    notice = words_of("law", 20)
    wrap = ["<main><p>{}</p><p>{}</p></main>", "<div role='main'><p>{}</p><p>{}</p></div>", "<p>{}</p><p>{}</p>", "<article><p>{}</p><p>{}</p></article>"]
    texts = main_texts(spark, [w.format(words_of(k, 20), notice) for w, k in zip(wrap, "abcd")])
    assert texts == [words_of("a", 20), words_of("b", 20), words_of("c", 20), f"{words_of('d', 20)}\n{notice}"]
    # an article is evidence for the only page of its host without one
    texts = main_texts(spark, [wrap[k].format(words_of(n, 20), notice) for k, n in ((0, "a"), (3, "d"))])
    assert texts == [words_of("a", 20), f"{words_of('d', 20)}\n{notice}"]


# -- URL lists -----------------------------------------------------------------


def test_entries_hold_from_their_date_to_the_next(spark):
    entries = spark.createDataFrame([
        ("l", "domain", "bad.org", "add", 100), ("l", "domain", "bad.org", "add", 100), ("l", "domain", "bad.org", "remove", 200),
        ("l", "domain", "bad.org", "add", 300), ("m", "prefix", "ok.org/x", "add", 150), ("m", "host", "ok.org", "add", 500),
        ("m", "host", "ok.org", "remove", 500), ("m", "host", None, "add", 1), ("m", "host", "bad.org", "add", None),
    ], "list string, kind string, pattern string, action string, at long")
    rows = [(1, "http://WWW.bad.org./a", 99), (2, "http://www.bad.org/a", 100), (3, "https://u@bad.org:8/", 199), (4, "http://bad.org", 200),
            (5, "http://bad.org", 10_000), (6, "http://notbad.org", 150), (7, "http://ok.org/x/y?z", 150), (8, "http://ok.org/xy", 150),
            (9, "http://ok.org/", 600), (10, None, 150), (11, "nothing", 150), (12, "http://bad.org", None), (2, "http://www.bad.org/a", 100)]
    captures = spark.createDataFrame(rows, "id long, url string, fetched_at long").withColumn("lists", F.lit("old"))
    for period in (7, 86_400):
        found = url_lists.evaluate(captures, entries, period)
        assert found.count() == len(rows) and set(found.columns) == {*captures.columns, "blocked", "n_active", "listed_since"}
        hits = {(r["id"], r["lists"], r["n_active"], r["listed_since"]) for r in found.filter("blocked").collect()}
        assert hits == {(2, "l", 1, 100), (3, "l", 1, 100), (5, "l", 1, 300), (7, "m", 1, 150)}
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0
    assert url_lists.evaluate(captures, entries.limit(0)).filter("blocked").count() == 0


def test_nothing_goes_from_the_middle_of_a_sentence(spark):
    pages = [
        "<main><p>Mayor Lee said on Tuesday that at the end of the day nothing had been decided yet.</p></main>",
        "<main><p>The coach noted that at the end of the day nothing matters more than points.</p></main>",
    ]
    assert main_texts(spark, pages) == [re.sub("<[^>]*>", "", p) for p in pages]


def test_what_few_pages_of_a_host_quote_stays(spark):
    quote, notice = words_of("quoted", 30), words_of("law", 30)
    pages = [f"<main><p>{words_of(f'p{k}x', 20)}</p>{f'<p>{quote}</p>' if k < 2 else ''}<p>{notice}</p></main>" for k in range(25)]
    expected = [words_of(f"p{k}x", 20) + (f"\n{quote}" if k < 2 else "") for k in range(25)]
    assert main_texts(spark, pages) == expected


def test_names_are_no_cues_inside_sentences_or_as_parts_of_others():
    page = (
        "<article><p>We study <span class='social-science'>society</span> and <em class='widget'>things</em>.</p>"
        "<section class='related-work'><p>Others did.</p></section><div class='related'>More</div><div class='link-share'>Tell</div></article>"
    )
    assert html_text._chosen(html_text.blocks(page), set()) == ["We study society and things.", "Others did."]


def test_a_teaser_is_not_the_whole_text():
    page = "<main><article class='teaser'><p>Short.</p></article><p>The body of this page is longer than that.</p></main>"
    assert html_text._chosen(html_text.blocks(page), set()) == ["Short.", "The body of this page is longer than that."]


def test_repeated_runs_decide_main_elements_beside_articles(spark):
    notice = words_of("law", 20)
    pages = [
        f"<main><h1>Headline of {k}</h1><p>{notice}</p><article><p>{words_of(k, 60)}</p></article></main>" for k in "abc"
    ]
    assert main_texts(spark, pages) == [f"Headline of {k}\n{words_of(k, 60)}" for k in "abc"]


def test_long_page_and_clashing_names(spark):
    long = "<p>" + words_of("w", 200_000) + "</p>"
    pages = spark.createDataFrame([(1, "http://l.org/1", long)], "page_id long, url string, html string").selectExpr("*", "1 AS repeated", "2 AS page")
    [row] = html_text.extract(pages).collect()
    assert row["text"] == words_of("w", 200_000)


def plain_repeated(pages: list[str], one_in: int) -> list[set[tuple]]:
    """Of each page the runs of LEAST tokens that enough pages have, by comparing all."""
    streams = [[t for _, text in html_text.blocks(p) for t in (*text.split(" "), "\n")] for p in pages]
    own = [{tuple(s[i : i + html_text.LEAST]) for i in range(len(s) - html_text.LEAST + 1)} for s in streams]
    return [{w for w in mine if (n := sum(w in other for other in own)) > 1 and n * one_in >= len(pages)} for mine in own]


@pytest.mark.parametrize("one_in", [2, 10])
def test_repeated_windows_against_all_pages(spark, one_in):
    import random

    draw = random.Random(4)
    notices = [words_of(n, 12) for n in "xyz"]
    pages = [f"<main><p>{words_of(f'q{k}', 9)}</p>{''.join(f'<p>{n}</p>' for n in notices if draw.random() < 0.4)}</main>" for k in range(12)]
    frame = spark.createDataFrame([("h", k, p) for k, p in enumerate(pages)], "host string, page long, html string").repartition(3)
    found = {r["page"]: set(r["repeated"]) for r in html_text.repeated_windows(frame, one_in).collect()}
    for k, expected in enumerate(plain_repeated(pages, one_in)):
        windows = html_text._windows(html_text.blocks(pages[k]), "h").tolist()
        stream = [t for _, text in html_text.blocks(pages[k]) for t in (*text.split(" "), "\n")]
        hit = {w for i, w in enumerate(windows) if tuple(stream[i : i + html_text.LEAST]) in expected}
        assert found.get(k, set()) == hit


def test_sums_of_slices_read_the_slices_only(monkeypatch):
    import numpy as np

    from tablewright.llm import kneser_ney

    draw = np.random.default_rng(1)
    values = draw.integers(1, 9, 5_000).astype("u1")
    low = np.sort(draw.integers(0, 4_900, 300))
    high = low + draw.integers(0, 40, 300)
    high[::7], low[5], high[5] = low[::7] + 1, 0, len(values)
    off = np.array([0.0, 0.5, 0.75, 0.9])
    for held in (10, 100_000):
        monkeypatch.setattr(kneser_ney, "_HELD", held)
        total, left = kneser_ney._slice_sums(values, low, high, off)
        assert total.tolist() == [int(values[a:b].sum()) for a, b in zip(low, high)]
        assert np.allclose(left, [off[np.minimum(values[a:b], 3)].sum() for a, b in zip(low, high)])
    none = np.zeros(0, np.int64)
    assert [len(x) for x in kneser_ney._slice_sums(values, none, none, off)] == [0, 0]
