"""Main text of HTML pages.

Markup decides where it can: text inside an article is the main text, text inside
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments is not. Blocks of a main element that lie in no article are undecided,
on pages with articles too; so are all blocks of pages with neither. There the host's
other pages decide, whatever the sizes of articles and main elements: runs of tokens
repeated on a share of the host's pages are boilerplate. A block goes if such runs
cover it; of other blocks only a long run at their beginning or end goes, and
nothing is cut out of the middle of a sentence. What an article holds stays, and
counts as other content as well; pages without undecided blocks are looked at where
their host has some with.

A run of at least ``LEAST`` tokens is a chain of windows of that length, each of
which is repeated too. So the suffix at every token is looked at by its first
``LEAST`` tokens, and chains of any length, over any number of blocks, come of
themselves. All suffixes that begin alike meet in one group, whatever pages they
are from and whatever follows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored

#: Tags and the words in class, id and role that mark what is no main text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
_FOREIGN = frozenset(("svg", "math"))
_LEFT_OUT = frozenset("nav footer aside form dialog menu button select object head canvas audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot "
    "thead tr ul".split()
)
_CELL = frozenset(("td", "th"))
_FORMAT = frozenset("p a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())
_INLINE = _FORMAT - {"p", "a"}
_CUES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies disqus footer gdpr login menu modal nav navbar navigation navigation "
    "newsletter notice notices overlay pager pagination popup promo promoted recommended related replies respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: These are also parts of names for main text, so only a whole name or its last part counts.
_WEAK = frozenset("related social search share sharing widget respond notice notices".split())
_HEADS = frozenset("header masthead".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>", re.DOTALL
)
#: A tag that the page ends in.
_CUT_OFF = re.compile(r"<[a-zA-Z/!?].*+", re.DOTALL)
_NAMED = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _RAW}

OUT, PLAIN, MAIN, ARTICLE = range(4)
LEAST = 8
#: Of a block that is not covered, a run at an edge goes from so many tokens on.
EDGE = 20
#: A run is boilerplate on two pages of a host at least, and on one in so many of them.
ONE_IN = 10
_STEP, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = [np.uint64(pow(_STEP, k, 1 << 64)) for k in range(LEAST)]


def _kind(name: str, attributes: str, around: int) -> int:
    """The zone inside an element, given the zone around it."""
    if around == OUT or name in _LEFT_OUT or name == "header" and around < MAIN:
        return OUT
    main = False
    if attributes:
        for m in _NAMED.finditer(attributes):
            key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return OUT
            if key == "style":
                if "display:none" in value.replace(" ", "").lower():
                    return OUT
                continue
            names = [[w.lower() for w in _PARTS.findall(v)] for v in value.split()]
            words = {w for parts in names for w in parts if w not in _WEAK} | {parts[-1] for parts in names if parts}
            main = main or key == "role" and "main" in words
            if name in ("html", "body", "article", "main") and key != "role" and not words & {"comment", "comments"}:
                continue
            if name in _INLINE and not around < MAIN:
                continue  # part of a sentence, whatever its name
            if words & _CUES or around < MAIN and words & _HEADS:
                return OUT
    if name == "article":
        return ARTICLE
    return max(around, MAIN) if name == "main" or main else around


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in page order, those left out excepted."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone around each
    opened: dict[str, int] = {}
    parts: list[str] = []
    zone, at, size, last = PLAIN, 0, len(page), page.rfind(">") + 1

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((zone, text))
            parts.clear()

    def add(piece: str) -> None:
        parts.append(html.unescape(piece) if "&" in piece else piece)

    while at < size:
        m = _TAG.search(page, at, last)
        if m is None:
            cut = _CUT_OFF.search(page, max(at, last))
            if zone != OUT:
                add(page[at : cut.start() if cut else size])
            break
        if zone != OUT and m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in _CELL:
            parts.append(" ")
        elif name in _BLOCK:
            close()
        if m[1] or m[4]:
            loose = name in _FORMAT
            for k in range(len(stack) - 1, -1, -1) if opened.get(name) else ():
                if stack[k][0] == name:
                    if stack[k][1] != zone:
                        close()
                    zone = stack[k][1]
                    for gone, _ in stack[k:]:
                        opened[gone] -= 1
                    del stack[k:]
                    break
                if loose and stack[k][0] not in _FORMAT:
                    break
            continue
        if name in _RAW:
            # only in foreign elements does a slash close; one that never ends takes no more than its tag
            foreign = name in _FOREIGN
            end = None if foreign and m[0].endswith("/>") else _ENDS[name].search(page, at)
            at = end.end() if end else at if foreign else size
            continue
        if name in _VOID:
            continue
        inside = _kind(name, m[3] or m[6] or "", zone)
        if inside != zone:
            close()
        stack.append((name, zone))
        opened[name] = opened.get(name, 0) + 1
        zone = inside
    close()
    return found


def _windows(found: list[tuple[int, str]], host: str | None) -> np.ndarray:
    """A hash of the host and the ``LEAST`` tokens from each token on; tokens are the blocks' words, and a mark after each block."""
    stream = [t for _, text in found for t in (*text.split(" "), "\n")]
    if len(stream) < LEAST:
        return np.zeros(0, np.int64)
    seen = {t: xxhash.xxh64_intdigest(t.encode()) for t in set(stream)}
    tokens = np.fromiter(map(seen.__getitem__, stream), np.uint64, len(stream))
    n = len(tokens) - LEAST + 1
    windows = np.full(n, xxhash.xxh64_intdigest(b"\0" if host is None else host.encode()), np.uint64)
    for k, power in enumerate(_POWERS):
        windows += tokens[k : k + n] * power
    windows ^= windows >> np.uint64(31)
    return (windows * _MIX).view(np.int64)


def _spread(hit: np.ndarray) -> np.ndarray:
    """Which tokens lie in the windows that are hit."""
    covered = np.zeros(len(hit) + LEAST - 1, bool)
    for k in range(LEAST):
        covered[k : k + len(hit)] |= hit
    return covered


def _least_zone(found: list[tuple[int, str]]) -> int:
    """The zone from which on blocks are main text unless runs cover them: the best one, but articles do not hide their main element's blocks."""
    zones = {zone for zone, _ in found}
    return MAIN if MAIN in zones else max(zones, default=PLAIN)


def _edges(gone: np.ndarray) -> slice:
    """What stays of a block when runs of ``EDGE`` tokens or more at its beginning and end go."""
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return slice(0, 0)
    head, tail = int(kept[0]), int(kept[-1]) + 1
    return slice(head if head >= EDGE else 0, tail if len(gone) - tail >= EDGE else len(gone))


def _chosen(found: list[tuple[int, str]], repeated: set[int], host: str | None = None) -> list[str]:
    """The blocks of main text; outside articles without what repeated windows cover.

    That is whole blocks, and of other blocks the long runs that lie at their edges:
    the end of a run from the block before can be a word both happen to begin with.
    """
    least = _least_zone(found)
    if not repeated or least == ARTICLE:
        return [text for zone, text in found if zone >= least]
    hit = np.isin(_windows(found, host), np.fromiter(repeated, np.int64, len(repeated)))
    covered = _spread(hit)
    left, at = [], 0
    for zone, text in found:
        words = text.split(" ")
        stop = at + len(words)
        if zone == ARTICLE:
            left.append(text)
        elif zone >= least and not covered[at:stop].all():
            inside = hit[at : max(at, stop - LEAST + 1)]
            left.append(" ".join(words[_edges(_spread(inside))]) if inside.any() else text)
        at = stop + 1
    return left


def _page_windows(pages: DataFrame, decided: bool) -> DataFrame:
    """host, page (hash of its content) and the different windows of pages with undecided blocks, or of those without."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, own, windows = [], [], []
            for host, page, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = blocks(value.as_py() or "")
                if found and decided == (_least_zone(found) == ARTICLE):
                    hosts.append(host)
                    own.append(page)
                    windows.append(np.unique(_windows(found, host)))
            columns = [pa.array(hosts, pa.string()), pa.array(own, pa.int64()), pa.array(windows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "page", "windows"])

    return pages.mapInArrow(run, "host string, page long, windows array<long>")


def repeated_windows(pages: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """page (hash of its content), repeated (its windows that enough pages of other content on the host have); ``pages`` has host, page, html."""
    open_pages = stored(_page_windows(pages, False), "windows")
    hosts = open_pages.select("host").distinct()
    there = pages.join(hosts, pages["host"].eqNullSafe(hosts["host"]), "left_semi")
    sizes = there.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "of")
    window = F.explode("windows").alias("window")
    each = open_pages.select("page", window)
    everywhere = open_pages.select("host", "page", window).unionByName(_page_windows(there, True).select("host", "page", window))
    often = everywhere.distinct().groupBy("host", "window").agg(F.count("*").alias("n")).filter("n > 1")
    often = often.join(sizes, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") * one_in >= F.col("pages"))
    return each.join(often.select("window"), "window").groupBy("page").agg(F.collect_set("window").alias("repeated"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Character references are decoded, white space in a block becomes one blank,
    blocks are joined by line feeds. A null or empty page has an empty text; a page
    whose text is all left out too. Null and repeated ids and urls are kept (pages
    without a url are one host), an empty table gives no rows, other columns are
    not read.
    """
    content = F.xxhash64(F.col(html_column)).alias("page")
    hosts = pages.select(host_of(F.col(url_column)).alias("host"), content, F.col(html_column).alias("html"))
    repeated = stored(repeated_windows(hosts), "repeated")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                "\n".join(_chosen(blocks(value.as_py() or ""), set(hidden or ()), host))
                for value, hidden, host in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ]
            sizes = pa.array(map(len, found), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), content)
    joined = chosen.join(repeated, "page", "left").select("page_id", "url", "html", "repeated", host_of(F.col("url")).alias("host"))
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
