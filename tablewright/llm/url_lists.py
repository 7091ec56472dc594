"""URL lists as they were when a page was fetched, in built-in functions only.

A dated list entry adds a pattern to a list or removes it. Entries of a pattern
follow one another in time, so each addition is valid until the next entry of the
same list and pattern: a validity interval. A capture is looked up under its host,
each parent domain and each path prefix, all by equality, and the as-of condition
keeps the interval that holds its fetch time.

Intervals are cut at fixed periods and the period belongs to the join key. A
pattern with a long history is then many small keys, and a capture meets only the
entries of its own period. A host with a third of all captures is split by time,
and beyond that the adaptive skew join can split its captures, as the other side
has few rows a key. Captures that share URL and time are evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("host", "domain", "prefix")
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a closing dot; empty where the text is no absolute URL."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")


def keys_of(url: Column) -> Column:
    """Array of (kind, pattern): the host, it and each parent domain, and host with each path prefix."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")

    def key(kind: str, pattern: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"))

    domains = F.transform(labels, lambda _, i: key("domain", F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    prefixes = F.transform(steps, lambda _, i: key("prefix", F.concat_ws("/", host, F.slice(steps, 1, i + 1))))
    return F.when(host != "", F.concat(F.array(key("host", host)), domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, valid_from, valid_to (null: still valid) from list, kind, pattern, action, at.

    Of entries of one time the removal counts, so an interval is never empty.
    Entries with nulls say nothing. Repeated entries count once.
    """
    columns = ["list", "kind", "pattern", "at"]
    clean = entries.na.drop(subset=[*columns, "action"]).filter(F.col("action").isin("add", "remove"))
    dated = clean.groupBy(*columns).agg(F.max("action").alias("action"))
    history = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    stretched = dated.withColumn("valid_to", F.lead("at").over(history)).filter("action = 'add'")
    return stretched.select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def active_entries(captures: DataFrame, valid: DataFrame, period: int) -> DataFrame:
    """url, fetched_at with list, kind, pattern, valid_from of every entry active then."""
    seen = captures.select("url", "fetched_at").na.drop().distinct()
    asked = seen.withColumn("key", F.explode(keys_of(F.col("url")))).select(
        "url", "fetched_at", "key.kind", "key.pattern", F.expr(f"fetched_at div {period}").alias("period"))
    latest = seen.agg(F.max("fetched_at").alias("latest"))
    periods = F.expr(f"sequence(valid_from div {period}, least(coalesce(valid_to, latest), latest) div {period})")
    listed = valid.join(F.broadcast(latest)).filter("valid_from <= latest").withColumn("period", F.explode(periods))  # one row
    as_of = (F.col("valid_from") <= F.col("fetched_at")) & (
        F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    return asked.join(listed, ["kind", "pattern", "period"]).filter(as_of).select(
        "url", "fetched_at", "list", "kind", "pattern", "valid_from")


def evaluate(captures: DataFrame, entries: DataFrame, period: int = 30 * 86_400) -> DataFrame:
    """All rows and columns of ``captures``, with blocked, n_active, lists, listed_since.

    ``captures`` needs url and fetched_at (seconds, long), ``entries`` list, kind
    (host, domain or prefix), pattern, action (add or remove) and at (seconds). A
    domain stands for its subdomains too, a prefix for host and path up to a slash;
    query and fragment play no part. ``lists`` names the lists in order, joined by
    commas; ``listed_since`` is the earliest start of the active entries. A capture
    without a URL or time matches nothing. Repeated rows stay; columns of captures
    with one of the four names are replaced. ``period`` changes no result.
    """
    added = ["blocked", "n_active", "lists", "listed_since"]
    hits = active_entries(captures, intervals(entries), period).groupBy("url", "fetched_at").agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.min("valid_from").alias("listed_since"))
    joined = captures.drop(*added).join(hits, ["url", "fetched_at"], "left")
    return joined.withColumns({
        "blocked": F.col("n_active").isNotNull(),
        "n_active": F.coalesce("n_active", F.lit(0).cast("long")),
        "lists": F.coalesce("lists", F.lit("")),
    })
