"""Merkle manifest of a dataset: leaves, one tree a group, one tree over the groups.

A node is 64 hex digits. Nodes of a group are numbered and cut into aligned
blocks of ``arity ** height``. A block keeps each of its levels as one string of
joined digits, so that parents are hashes of fixed-width substrings, and what
flanks a node within its run of siblings is its step of a proof. The last level
of a block is one node; these are the nodes of the next round, until a group has
one block only. The roots of the groups are then the nodes of one more tree.

Everything is Spark SQL. Rows of the table are moved twice, as digests without
texts: once to be numbered, by ranges of (group, order), and once to their
blocks. From there on there is one row a block, in each round as many times less,
and a group, however large, is never in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGITS = 64


def leaf_of(*values: Column) -> Column:
    """Digest of the values in order, each as its length in bytes, a colon and itself, or a dash for null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and the flanks on its path."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step.left, node, step.right), 256))


def siblings(path: Column) -> Column:
    """The digests that flank the path, level by level, left to right, as one string."""
    return F.array_join(F.transform(path, lambda step: F.concat(step.left, step.right)), "")


def _numbered(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Nodes with ``index`` (in order within their group, from 0) and ``size`` of the group; the largest size."""
    ordered = nodes.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    ordered = ordered.withColumn("shard", F.shiftright("at", 33))
    # at most one row for each file and one more for each group
    runs = ordered.groupBy("group", "shard").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = stored(runs.selectExpr(
        "group", "shard",
        "coalesce(sum(n) OVER (PARTITION BY group ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first AS shift",
        "sum(n) OVER (PARTITION BY group) AS size"), "merkle-runs")
    most = runs.agg(F.max("size")).first()[0] or 0
    placed = ordered.join(runs, ["group", "shard"])
    return placed.withColumn("index", F.col("at") + F.col("shift")).drop("at", "shard", "shift"), most


def _parents(level: Column, arity: int) -> Column:
    """The level above, as bytes of joined hex digits: a hash for each run of siblings, the last one maybe shorter."""
    run = arity * _DIGITS
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / run).cast("int") - 1)
    one = lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)
    return F.array_join(F.transform(runs, one), "").cast("binary")


def _blocks(nodes: DataFrame, payload: list[str], arity: int, height: int) -> DataFrame:
    """group, block, size, items (index, digest, payload), levels of each block; the only level of a lone node is itself."""
    width = arity**height
    item = F.struct("index", "digest", *payload)
    block = F.expr(f"index DIV {width}").alias("block")
    grouped = nodes.groupBy("group", block, "size").agg(F.sort_array(F.collect_list(item)).alias("items"))
    first = F.array(F.array_join(F.transform("items", lambda x: x.digest), "").cast("binary"))

    def higher(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        done = (F.col("size") <= width) & (F.length(last) == _DIGITS)
        return F.when(done, levels).otherwise(F.concat(levels, F.array(_parents(last, arity))))

    return grouped.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(height)), first, higher))


def _climbed(nodes: DataFrame, payload: list[str], most: int, arity: int, height: int) -> list[DataFrame]:
    """The blocks of each round. A group's last round is that in which it has one block."""
    width, rounds = arity**height, []
    while True:
        blocks = stored(_blocks(nodes, payload, arity, height), "merkle-blocks")
        rounds.append(blocks)
        if most <= width:
            return rounds
        most, payload = -(-most // width), []
        nodes = blocks.filter(F.col("size") > width).select(
            "group", F.col("block").alias("index"), F.expr(f"(size + {width - 1}) DIV {width}").alias("size"), _top("levels").alias("digest"))


def _top(levels: str) -> Column:
    return F.element_at(levels, -1).cast("string")


def _flanks(level: Column, place: Column, arity: int) -> Column:
    """What lies left and right of a node within its run of siblings."""
    run = place - place % arity
    cut = lambda at, n: F.substring(level, at * _DIGITS + 1, n * _DIGITS).cast("string")
    return F.struct(cut(run, place - run).alias("left"), cut(place + 1, run + arity - place - 1).alias("right"))


def _descended(rounds: list[DataFrame], ends: DataFrame, payload: list[str], arity: int, height: int) -> DataFrame:
    """Payload, digest, path and the columns of ``ends`` for each node of the first round.

    ``ends`` has one row a group: the path that goes on above the group's root, and more columns.
    """
    width, more = arity**height, [c for c in ends.columns if c not in ("group", "path")]
    above = None
    for blocks in reversed(rounds):
        placed = blocks.filter(F.col("size") <= width).join(ends, "group")
        if above is not None:
            inner = blocks.filter(F.col("size") > width).join(above.drop("item"), ["group", "block"])
            placed = placed.unionByName(inner)
        below = F.slice("levels", 1, F.size("levels") - 1)

        def steps(place: Column, below: Column = below) -> Column:
            at = lambda k: F.call_function("div", place, F.pow(F.lit(arity), k).cast("int")).cast("int")
            return F.transform(below, lambda level, k: _flanks(level, at(k), arity))

        rows = F.transform("items", lambda x, place: F.struct(x.alias("item"), F.concat(steps(place), F.col("path")).alias("path")))
        above = placed.select("group", F.explode(rows).alias("row"), *more).select(
            "group", F.col("row.item.index").alias("block"), "row.item", "row.path", *more)
    return above.select(*(F.col(f"item.{c}").alias(c) for c in ("digest", *payload)), "path", *more)


def manifest(
    docs: DataFrame, id_column: str = "doc_id", group_column: str = "lang", fields: tuple[str, ...] = FIELDS,
    claimed: dict[str, Column] | None = None, arity: int = 2, height: int = 10,
) -> DataFrame:
    """doc_id, leaf, claimed_leaf, path, subroot, root of every row.

    A leaf is the digest of ``fields``. Leaves of a group stand in order of their
    id (null first), then of their digest, so that of rows with one id each keeps a
    place that does not depend on the layout; groups stand in order of the UTF-8
    bytes of their name, null first. Every run of ``arity`` nodes, also a shorter
    one at the end, has its hash as parent, until one node is left; a lone node is
    the root itself. ``path`` has the flanks (left, right) of each level, those
    above the group's root included.

    ``claimed`` replaces columns before ``claimed_leaf`` is taken, which is the leaf
    of a row as somebody else has it; ``folded(path, claimed_leaf)`` is the root
    only if both are equal. Null values, also of the group, are dashes, empty texts
    are ``0:``, texts of any length are hashed whole. An empty table gives no rows;
    columns that are not named here are not read, whatever their names.
    ``height`` only decides how many nodes a block holds (``arity ** height``).
    """
    told = claimed or {}
    values, others = [F.col(c) for c in fields], [told.get(c, F.col(c)) for c in fields]
    name = F.col(group_column).cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("-")).alias("group"),  # bytewise order, null first
        F.col(id_column).cast("long").alias("doc_id"), leaf_of(*values).alias("digest"), leaf_of(*others).alias("claimed_leaf"))
    # the row number splits rows that are equal in all else
    leaves = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    payload = ["doc_id", "claimed_leaf"]
    nodes, most = _numbered(leaves, ["doc_id", "digest", "row"])
    rounds = _climbed(nodes, payload, most, arity, height)
    width = arity**height
    roots = reduce(DataFrame.unionByName, [b.filter(F.col("size") <= width).select("group", _top("levels").alias("subroot")) for b in rounds])
    roots = stored(roots.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("subroot").alias("digest")), "merkle-roots")
    groups, most = _numbered(roots, ["name"])
    top = _climbed(groups, ["name"], most, arity, height)
    nowhere = F.array().cast("array<struct<left:string,right:string>>")
    root = top[-1].select("group", nowhere.alias("path"), _top("levels").alias("root"))
    ends = _descended(top, root, ["name"], arity, height).select(
        F.col("name").alias("group"), "path", F.col("digest").alias("subroot"), "root")
    return _descended(rounds, ends, payload, arity, height).select(
        "doc_id", F.col("digest").alias("leaf"), "claimed_leaf", "path", "subroot", "root")


def verified(rows: DataFrame) -> DataFrame:
    """Rows of a manifest with proof_sha256, folded_root and verified in place of claimed_leaf and path."""
    folding = folded(F.col("path"), F.col("claimed_leaf")).alias("folded_root")
    proof = F.sha2(siblings(F.col("path")), 256).alias("proof_sha256")
    found = rows.select("doc_id", "leaf", "subroot", "root", proof, folding)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
