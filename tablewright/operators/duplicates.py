"""Duplicate rows, duplicate keys and key skew, all from counted groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grades
from ..functions.columns import SETS_AT_ONCE, col, comparable, is_binary_text, is_nested, needs_canonical_form, ratio
from ..functions.draws import row_hash

FINGERPRINT = ("__fp_a", "__fp_b")
_BROADCAST_GROUPS = 500_000


def group_columns(df: DataFrame) -> list[Column]:
    """Every column in a form that can be grouped on."""
    return [
        comparable(col(f.name), f.dataType).alias(f"g{i}")
        for i, f in enumerate(df.schema.fields)
    ]


def _graded(frame: DataFrame, count: str, rows: str) -> DataFrame:
    share = ratio(F.col(count), F.col(rows))
    return frame.withColumn("duplicate_ratio", share).withColumn(
        "severity", grades.DUPLICATES.column(F.col("duplicate_ratio"))
    )


def exact_duplicates(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, and how many rows repeat an earlier one.

    Copies collapse in the map-side aggregate before the shuffle, so a group of
    copies of any size reaches a reducer as at most one row per input task.
    """
    groups = df.groupBy(*group_columns(df)).agg(F.count(F.lit(1)).alias("copies"))
    counted = groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_count"),
    ).withColumn("duplicate_count", F.col("row_count") - F.col("distinct_count"))
    return _graded(counted, "duplicate_count", "row_count")


def can_fingerprint(df: DataFrame) -> bool:
    """Whether equal rows have equal hashes and others all but surely not.

    So it is for flat schemas whose texts compare byte by byte. Collated texts
    that are equal may differ in bytes and so in their hashes.
    """
    return all(is_binary_text(f.dataType) and not is_nested(f.dataType) for f in df.schema.fields)


def fingerprint(df: DataFrame) -> list[Column]:
    """Two independent 64-bit row hashes. Equal rows always have equal ones."""
    return [row_hash(df, salt).alias(name) for salt, name in enumerate(FINGERPRINT, 1)]


def exact_duplicate_count(df: DataFrame, suspect_groups: int) -> int:
    """Exact number of repeated rows, given how many fingerprints repeat.

    A row whose fingerprint is unique is unique itself. So only rows under a
    repeated fingerprint are compared in full. When those fingerprints are few,
    they are broadcast and the table is filtered in place, and only the suspects
    are shuffled. When they are many, the whole rows are grouped.
    """
    if suspect_groups == 0:
        return 0
    if suspect_groups > _BROADCAST_GROUPS:
        return exact_duplicates(df).first()["duplicate_count"]
    # The hashes come last: Spark tracks equalities between an expression and the
    # aliases after it, and a hash of all columns has very many.
    hashed = df.select("*", *fingerprint(df))
    repeated = (
        hashed.groupBy(*FINGERPRINT).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select(*FINGERPRINT)
    )
    suspects = hashed.join(F.broadcast(repeated), list(FINGERPRINT), "left_semi")
    extra = suspects.groupBy(*map(col, df.columns)).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return extra.agg(F.coalesce(F.sum("extra"), F.lit(0))).first()[0]


def group_census(df: DataFrame, key_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Count the groups of many column sets, sixteen in one scan and one shuffle.

    One row per set: number of groups, rows, groups and rows with more than one
    member, largest and median group. The sets become GROUPING SETS, and partial
    counts shrink a hot key to one row per task before the shuffle. A set of many
    columns is grouped on its own.

    The median of the group sizes is exact. Its buffer holds distinct sizes, and
    n rows cannot have more than sqrt(2n) of those.
    """
    sets = {name: tuple(dict.fromkeys(columns)) for name, columns in key_sets.items()}
    wanted: dict[frozenset[str], list[str]] = {}
    for name, columns in sets.items():
        wanted.setdefault(frozenset(columns), []).append(name)
    wide = [[chosen] for chosen in wanted if len(chosen) > SETS_AT_ONCE]
    rest = sorted((chosen for chosen in wanted if len(chosen) <= SETS_AT_ONCE), key=lambda c: (len(c), sorted(c)))
    parts, columns = [], set()
    for chosen in rest:
        if not parts or len(parts[-1]) == SETS_AT_ONCE or len(columns | chosen) > 2 * SETS_AT_ONCE:
            parts.append([])
            columns = set()
        parts[-1].append(chosen)
        columns |= chosen
    tables = [_count_sets(df, {c: wanted[c] for c in part}) for part in [*wide, *parts]]
    return reduce(DataFrame.unionByName, tables)


def _count_sets(df: DataFrame, wanted: Mapping[frozenset[str], Sequence[str]]) -> DataFrame:
    columns = sorted({c for chosen in wanted for c in chosen})
    types = {f.name: f.dataType for f in df.schema.fields}
    alias = {c: f"k{i}" for i, c in enumerate(columns)}
    keyed = df.select(*[comparable(col(c), types[c]).alias(a) for c, a in alias.items()])
    left_out = {c: 1 << len(columns) - 1 - i for i, c in enumerate(columns)}
    mark = {chosen: sum(bit for c, bit in left_out.items() if c not in chosen) for chosen in wanted}
    if len(wanted) == 1:
        grouped, which = keyed.groupBy(*alias.values()), F.lit(0).cast("bigint")
    else:
        grouped = keyed.groupingSets(
            [[F.col(alias[c]) for c in columns if c in chosen] for chosen in wanted],
            *[F.col(a) for a in alias.values()],
        )
        which = F.grouping_id()
    groups = grouped.agg(which.alias("mark"), F.count(F.lit(1)).alias("members"))
    repeated = F.when(F.col("members") > 1, F.col("members"))
    sizes = groups.groupBy("mark").agg(
        F.count(F.lit(1)).alias("group_count"),
        F.sum("members").alias("row_count"),
        F.count(repeated).alias("duplicate_group_count"),
        F.coalesce(F.sum(repeated), F.lit(0)).alias("duplicate_row_count"),
        F.max("members").alias("max_count"),
        F.expr("percentile_disc(0.5) within group (order by members)").alias("median_count"),
    )
    pairs = ((F.lit(mark[chosen]).cast("bigint"), F.array(*map(F.lit, names))) for chosen, names in wanted.items())
    names = F.create_map(*(x for pair in pairs for x in pair))
    return sizes.select(
        F.explode(F.try_element_at(names, F.col("mark").cast("bigint"))).alias("key_set"),
        *[c for c in sizes.columns if c != "mark"],
    )


def as_key_duplicates(census: DataFrame) -> DataFrame:
    counted = census.select(
        "key_set",
        "row_count",
        "duplicate_group_count",
        "duplicate_row_count",
        (F.col("duplicate_row_count") - F.col("duplicate_group_count")).alias(
            "duplicate_excess_count"
        ),
    )
    return _graded(counted, "duplicate_row_count", "row_count")


def as_key_skew(census: DataFrame) -> DataFrame:
    skew_ratio = F.try_divide(F.col("max_count").cast("double"), F.col("median_count").cast("double"))
    return census.select(
        "key_set", "group_count", "max_count", "median_count", skew_ratio.alias("skew_ratio")
    ).withColumn("severity", grades.SKEW.column(F.col("skew_ratio")))


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: groups and rows sharing a value. Null counts as a value.

    Keys the table lacks give a row with an ``error`` instead of a failure.
    """
    known = [k for k in dict.fromkeys(keys) if k in df.columns]
    lacking = [k for k in dict.fromkeys(keys) if k not in df.columns]
    table = None
    if known:
        census = group_census(df, {k: [k] for k in known})
        table = as_key_duplicates(census).withColumnRenamed("key_set", "key")
        table = table.withColumn("error", F.lit(None).cast("string"))
    if lacking:
        errors = df.sparkSession.createDataFrame(
            [(k, missing_column_message(k)) for k in lacking], "key string, error string"
        )
        table = errors if table is None else table.unionByName(errors, allowMissingColumns=True)
    return table


def composite_key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups and rows sharing the whole key. Needs two or more known columns."""
    known = [k for k in dict.fromkeys(keys) if k in df.columns]
    if len(known) < 2:
        raise ValueError("A composite key needs at least two known columns.")
    name = ",".join(known)
    return as_key_duplicates(group_census(df, {name: known})).withColumnRenamed("key_set", "key")


def key_skew(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: largest group over median group."""
    known = [k for k in dict.fromkeys(keys) if k in df.columns]
    return as_key_skew(group_census(df, {k: [k] for k in known})).withColumnRenamed("key_set", "key")


def missing_column_message(name: str) -> str:
    return f"The table has no column '{name}'."


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows; works with map columns too."""
    helpers = {
        f"__cmp_{i}": comparable(col(f.name), f.dataType)
        for i, f in enumerate(df.schema.fields)
        if needs_canonical_form(f.dataType)
    }
    if not helpers:
        return df.dropDuplicates()
    plain = [f.name for f in df.schema.fields if not needs_canonical_form(f.dataType)]
    return df.withColumns(helpers).dropDuplicates(plain + list(helpers)).drop(*helpers)


def drop_duplicates_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep, per key, the row that sorts first by all its other columns.

    A min-aggregate rather than a ranked window: it combines before the shuffle,
    so a key with a third of all rows costs no more than any other.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    rest = [c for c in df.columns if c not in set(keys)]
    group = [comparable(col(k), types[k]).alias(f"k{i}") for i, k in enumerate(keys)]
    if not rest:
        return drop_duplicates(df)
    whole = F.struct(*[col(c).alias(f"f{i}") for i, c in enumerate(df.columns)])
    order = F.struct(*[comparable(col(c), types[c]).alias(f"o{i}") for i, c in enumerate(rest)])
    if any(needs_canonical_form(types[c]) for c in df.columns):
        kept = F.min_by(whole, order)
        fields = [F.col("kept").getField(f"f{i}").alias(c) for i, c in enumerate(df.columns)]
        return df.groupBy(*group).agg(kept.alias("kept")).select(*fields)
    smallest = F.min(order).alias("kept")
    place = {c: F.col("kept").getField(f"o{i}") for i, c in enumerate(rest)}
    place |= {k: F.col(f"k{i}") for i, k in enumerate(keys)}
    return df.groupBy(*group).agg(smallest).select(*[place[c].alias(c) for c in df.columns])
