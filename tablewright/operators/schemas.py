"""Schema snapshots, drift against a reference, and the way back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Snapshot, as_snapshot, col, parse_type, rows_from_structs, snapshot


@dataclass(frozen=True)
class Drift:
    """What differs between a table and its reference. Nullability does not count."""

    added: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()
    changed: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def issue_count(self) -> int:
        return len(self.added) + len(self.removed) + len(self.changed)


def find_drift(current: Snapshot, reference: Snapshot) -> Drift:
    shared = sorted(current.keys() & reference.keys())
    pairs = {
        c: (str(reference[c]["data_type"]), str(current[c]["data_type"])) for c in shared
    }
    return Drift(
        tuple(sorted(current.keys() - reference.keys())),
        tuple(sorted(reference.keys() - current.keys())),
        {c: p for c, p in pairs.items() if p[0] != p[1]},
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, nullability, and how many rows hold a value."""
    counts = df.agg(*[F.count(col(f.name)).alias(f"n_{i}") for i, f in enumerate(df.schema.fields)])
    return rows_from_structs(
        counts,
        [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.nullable).alias("nullable"),
                F.col(f"n_{i}").alias("value_count"),
            )
            for i, f in enumerate(df.schema.fields)
        ],
    )


def schema_drift(df: DataFrame, reference) -> DataFrame:
    """One row per difference, with the values a cast back would lose.

    ``lost_values`` counts non-null values that do not read as the reference
    type; it is what casting the column back turns into nulls.
    """
    current, wanted = snapshot(df.schema), as_snapshot(reference)
    drift = find_drift(current, wanted)
    counts = [F.count(F.lit(1)).alias("rows")]
    entries = []
    for c in drift.added:
        entries.append(("added", c, None, str(current[c]["data_type"]), None))
    for c in drift.removed:
        entries.append(("removed", c, str(wanted[c]["data_type"]), None, None))
    for i, (c, (was, now)) in enumerate(drift.changed.items()):
        counts.append(F.count_if(loses_value(c, was)).alias(f"lost_{i}"))
        entries.append(("type_change", c, was, now, f"lost_{i}"))
    if not entries:
        return df.sparkSession.createDataFrame([], _TABLE)
    return rows_from_structs(
        df.agg(*counts),
        [
            F.struct(
                F.lit(kind).alias("change"),
                F.lit(c).alias("column"),
                F.lit(was).cast("string").alias("reference_type"),
                F.lit(now).cast("string").alias("current_type"),
                F.coalesce(F.col(lost) if lost else F.lit(None).cast("bigint"), F.lit(0)).alias("lost_values"),
                F.col("rows").alias("row_count"),
            )
            for kind, c, was, now, lost in entries
        ],
    )


_TABLE = (
    "change string, column string, reference_type string, current_type string, "
    "lost_values bigint, row_count bigint"
)


def loses_value(name: str, data_type: str) -> Column:
    return col(name).isNotNull() & cast_to(col(name), data_type).isNull()


def cast_to(value: Column, data_type: str) -> Column:
    """A cast that gives null where the value does not fit, ANSI mode or not."""
    return value.try_cast(parse_type(data_type))


def align(df: DataFrame, reference, drop_added: bool = False) -> DataFrame:
    """Cast changed columns back, add missing ones as nulls, drop added ones on request.

    One projection: columns keep their places, added nulls come last.
    """
    current, wanted = snapshot(df.schema), as_snapshot(reference)
    drift = find_drift(current, wanted)
    kept = [
        cast_to(col(c), drift.changed[c][0]).alias(c) if c in drift.changed else col(c)
        for c in df.columns
        if not (drop_added and c in drift.added)
    ]
    restored = [
        F.lit(None).cast(parse_type(str(wanted[c]["data_type"]))).alias(c) for c in drift.removed
    ]
    return df.select(*kept, *restored)
