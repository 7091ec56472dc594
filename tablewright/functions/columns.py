"""Type families and small column expressions shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Snapshot = dict[str, dict[str, object]]

#: Column sets counted in one job. GROUPING SETS copy each row once a set, and end at 64 columns.
SETS_AT_ONCE = 16


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def has_nan(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def is_binary_text(data_type: T.DataType) -> bool:
    """Whether equal texts of the type are equal byte by byte; collations may fold case or accents."""
    return not is_text(data_type) or data_type.collation == "UTF8_BINARY"


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(
        data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    )


def parse_type(text: str) -> T.DataType:
    return T.DataType.fromDDL(text)


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if is_numeric(f.dataType)]


def text_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if is_text(f.dataType)]


def snapshot(schema: T.StructType) -> Snapshot:
    return {
        f.name: {"data_type": f.dataType.simpleString(), "nullable": f.nullable}
        for f in schema.fields
    }


def as_snapshot(reference: T.StructType | Mapping | None) -> Snapshot | None:
    """Accept a reference schema as a ``StructType`` or as a snapshot dict."""
    if reference is None:
        return None
    if isinstance(reference, T.StructType):
        return snapshot(reference)
    return {name: dict(entry) for name, entry in reference.items()}


def present(value: Column, data_type: T.DataType) -> Column:
    """The value with NaN turned into null, so that "missing" is one test."""
    if has_nan(data_type):
        return F.when(~F.isnan(value), value)
    return value


def is_present(value: Column, data_type: T.DataType) -> Column:
    """Whether there is a value, in a form whose null test a scan can take over."""
    if has_nan(data_type):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def comparable(value: Column, data_type: T.DataType) -> Column:
    """A form of the value that can be grouped on.

    Maps cannot be grouped on, so they become entry lists in key order, at any
    depth. Everything else is left alone.
    """
    if isinstance(data_type, T.MapType):
        return F.transform(
            F.array_sort(F.map_keys(value)),
            lambda k: F.struct(
                k.alias("key"),
                comparable(F.try_element_at(value, k), data_type.valueType).alias("value"),
            ),
        )
    if isinstance(data_type, T.VariantType):
        return F.to_json(value)
    if not _holds_map(data_type):
        return value
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda v: comparable(v, data_type.elementType))
    return F.when(
        value.isNotNull(),
        F.struct(
            *[
                comparable(value.getField(f.name), f.dataType).alias(f.name)
                for f in data_type.fields
            ]
        ),
    )


def _holds_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return True
    if isinstance(data_type, T.ArrayType):
        return _holds_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(_holds_map(f.dataType) for f in data_type.fields)
    return False


def needs_canonical_form(data_type: T.DataType) -> bool:
    return _holds_map(data_type)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 when whole is 0."""
    return F.coalesce(
        F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)
    )


def rows_from_structs(one_row: DataFrame, structs: Iterable[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return one_row.select(F.inline(F.array(*structs)))
