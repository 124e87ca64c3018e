"""Spark types, their business-friendly labels, and the kinds the profiler treats alike."""

from __future__ import annotations

from pyspark.sql import types as T

# Label per Spark type.
LABELS: dict[type, str] = {
    T.ByteType: "Whole Number",
    T.ShortType: "Whole Number",
    T.IntegerType: "Whole Number",
    T.LongType: "Whole Number",
    T.FloatType: "Decimal Number",
    T.DoubleType: "Decimal Number",
    T.DecimalType: "Decimal Number",
    T.StringType: "Text",
    T.VarcharType: "Text",
    T.CharType: "Text",
    T.BooleanType: "True / False",
    T.TimestampType: "Date & Time",
    T.TimestampNTZType: "Date & Time",
    T.DateType: "Date & Time",
    T.DayTimeIntervalType: "Time Duration",
    T.YearMonthIntervalType: "Interval",
    T.NullType: "Empty",
    T.VariantType: "Mixed Types",
    T.ArrayType: "Nested",
    T.MapType: "Nested",
    T.StructType: "Nested",
}

_CUSTOM: dict[str, str] = {}


def label(dtype: T.DataType) -> str:
    """Human-readable label of a Spark type; ``Unknown`` when there is none."""
    return _CUSTOM.get(dtype.simpleString()) or LABELS.get(type(dtype), "Unknown")


def add_label(simple_string: str, text: str) -> None:
    """Register a label for a type by its ``simpleString()``."""
    _CUSTOM[simple_string] = text


def kind(dtype: T.DataType) -> str:
    """Columns of one kind share one unpivoted value table."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return dtype.simpleString()
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "nested"


def family(dtype: T.DataType) -> str:
    """Numeric / DateTime / Text / Other."""
    if isinstance(dtype, T.NumericType):
        return "Numeric"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "DateTime"
    if kind(dtype) == "text":
        return "Text"
    return "Other"


def is_text(dtype: T.DataType) -> bool:
    return kind(dtype) == "text"


def text_columns(df) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def numeric_columns(df) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
