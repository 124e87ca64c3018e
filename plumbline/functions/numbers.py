"""Column expressions for numbers: NaN handling, strict parsing of numeric text, decimals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from plumbline.functions.text import strip

_NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE_TEXT = r"^[+-]?(?i:inf|infinity)$"


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers in the profiling sense; booleans are not numbers."""
    return isinstance(dtype, T.NumericType)


def clean(c: Column, dtype: T.DataType) -> Column:
    """NaN becomes NULL; everything else is unchanged."""
    return F.when(~F.isnan(c), c) if is_float(dtype) else c


def to_number(c: Column, dtype: T.DataType | None = None) -> Column:
    """A double, or NULL where the text is not a number.

    Spark's own cast accepts texts such as ``5d``; here a numeric shape is required first.
    """
    if dtype is not None and is_numeric(dtype):
        return clean(c, dtype).cast("double")
    s = strip(c.cast("string"))
    infinite = F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(s.rlike(_NUMERIC_TEXT), s.try_cast("double")).when(s.rlike(_INFINITE_TEXT), infinite)


def _places(c: Column) -> Column:
    """How many decimals 15 significant digits leave."""
    return F.when(c == 0, 0).otherwise(F.least(F.lit(15), F.greatest(F.lit(0), 14 - F.floor(F.log10(F.abs(c))))))


def decimal_text(c: Column) -> Column:
    """A double as plain decimal text (1e7 -> ``10000000``), rounded to 15 significant digits."""
    scale = F.pow(F.lit(10.0), _places(c))
    rounded = F.rint(c * scale) / scale
    return F.regexp_replace(rounded.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")


def decimal_places(c: Column) -> Column:
    """How many decimals a double shows with 15 significant digits."""
    text = decimal_text(c)
    return F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(F.lit(0))


def more_decimals(c: Column, most: int) -> Column:
    """``decimal_places(c) > most`` without a text: the 15 digits as a whole number, which a double holds exactly, do not end
    in as many zeros as there are places too many."""
    places = _places(c)
    return F.coalesce((places > most) & (F.rint(c * F.pow(F.lit(10.0), places)) % F.pow(F.lit(10.0), places - most) != 0), F.lit(False))


def pct(part: Column, whole: Column) -> Column:
    """Share in percent; 0 when the whole is empty."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def plain_text(c: Column, dtype: T.DataType) -> Column:
    """A value as people write it: doubles without exponents, everything else as cast by Spark."""
    if not is_float(dtype):
        return c.cast("string")
    c = clean(c, dtype)
    wide = F.regexp_replace(c.try_cast("decimal(38,10)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    # below 1e-3 a double's shortest text has an exponent: its digits move behind as many zeros
    digits = F.regexp_replace(F.regexp_replace(c.cast("string"), r"E.*|[-.]", ""), "0+$", "")
    zeros = F.repeat(F.lit("0"), F.substring_index(c.cast("string"), "E-", -1).try_cast("int") - 1)
    wide = F.when(F.abs(c) < 1e-3, F.concat(F.when(c < 0, "-").otherwise(""), F.lit("0."), zeros, digits)).otherwise(wide)
    usual = (c == 0) | (F.abs(c) < 1e7) & (F.abs(c) >= 1e-3)
    return F.when(usual, c.cast("string")).otherwise(F.coalesce(wide, c.cast("string")))
