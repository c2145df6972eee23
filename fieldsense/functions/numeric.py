"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_numeric(col: Column, scale: int = 2) -> Column:
    """Round half away from zero at ``scale`` digits after passing through a
    decimal, as ``round(x::numeric, 2)`` does; returned as double.

    Rounding the double directly disagrees with other engines on values
    whose binary form sits just under a half; the decimal detour does not.
    """
    return F.round(col.cast("decimal(38,12)"), scale).cast("double")


def round_to_short(col: Column) -> Column:
    """``x::smallint`` of a fractional value: round half away from zero
    (a bare cast would truncate)."""
    return F.round(col.cast("double")).cast("smallint")


#: Decimal notation with an optional exponent; no suffixes, hex forms or names.
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_REAL_MAX = 3.4028235677973366e38


def decimal_number(text: Column) -> Column:
    """The number that a text writes in decimal notation (infinite where a
    double holds none so large), else NULL. Inside a lambda function every use of
    an expression evaluates it anew, so there this comes first, as a field of its
    own, and the range check after it."""
    return F.when(text.rlike(_DECIMAL), F.trim(text).try_cast("double"))


def real_within(number: Column) -> Column:
    """The number if a 4-byte float holds it without becoming infinite, else NULL."""
    return F.when(F.abs(number) < F.lit(_REAL_MAX), number)


def integer_within(number: Column, low: int, high: int) -> Column:
    """The number if whole and within ``low`` and ``high``, else NULL."""
    return F.when((number == F.floor(number)) & (number >= low) & (number <= high), number)


def finite_number(text: Column) -> Column:
    """The number that a text writes in decimal notation, if finite, else NULL."""
    d = decimal_number(text)
    return F.when(F.abs(d) != F.lit(float("inf")), d)


def real_number(text: Column) -> Column:
    """The same, if a 4-byte float holds it without becoming infinite."""
    return real_within(decimal_number(text))


def integer_in(text: Column, low: int, high: int) -> Column:
    """The whole number that a text writes, if within ``low`` and ``high``, else NULL."""
    return integer_within(decimal_number(text), low, high)


#: How an integer column's text is written: no point, no exponent.
_INTEGER = r"^\s*[+-]?\d+\s*$"


def integer_text(text: Column, low: int, high: int) -> Column:
    """The integer that a text writes as an integer column reads it, if within
    ``low`` and ``high``, else NULL: ``1.0`` and ``1e2`` are no integers there."""
    d = F.when(text.rlike(_INTEGER), F.trim(text).try_cast("decimal(38,0)"))
    return F.when((d >= F.lit(low)) & (d <= F.lit(high)), d)
