"""Strict number parsing: no leading plus, no suffix, no silent overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL_TEXT = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
NON_FINITE_TEXT = r"^-?(?i)(inf|infinity|nan(\([a-z0-9_]*\))?)\z"
INTEGER_TEXT = r"^-?[0-9]+\z"

MAX_PRICE = 10_000_000
MAX_STOCK = 10_000_000


def has_excess_decimals(text: Column) -> Column:
    """More than two bytes follow the first dot."""
    whole = F.substring_index(text, ".", 1)
    return F.octet_length(text) - F.octet_length(whole) - 1 > 2


def strict_double(text: Column) -> Column:
    """Double, or NULL when the text is not a plain number in range.

    Overflow to infinity and underflow of a non-zero mantissa to zero count as
    out of range.
    """
    value = text.try_cast("double")
    overflow = value.isin(float("inf"), float("-inf"))
    underflow = (value == 0) & F.regexp_replace(text, r"[eE].*$", "").rlike("[1-9]")
    return F.when(text.rlike(DECIMAL_TEXT) & ~overflow & ~underflow, value)


def is_price_number(text: Column) -> Column:
    """The text reads as a number, finite or not."""
    return strict_double(text).isNotNull() | text.rlike(NON_FINITE_TEXT)


def parse_price(text: Column) -> Column:
    """Price of trimmed text as decimal(12,2); NULL when any price rule fails."""
    value = strict_double(text)
    ok = ~has_excess_decimals(text) & value.between(0, MAX_PRICE)
    return F.when(ok, value.cast("decimal(12,2)"))


def strict_long(text: Column) -> Column:
    """Signed 64-bit integer, or NULL when the text is not one."""
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint"))


def parse_stock(text: Column) -> Column:
    """Stock of trimmed text; absent or blank is zero, out of range is NULL."""
    blank = text.isNull() | (text == "")
    value = strict_long(text)
    return F.when(blank, F.lit(0).cast("bigint")).when(value.between(0, MAX_STOCK), value)


def format_price(price: Column) -> Column:
    """Two-decimal text."""
    return price.cast("decimal(12,2)").cast("string")
