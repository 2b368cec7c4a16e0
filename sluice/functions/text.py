"""Text rules with byte semantics: trim, ASCII case folding, slugs, shapes."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters trimmed from values and from headers.
VALUE_WHITESPACE = " \t\n\x0b\x0c\r"
HEADER_WHITESPACE = " \t\r\n"

UPPER = string.ascii_uppercase
LOWER = string.ascii_lowercase


def trim_ws(col: Column) -> Column:
    """Trim C-locale whitespace on both sides."""
    return F.btrim(col, F.lit(VALUE_WHITESPACE))


def trim_header(col: Column) -> Column:
    """Trim a column label (vertical tab and form feed stay)."""
    return F.btrim(col, F.lit(HEADER_WHITESPACE))


def ascii_lower(col: Column) -> Column:
    """Fold A-Z only; accented letters are left as they are."""
    return F.translate(col, UPPER, LOWER)


def ascii_upper(col: Column) -> Column:
    """Raise a-z only; also the payload transform applied by `uppercase` jobs."""
    return F.translate(col, LOWER, UPPER)


def slugify(col: Column) -> Column:
    """Lower-case, other characters collapse to one dash, none at the ends."""
    dashed = F.regexp_replace(ascii_lower(col), r"[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def none_if_blank(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def is_email(col: Column) -> Column:
    """One ``@``, a local part, and a domain whose first dot is interior."""
    return (col.rlike(r"^[^@]+@[^@.][^@.]*\.[^@]+\z")
            & F.octet_length(col).between(1, 320))


def is_sku(col: Column) -> Column:
    """Upper-case letters, digits, dash and underscore; 1 to 64 bytes."""
    return col.rlike(r"^[A-Z0-9_-]+\z") & (F.octet_length(col) <= 64)


def currency_code(col: Column) -> Column:
    """Trimmed upper-case code; absent or blank means US dollars."""
    return F.coalesce(none_if_blank(ascii_upper(trim_ws(col))), F.lit("USD"))


def is_currency(col: Column) -> Column:
    return col.rlike(r"^[A-Z]{3}\z")


def bounded_text(col: Column) -> Column:
    """Optional text: trimmed, blank becomes NULL (length is a separate rule)."""
    return none_if_blank(trim_ws(col))


def longer_than(col: Column, limit: int) -> Column:
    """True when the value takes more than ``limit`` bytes."""
    return F.octet_length(col) > limit


def is_uuid(col: Column) -> Column:
    return col.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")


def random_uuid() -> Column:
    """Version-4 identifier; write it out before using it twice."""
    return F.uuid()


def stable_uuid(*cols: Column) -> Column:
    """UUID-shaped identifier computed from its inputs.

    A re-run task or a replayed micro-batch yields the same id, which a random
    id would not.
    """
    text = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    digest = F.md5(F.concat_ws("\x1f", *text))
    return F.regexp_replace(
        digest, r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-8$3-a$4-$5")


def to_iso8601(col: Column) -> Column:
    """UTC text with milliseconds, truncated, and a trailing Z."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
