"""Column functions over text: whitespace handling, tokens, blank tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace when text is stripped, split or tested for being blank.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column: Column | str) -> Column:
    """Remove Unicode whitespace at both ends (a plain ``trim`` removes spaces only)."""
    return F.btrim(_col(column), F.lit(WHITESPACE))


def strip_left(column: Column | str) -> Column:
    """Much cheaper than :func:`strip`, which has to find the characters of the whole text to cut from its end."""
    return F.ltrim(_col(column), F.lit(WHITESPACE))


def is_blank(column: Column | str) -> Column:
    return strip_left(column) == F.lit("")


def split_whitespace(column: Column | str) -> Column:
    """Array of the non-empty pieces between runs of whitespace."""
    pieces = F.split(_col(column), f"[{WHITESPACE}]+")
    return F.filter(pieces, lambda piece: piece != F.lit(""))


def universal_newlines(column: Column | str) -> Column:
    """Turn ``\\r\\n`` and lone ``\\r`` into ``\\n``, as reading in text mode does."""
    text = _col(column)
    return F.when(text.contains("\r"), F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n"))).otherwise(text)
