"""Byte semantics in Column form: ASCII folding, one character per byte, byte lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(s: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(s, UPPER, LOWER)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def bytes_view(s: Column) -> Column:
    """One character for each UTF-8 byte, so that lengths and places count bytes."""
    return F.decode(s.cast("binary"), "ISO-8859-1")


def bytes_text(s: str) -> str:
    return s.encode().decode("latin-1")


def text_view(s: Column) -> Column:
    """The text whose bytes these are; a cut sequence gives a replacement character."""
    return F.decode(F.encode(s, "ISO-8859-1"), "UTF-8")


def sub(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """substring() from a 1-based place that may be a column."""
    start = start if isinstance(start, Column) else F.lit(start)
    if length is None:
        return F.substring(s, start, F.lit(1 << 30))
    return F.substring(s, start, length if isinstance(length, Column) else F.lit(length))
