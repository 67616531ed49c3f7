"""Hash values in their textual forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hex64(col: str | Column) -> Column:
    """A 64-bit value spelled in hexadecimal as its BIGINT bit pattern; null for anything else.

    Case, blanks around it, a 0x prefix and missing or extra leading zeros don't matter.
    """
    c = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_extract(c, r"^\s*(?:0[xX])?0*([0-9a-fA-F]{1,16})\s*$", 1)
    return F.when(digits != "", F.conv(digits, 16, -10).cast("bigint"))


def hex_text(col: str | Column) -> Column:
    """A BIGINT bit pattern as 16 lower-case hexadecimal digits."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lpad(F.lower(F.hex(c)), 16, "0")
