"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units (a character outside the BMP counts two); null for null."""
    astral = F.length(text) - F.length(F.regexp_replace(text, "[\\x{10000}-\\x{10FFFF}]", ""))
    # Only a text with bytes of four-byte characters can have any; the others skip the scan.
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(F.length(text) + astral)


def lines_of(text: Column) -> Column:
    """Array of the lines, which end at line feeds; a text that ends with one has an empty last line."""
    return F.split(text, "\n", -1)


def blank_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
