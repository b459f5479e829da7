"""Identities of files and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trovelode.functions.text import utf16_length


def file_hash(content: Column) -> Column:
    """SHA-256 of the content, as hex; null for null."""
    return F.sha2(content, 256)


def segment_hash(path: Column, start_line: Column, end_line: Column, content: Column) -> Column:
    """SHA-256 of path, line range, length in UTF-16 units and the first 100 characters, joined by hyphens."""
    return F.sha2(F.concat_ws("-", path, start_line, end_line, utf16_length(content), F.substring(content, 1, 100)), 256)
