"""Incremental indexing as joins: what changed between two states, and replacing what changed in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelode.tables import latest


def branch_state(manifest: DataFrame, branch: str) -> DataFrame:
    """(path, file_hash) of a branch, as last recorded. A null hash is kept: it equals no content."""
    own = manifest.where((F.col("branch") == branch) & F.col("path").isNotNull())
    return latest(own.select("path", "file_hash", "recorded_at"), ["path"], "recorded_at").select("path", "file_hash")


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, previous_hash, file_hash, status): added, changed, deleted or unchanged. Both sides: (path, file_hash), one
    row per path. A null hash on both sides is no change."""
    joined = previous.select("path", F.col("file_hash").alias("previous_hash"), F.lit(True).alias("was")).join(
        current.select("path", "file_hash", F.lit(True).alias("is")), "path", "full_outer"
    )
    status = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "deleted")
        .when(F.equal_null("previous_hash", "file_hash"), "unchanged")
        .otherwise("changed")
    )
    return joined.select("path", "previous_hash", "file_hash", status.alias("status"))


def upsert(base: DataFrame, new: DataFrame, key: str = "segment_hash") -> DataFrame:
    """The base without the rows whose key comes anew, and all new rows: repeated ones within the batch stay.

    Rows of the base with a null key stay, as nothing is equal to null.
    """
    return base.join(new.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(new)


def delete_by_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """The chunks whose file is not among the paths (one column ``path``)."""
    return chunks.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").select(*chunks.columns)
