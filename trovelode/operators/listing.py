"""Listings over the index: chunks, files, pages, counts. All filter and project in the scan and sort only what they return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovelode import config
from trovelode.functions.paths import under
from trovelode.functions.text import blank_as_null, utf16_length
from trovelode.tables import latest, numbered


def current_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """Each chunk once, as last delivered; chunks without ``segment_hash`` are left out. ``columns``: the ones to read
    besides the key; all if none are named."""
    chosen = chunks.select("segment_hash", "indexed_at", *columns) if columns else chunks
    return latest(chosen.where("segment_hash is not null"), ["segment_hash"], "indexed_at")


def current_files(files: DataFrame, *columns: str) -> DataFrame:
    """Each file once, as last delivered; files without path are left out. ``columns`` as in :func:`current_chunks`."""
    chosen = files.select("path", "scanned_at", *columns) if columns else files
    return latest(chosen.where("path is not null"), ["path"], "scanned_at")


def list_chunks(chunks: DataFrame, path: str | None = None, limit: int = 50) -> DataFrame:
    """Chunks of a path or prefix with their size, blank names as null; the limit is kept within 1..1000."""
    chosen = chunks if path is None else chunks.where(under(F.col("file_path"), path))
    return debug_rows(chosen).orderBy("file_path", "start_line", "segment_hash").limit(min(config.LIST_LIMIT_MAX, max(1, limit)))


def debug_rows(chunks: DataFrame) -> DataFrame:
    blank = [blank_as_null(F.col(c)).alias(c) for c in ("symbol", "parent_scope", "kind")]
    return chunks.select("segment_hash", "file_path", "start_line", "end_line", utf16_length(F.col("content")).alias("char_count"), *blank)


def list_files(chunks: DataFrame) -> DataFrame:
    """(file_path): distinct paths that aren't empty, sorted. Only the path column is read."""
    return chunks.where("file_path is not null and file_path != ''").select("file_path").distinct().orderBy("file_path")


def filter_names(files: DataFrame, text: str) -> DataFrame:
    """(path): files with the text in their path, whatever the case."""
    return files.where(F.contains(F.lower("path"), F.lit(text.lower()))).select("path").distinct()


def pages(chunks: DataFrame, size: int = 50) -> DataFrame:
    """(workspace, file_path, page, place): indexed files of each workspace in pages, from 1."""
    paths = chunks.where("file_path is not null and file_path != ''").select("workspace", "file_path").distinct()
    rows = numbered(paths, "workspace", ["file_path"]).withColumn("n", F.col("n") - 1)
    return rows.select(
        "workspace", "file_path", (F.floor(F.col("n") / size) + 1).cast("int").alias("page"), (F.col("n") % size + 1).cast("int").alias("place")
    )


def workspace_stats(workspaces: DataFrame, chunks: DataFrame) -> DataFrame:
    """(workspace, status, file_count, chunk_count, n_pages): what a dashboard shows of each workspace."""
    counts = chunks.groupBy("workspace").agg(
        F.count_distinct("file_path").alias("file_count"), F.count_distinct("segment_hash").alias("chunk_count")
    )
    known = workspaces.select("workspace").join(counts, "workspace", "left")
    return known.select(
        "workspace",
        F.when(F.col("chunk_count") > 0, "indexed").otherwise("standby").alias("status"),
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.ceil(F.coalesce("file_count", F.lit(0)) / 50).alias("n_pages"),
    )


def dashboard(stats: DataFrame) -> DataFrame:
    """One row: (workspaces, indexed, files, percent) over what :func:`workspace_stats` gives."""
    return stats.agg(
        F.count(F.lit(1)).alias("workspaces"),
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.coalesce(F.sum(F.coalesce("file_count", F.lit(0))), F.lit(0)).alias("files"),
        F.round(100.0 * F.count_if(F.col("status") == "indexed") / F.greatest(F.lit(1), F.count(F.lit(1))), 2).alias("percent"),
    )


def has_data(table: DataFrame) -> DataFrame:
    """One row: (has_data boolean). Stops at the first row."""
    return table.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_data"))


def gap_ranges(chunks: DataFrame) -> DataFrame:
    """(file_path, gap_start, gap_end): lines between consecutive chunks of a file that no chunk covers.

    The end of the chunk before counts, not the furthest end so far. Chunks without usable lines are left out.
    """
    lines = chunks.where("start_line > 0 and end_line >= start_line and file_path is not null")
    order = Window.partitionBy("file_path").orderBy("start_line", "end_line", "segment_hash")
    following = lines.select("file_path", F.col("end_line"), F.lead("start_line").over(order).alias("next_start"))
    return following.where(F.col("next_start") > F.col("end_line") + 1).select(
        "file_path", (F.col("end_line") + 1).alias("gap_start"), (F.col("next_start") - 1).alias("gap_end")
    )


def contained(chunks: DataFrame) -> DataFrame:
    """(segment_hash): chunks inside a strictly larger range of the same file, as an overlap filter would drop them.

    A chunk lies in a larger one if and only if some chunk sorted before it (by start, then longer first) ends no earlier,
    so one running maximum per file finds them, without comparing pairs.
    """
    lines = chunks.where("start_line > 0 and end_line >= start_line and file_path is not null")
    ranges = lines.select("file_path", "start_line", "end_line").distinct()
    before = Window.partitionBy("file_path").orderBy("start_line", F.desc("end_line")).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranges.withColumn("furthest", F.max("end_line").over(before)).where("furthest >= end_line").drop("furthest")
    return lines.join(inner, ["file_path", "start_line", "end_line"], "left_semi").select("segment_hash")


#: Lines of a file that one group of the join of classes and what is inside them has.
LINES_TOGETHER = 256


def inner_symbols(chunks: DataFrame) -> DataFrame:
    """(segment_hash, inner_symbol): for each class chunk the first named chunk whose lines lie inside it.

    A class is joined block by block of lines with the chunks that begin there, so no file is one group, however long.
    """
    lines = chunks.where("start_line > 0 and end_line >= start_line and file_path is not null")
    block = lambda c: F.floor(F.col(c) / LINES_TOGETHER)
    outer = lines.where("kind = 'class'").select(
        "file_path", "segment_hash", F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.explode(F.sequence(block("start_line"), block("end_line"))).alias("block")
    )
    inner = lines.where("symbol != ''").select(
        "file_path", "start_line", "end_line", "symbol", F.col("segment_hash").alias("inner_hash"), block("start_line").alias("block")
    )
    inside = (F.col("start_line") >= F.col("a")) & (F.col("end_line") <= F.col("b")) & (F.col("inner_hash") != F.col("segment_hash"))
    return (
        outer.join(inner, ["file_path", "block"])
        .where(inside)
        .groupBy("segment_hash")
        .agg(F.min_by("symbol", F.struct("start_line", "end_line", "inner_hash")).alias("inner_symbol"))
    )


def outlines(chunks: DataFrame) -> DataFrame:
    """(segment_hash, file_path, start_line, end_line, symbol, kind): a range for each file, from the first to the last line of
    its chunks, as a class without a name."""
    lines = chunks.where("start_line > 0 and end_line >= start_line and file_path is not null")
    ranges = lines.groupBy("file_path").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    key, symbol, kind = F.concat(F.lit("outline:"), "file_path"), F.lit(None).cast("string"), F.lit("class")
    return ranges.select(key.alias("segment_hash"), "file_path", "start_line", "end_line", symbol.alias("symbol"), kind.alias("kind"))
