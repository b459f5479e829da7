"""Searching lines and file names without an index.

Each file is searched where it is read: its lines become an array, the matching ones are widened by the context and merged
to ranges by array functions, and the ranges are exploded. Nothing is shuffled but the few results. A file that doesn't have
the text at all is filtered before its lines are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelode import config
from trovelode.functions.text import lines_of
from trovelode.tables import latest_if_delivered


def _matches(text: Column, query: str, regex: bool) -> Column:
    """Fixed text or expression; the case counts only if the query has an upper-case letter."""
    smart = query == query.lower()
    if regex:
        return F.rlike(text, F.lit(("(?i)" if smart else "") + query))
    return F.contains(F.lower(text), F.lit(query.lower())) if smart else F.contains(text, F.lit(query))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no int from 1, text): the lines of all files, each given once. A final line end begins no line."""
    rows = files.where("content is not null").select("path", F.posexplode(_lines(F.col("content"))).alias("n", "text"))
    return rows.select("path", (F.col("n") + 1).alias("line_no"), "text")


def _lines(content: Column) -> Column:
    every = lines_of(content)
    return F.when(content.endswith("\n"), F.slice(every, 1, F.size(every) - 1)).otherwise(every)


def _per_file(files: DataFrame, query: str, context: int, regex: bool, names: bool) -> DataFrame:
    """(path, found array of (start_line, end_line, code_chunk, score)): windows of matching lines or, with ``names``, for a
    file without any whose path has the text, its preview."""
    kept = [c for c in files.columns if c == "scanned_at"]
    content = F.col("content")
    # Lines are only split where the text is somewhere. They are a column of their own, so each file is split once.
    split = _lines(content) if regex else F.when(_matches(content, query, False), _lines(content))
    first = F.when(F.contains(F.lower("path"), F.lit(query.lower())), lines_of(content)) if names else F.lit(None).cast("array<string>")
    chosen = files.where(F.col("path").isNotNull() & F.lit(bool(query.strip())))
    chosen = chosen.select("path", *kept, split.alias("lines"), first.alias("first"))
    every = F.col("lines")
    hits = F.filter(F.transform(every, lambda text, i: F.when(_matches(text, query, regex), i + 1)), lambda n: n.isNotNull())
    size = F.size(every)

    def merged(ranges: Column, n: Column) -> Column:
        low, high = F.greatest(F.lit(1), n - context), F.least(size, n + context)
        last = F.try_element_at(ranges, F.lit(-1))
        joined = F.concat(F.slice(ranges, 1, F.size(ranges) - 1), F.array(F.struct(last["a"].alias("a"), high.alias("b"))))
        apart = F.concat(ranges, F.array(F.struct(low.alias("a"), high.alias("b"))))
        return F.when(last["b"] + 1 >= low, joined).otherwise(apart)

    def result(start: Column, end: Column, code: Column, score: float) -> Column:
        return F.struct(start.alias("start_line"), end.alias("end_line"), code.alias("code_chunk"), F.lit(score).alias("score"))

    start = F.array(F.struct(F.lit(-10).alias("a"), F.lit(-10).alias("b")))
    ranges = F.filter(F.aggregate(hits, start, merged), lambda r: r["a"] > 0)
    windows = F.transform(
        ranges, lambda r: result(r["a"], r["b"], F.array_join(F.slice(every, r["a"], r["b"] - r["a"] + 1), "\n"), config.CONTENT_SCORE)
    )
    n = config.PREVIEW_LINES
    named = F.array(result(F.lit(1), F.least(F.lit(n), F.size("first")), F.array_join(F.slice("first", 1, n), "\n"), config.FILE_NAME_SCORE))
    found = F.when(F.size(windows) > 0, windows).when(F.col("first").isNotNull(), named)
    # A file that was delivered again is judged by its last delivery; what travels for that are the results, not contents.
    return latest_if_delivered(chosen.select("path", *kept, found.alias("found")), ["path"], "scanned_at")


def _exploded(found: DataFrame) -> DataFrame:
    return found.select(F.col("path").alias("file_path"), F.explode("found").alias("r")).select("file_path", "r.*")


def content_windows(files: DataFrame, query: str, context: int = config.GREP_CONTEXT_LINES, regex: bool = False) -> DataFrame:
    """(file_path, start_line, end_line, code_chunk, score 1.0): matching lines with their context, touching ones merged.

    A blank query has no results; null contents have none.
    """
    return _exploded(_per_file(files, query, context, regex, False))


def preview(files: DataFrame, n: int = config.PREVIEW_LINES) -> DataFrame:
    """(path, line_count int, preview): the first lines of each file; null for null contents."""
    every = lines_of(F.col("content"))
    return files.select(
        "path", F.least(F.lit(n), F.size(every)).cast("int").alias("line_count"), F.array_join(F.slice(every, 1, n), "\n").alias("preview")
    )


def name_matches(files: DataFrame, query: str) -> DataFrame:
    """(file_path, start_line, end_line, code_chunk, score 0.9): previews of files with the text in their path."""
    named = files.where(F.contains(F.lower("path"), F.lit(query.lower())) & F.lit(bool(query.strip())))
    chosen = latest_if_delivered(named.select("path", "content", *[c for c in files.columns if c == "scanned_at"]), ["path"], "scanned_at")
    return preview(chosen.where("content is not null")).select(
        F.col("path").alias("file_path"),
        F.lit(1).alias("start_line"),
        F.col("line_count").alias("end_line"),
        F.col("preview").alias("code_chunk"),
        F.lit(config.FILE_NAME_SCORE).alias("score"),
    )


def grep(
    files: DataFrame,
    query: str,
    path_prefix: str | None = None,
    limit: int | None = config.DEFAULT_LIMIT,
    context: int = config.GREP_CONTEXT_LINES,
    regex: bool = False,
) -> DataFrame:
    """Content results, then file-name results of files without any; in order of path and line, at most ``limit``.

    Both come from one pass over the files, so no join has to tell which files had content results.

    ``path_prefix`` is a path here: it takes the file or all files of the directory.
    """
    if path_prefix:
        whole = path_prefix.rstrip("/")
        files = files.where((F.col("path") == whole) | F.col("path").startswith(whole + "/"))
    ordered = _exploded(_per_file(files, query, context, regex, True)).orderBy(F.desc("score"), "file_path", "start_line")
    return ordered if limit is None else ordered.limit(limit)
