"""Queries over the given tables for the search engine's operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelode import config
from trovelode.functions import hashing, paths
from trovelode.operators import diff, fulltext, fusion, grep, listing, vector
from trovelode.sources import ignore
from trovelode.sources.embed import HashEmbedder
from trovelode.tables import table

GREP_QUERY, NAME_QUERY, TEXT_QUERY, PREFIX = "token", "locker", "pending ledger token", "harbor-ledger/"
QUERY_VECTOR = HashEmbedder(12).embed_one(TEXT_QUERY)
CUT = "2024-06-01"

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_chunks = "(SELECT * FROM chunks WHERE segment_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_hash ORDER BY indexed_at DESC NULLS LAST) = 1)"
_files = "(SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC NULLS LAST) = 1)"
_utf16 = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"
_extension = r"nullif(regexp_extract(lower({0}), '[^/]\.([^./]+)$', 1), '')"


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return listing.current_chunks(table(spark, sf_dir, "chunks"), *columns)


def files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return listing.current_files(table(spark, sf_dir, "files"), *columns)


# Scans and files


@query(
    "sc1_scan_filter",
    f"""
    SELECT path, coalesce((coalesce({_extension.format('path')} IN ({_list(config.EXTENSIONS)}), false)
        OR string_split(path, '/')[-1] IN ({_list(config.FILE_NAMES)}))
      AND NOT list_has_any(string_split(path, '/')[:-2], [{_list(config.IGNORED_DIRECTORIES)}])
      AND string_split(path, '/')[-1] NOT IN ({_list(config.IGNORED_FILES)}), false) AS kept
    FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL)
    """,
)
def sc1_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "files").where("path is not null").select("path").distinct()
    return own.select("path", paths.is_scanned(F.col("path")).alias("kept"))


@query(
    "sc2_ignored",
    """
    SELECT DISTINCT path FROM files WHERE path IS NOT NULL AND CASE
        WHEN regexp_matches(path, '/tests/.*\\.ts$') THEN true
        WHEN regexp_matches(path, '^harbor-ledger/libs/[^/]+/[a-m][^/]*\\.[^/]*$') OR regexp_matches(path, '(^|/)[^/]*_[^/]*\\.json(/|$)') THEN false
        ELSE regexp_matches(path, '(^|/)[^/]*\\.(md|json)(/|$)') OR regexp_matches(path, '^harbor-ledger/libs/') OR regexp_matches(path, '(^|/)cmd/') END
    """,
)
def sc2_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ignore.load_rules("# ours\n*.md\n*.json\n/harbor-ledger/libs/\ncmd/\n!harbor-ledger/libs/*/[a-m]*.*\n!*_*.json\n**/tests/**/*.ts")
    return table(spark, sf_dir, "files").where("path is not null").where(ignore.ignored(F.col("path"), rules)).select("path").distinct()


@query(
    "sc4_size_guard",
    f"SELECT path, CAST(strlen(content) AS BIGINT) AS n_bytes FROM {_files} WHERE strlen(content) <= {config.MAX_FILE_SIZE_BYTES}",
)
def sc4_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = files(spark, sf_dir, "content").select("path", F.octet_length("content").cast("long").alias("n_bytes"))
    return sized.where(F.col("n_bytes") <= config.MAX_FILE_SIZE_BYTES)


@query(
    "sc6_preview",
    rf"""
    SELECT path, CAST(least(30, len(string_split(content, chr(10)))) AS INTEGER) AS line_count,
           array_to_string(string_split(content, chr(10))[:30], chr(10)) AS preview
    FROM {_files}
    """,
)
def sc6_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.preview(files(spark, sf_dir, "content"))


_lines = f"""
    SELECT path, unnest(generate_series(1, n)) AS line_no, unnest(parts[:n]) AS text
    FROM (SELECT path, string_split(content, chr(10)) AS parts,
                 len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END AS n
          FROM {_files} WHERE content IS NOT NULL)
"""


@query("sc9_lines", f"SELECT path, CAST(line_no AS INTEGER) AS line_no, text FROM ({_lines})")
def sc9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.lines(files(spark, sf_dir, "content"))


@query("sc8_list_files", "SELECT DISTINCT file_path FROM chunks WHERE file_path IS NOT NULL AND file_path <> ''")
def sc8_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_files(table(spark, sf_dir, "chunks"))


# Filters and projections


@query("flt_path_equal", f"SELECT segment_hash, file_path FROM {_chunks} WHERE file_path = (SELECT min(file_path) FROM chunks)")
def flt_path_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir, "file_path")
    wanted = table(spark, sf_dir, "chunks").agg(F.min("file_path")).first()[0] or ""
    return own.where(paths.under(F.col("file_path"), wanted)).select("segment_hash", "file_path")


@query("flt_path_prefix", f"SELECT segment_hash, file_path FROM {_chunks} WHERE starts_with(file_path, '{PREFIX}')")
def flt_path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "chunks").where(paths.under(F.col("file_path"), PREFIX))
    return listing.current_chunks(own, "file_path").select("segment_hash", "file_path")


@query("flt_file_names", f"SELECT DISTINCT path FROM files WHERE contains(lower(path), '{NAME_QUERY}')")
def flt_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.filter_names(table(spark, sf_dir, "files"), NAME_QUERY)


_debug = f"""segment_hash, file_path, start_line, end_line, CAST({_utf16.format('content')} AS INTEGER) AS char_count,
    nullif(symbol, '') AS symbol, nullif(parent_scope, '') AS parent_scope, nullif(kind, '') AS kind"""


@query("flt_debug_chunks", f"SELECT {_debug} FROM {_chunks}")
def flt_debug_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.debug_rows(chunks(spark, sf_dir, "file_path", "start_line", "end_line", "content", "symbol", "parent_scope", "kind"))


@query(
    "c1_list_chunks",
    f"SELECT {_debug} FROM {_chunks} WHERE starts_with(file_path, '{PREFIX}') ORDER BY file_path, start_line NULLS FIRST, segment_hash LIMIT 1000",
)
def c1_list_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    under = table(spark, sf_dir, "chunks").where(paths.under(F.col("file_path"), PREFIX))
    columns = "file_path", "start_line", "end_line", "content", "symbol", "parent_scope", "kind"
    return listing.list_chunks(listing.current_chunks(under, *columns), PREFIX, 5000)


@query(
    "l8_pages",
    """
    SELECT workspace, file_path, CAST((n - 1) // 50 + 1 AS INTEGER) AS page, CAST((n - 1) % 50 + 1 AS INTEGER) AS place
    FROM (SELECT workspace, file_path, row_number() OVER (PARTITION BY workspace ORDER BY file_path) AS n
          FROM (SELECT DISTINCT workspace, file_path FROM chunks WHERE file_path IS NOT NULL AND file_path <> ''))
    """,
)
def l8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.pages(table(spark, sf_dir, "chunks"))


@query("a1_has_data", "SELECT count(*) > 0 AS has_data FROM chunks")
def a1_has_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.has_data(table(spark, sf_dir, "chunks"))


_stats = """
    SELECT w.workspace, CASE WHEN chunk_count > 0 THEN 'indexed' ELSE 'standby' END AS status,
           coalesce(file_count, 0) AS file_count, coalesce(chunk_count, 0) AS chunk_count, CAST(ceil(coalesce(file_count, 0) / 50) AS BIGINT) AS n_pages
    FROM workspaces w LEFT JOIN (
        SELECT workspace, count(DISTINCT file_path) AS file_count, count(DISTINCT segment_hash) AS chunk_count FROM chunks GROUP BY workspace
    ) USING (workspace)
"""


@query("a4_workspace_stats", _stats)
def a4_workspace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.workspace_stats(table(spark, sf_dir, "workspaces"), table(spark, sf_dir, "chunks"))


@query(
    "a5_dashboard",
    f"""
    SELECT count(*) AS workspaces, count(*) FILTER (status = 'indexed') AS indexed, CAST(coalesce(sum(file_count), 0) AS BIGINT) AS files,
           round(100.0::DOUBLE * count(*) FILTER (status = 'indexed') / greatest(1, count(*)), 2) AS percent
    FROM ({_stats})
    """,
)
def a5_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.dashboard(a4_workspace_stats(spark, sf_dir))


# Incremental indexing


def _branch(name: str) -> str:
    return f"""(SELECT path, file_hash FROM manifest WHERE branch = '{name}' AND path IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY recorded_at DESC NULLS LAST, file_hash DESC NULLS LAST) = 1)"""


def _diff(previous: str, current: str) -> str:
    return f"""
    SELECT coalesce(p.path, c.path) AS path, p.file_hash AS previous_hash, c.file_hash AS file_hash,
           CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted'
                WHEN p.file_hash IS NOT DISTINCT FROM c.file_hash THEN 'unchanged' ELSE 'changed' END AS status
    FROM {previous} p FULL OUTER JOIN {current} c ON p.path = c.path
    """


_current = f"(SELECT path, file_hash FROM {_files})"


@query("j1_manifest_diff", _diff(_branch("main"), _current))
def j1_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff(diff.branch_state(table(spark, sf_dir, "manifest"), "main"), files(spark, sf_dir, "file_hash").select("path", "file_hash"))


@query("u3_deleted_paths", f"SELECT path FROM ({_diff(_branch('main'), _current)}) WHERE status = 'deleted'")
def u3_deleted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j1_manifest_diff(spark, sf_dir).where("status = 'deleted'").select("path")


@query(
    "a4_diff_counts",
    f"SELECT status, count(*) AS n FROM ({_diff(_branch('main'), _current)}) GROUP BY status",
)
def a4_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j1_manifest_diff(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_row = "segment_hash, file_path, start_line, end_line, content"


@query(
    "sk2_upsert",
    f"""
    WITH old AS (SELECT {_row} FROM chunks WHERE indexed_at < TIMESTAMP '{CUT}' OR indexed_at IS NULL),
         new AS (SELECT {_row} FROM chunks WHERE indexed_at >= TIMESTAMP '{CUT}')
    SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.segment_hash = old.segment_hash) UNION ALL SELECT * FROM new
    """,
)
def sk2_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "chunks")
    late = F.col("indexed_at") >= F.lit(CUT).cast("timestamp_ntz")
    columns = _row.split(", ")
    return diff.upsert(every.where(~F.coalesce(late, F.lit(False))).select(*columns), every.where(late).select(*columns))


@query(
    "sk3_delete_by_path",
    f"""
    SELECT segment_hash, file_path FROM chunks c WHERE NOT EXISTS (
        SELECT 1 FROM ({_diff(_branch('main'), _current)}) d WHERE d.status IN ('changed', 'deleted') AND d.path = c.file_path)
    """,
)
def sk3_delete_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = j1_manifest_diff(spark, sf_dir).where("status in ('changed', 'deleted')").select("path")
    return diff.delete_by_paths(table(spark, sf_dir, "chunks").select("segment_hash", "file_path"), gone)


@query(
    "sk7_branch_files",
    "SELECT branch, substr(regexp_replace(branch, '[^a-zA-Z0-9._-]', '_', 'g'), 1, 64) AS file_name, count(*) AS n_rows FROM manifest GROUP BY branch",
)
def sk7_branch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "manifest").groupBy("branch").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select("branch", paths.branch_file_name(F.col("branch")).alias("file_name"), "n_rows")


# Identities and names


@query("k14_file_hash", f"SELECT path, sha256(content) AS file_hash FROM {_files}")
def k14_file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, "content").select("path", hashing.file_hash(F.col("content")).alias("file_hash"))


@query(
    "k14_segment_hash",
    f"""
    SELECT segment_hash, sha256(concat_ws('-', file_path, start_line, end_line, {_utf16.format('content')}, substr(content, 1, 100))) AS computed
    FROM {_chunks}
    """,
)
def k14_segment_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    computed = hashing.segment_hash(*(F.col(c) for c in ("file_path", "start_line", "end_line", "content")))
    return chunks(spark, sf_dir, "file_path", "start_line", "end_line", "content").select("segment_hash", computed.alias("computed"))


_alias = " ".join(f"WHEN {_extension.format('path')} = '{a}' THEN '{b}'" for a, b in config.ALIASES.items())
_language = f"""CASE {_alias} WHEN {_extension.format('path')} IN ({_list(config.STRUCTURED_EXTENSIONS)}) THEN {_extension.format('path')} END"""


@query(
    "k13_language",
    f"SELECT path, {_extension.format('path')} AS extension, {_language} AS language FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL)",
)
def k13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "files").where("path is not null").select("path").distinct()
    return own.select("path", paths.extension(F.col("path")).alias("extension"), paths.language(F.col("path")).alias("language"))


_kind = " ".join(f"WHEN contains(capture, '{a}') THEN '{b}'" for a, b in paths.KIND_PARTS)


@query(
    "k7_capture_kind",
    f"""
    SELECT capture, CASE {_kind} ELSE 'fallback' END AS kind, n
    FROM (SELECT concat_ws('.', coalesce(language, 'any'), coalesce(kind, 'none')) AS capture, count(*) AS n FROM chunks GROUP BY 1)
    """,
)
def k7_capture_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    capture = F.concat_ws(".", F.coalesce("language", F.lit("any")), F.coalesce("kind", F.lit("none")))
    counted = table(spark, sf_dir, "chunks").groupBy(capture.alias("capture")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("capture", paths.kind_of_capture(F.col("capture")).alias("kind"), "n")


# Ranges


@query(
    "w4_gap_ranges",
    f"""
    SELECT file_path, end_line + 1 AS gap_start, next_start - 1 AS gap_end FROM (
        SELECT file_path, end_line, lead(start_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line, segment_hash) AS next_start
        FROM {_chunks} WHERE start_line > 0 AND end_line >= start_line AND file_path IS NOT NULL)
    WHERE next_start > end_line + 1
    """,
)
def w4_gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.gap_ranges(chunks(spark, sf_dir, "file_path", "start_line", "end_line"))


_usable = f"{_chunks} WHERE start_line > 0 AND end_line >= start_line AND file_path IS NOT NULL"
_ranges = f"""(
    SELECT segment_hash, file_path, start_line, end_line, symbol, kind FROM {_usable}
    UNION ALL SELECT 'outline:' || file_path, file_path, min(start_line), max(end_line), NULL, 'class' FROM {_usable} GROUP BY file_path)"""


def _outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks and the outlines of their files, as in the given table hardly any chunk lies inside another."""
    columns = ["file_path", "start_line", "end_line", "symbol", "kind"]
    found = chunks(spark, sf_dir, *columns)
    return found.select("segment_hash", *columns).unionByName(listing.outlines(found))



@query(
    "j7_contained",
    f"""
    SELECT c.segment_hash FROM {_ranges} c WHERE EXISTS (
        SELECT 1 FROM {_ranges} o WHERE o.file_path = c.file_path AND o.start_line <= c.start_line AND o.end_line >= c.end_line
           AND (o.start_line <> c.start_line OR o.end_line <> c.end_line))
    """,
)
def j7_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.contained(_outlined(spark, sf_dir))


@query(
    "j6_inner_symbols",
    f"""
    SELECT o.segment_hash, arg_min(i.symbol, (i.start_line, i.end_line, i.segment_hash)) AS inner_symbol
    FROM {_ranges} o JOIN {_ranges} i ON o.file_path = i.file_path AND i.start_line >= o.start_line AND i.end_line <= o.end_line
         AND i.segment_hash <> o.segment_hash
    WHERE o.kind = 'class' AND i.symbol <> '' GROUP BY o.segment_hash
    """,
)
def j6_inner_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.inner_symbols(_outlined(spark, sf_dir))


# Grep


def _windows(query: str) -> str:
    match = f"contains(lower(text), '{query.lower()}')" if query == query.lower() else f"contains(text, '{query}')"
    return f"""
    WITH lines AS ({_lines}),
    near AS (SELECT DISTINCT l.path, l.line_no, l.text FROM lines l
             JOIN (SELECT path, line_no FROM lines WHERE {match}) m ON m.path = l.path AND l.line_no BETWEEN m.line_no - 2 AND m.line_no + 2),
    marked AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY path ORDER BY line_no) = 1 THEN 0 ELSE 1 END AS opens FROM near),
    islands AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY line_no) AS island FROM marked)
    SELECT path AS file_path, CAST(min(line_no) AS INTEGER) AS start_line, CAST(max(line_no) AS INTEGER) AS end_line,
           string_agg(text, chr(10) ORDER BY line_no) AS code_chunk, 1.0::DOUBLE AS score
    FROM islands GROUP BY path, island
    """


@query("g2_grep_content", _windows(GREP_QUERY))
def g2_grep_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.content_windows(table(spark, sf_dir, "files"), GREP_QUERY)


@query("g2_grep_cased", _windows("TODO"))
def g2_grep_cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.content_windows(table(spark, sf_dir, "files"), "TODO")


@query(
    "g2_grep_regex",
    f"""
    SELECT path AS file_path, count(*) AS n_lines FROM ({_lines})
    WHERE regexp_matches(text, '(?i)get[a-z]+\\(') GROUP BY path
    """,
)
def g2_grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grep.content_windows(table(spark, sf_dir, "files"), "get[a-z]+\\(", context=0, regex=True)
    return found.groupBy("file_path").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))


_names = f"""
    SELECT path AS file_path, 1 AS start_line, CAST(least(30, len(string_split(content, chr(10)))) AS INTEGER) AS end_line,
           array_to_string(string_split(content, chr(10))[:30], chr(10)) AS code_chunk, 0.9::DOUBLE AS score
    FROM {_files} WHERE contains(lower(path), '{{0}}') AND content IS NOT NULL
"""


@query("g3_grep_names", _names.format(NAME_QUERY))
def g3_grep_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.name_matches(table(spark, sf_dir, "files"), NAME_QUERY)


def _grep(query: str, where: str = "true") -> str:
    return f"""
    SELECT * FROM (
        SELECT * FROM ({_windows(query)}) UNION ALL
        SELECT * FROM ({_names.format(query)}) WHERE file_path NOT IN (SELECT file_path FROM ({_windows(query)}))
    ) WHERE {where}
    """


@query("g1_grep_all", _grep(NAME_QUERY))
def g1_grep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep(table(spark, sf_dir, "files"), NAME_QUERY, limit=None)


@query("l6_grep_top", f"SELECT * FROM ({_grep(NAME_QUERY)}) ORDER BY score DESC, file_path, start_line LIMIT 20")
def l6_grep_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep(table(spark, sf_dir, "files"), NAME_QUERY)


# Full text


_tokens = r"regexp_extract_all(lower(content), '[\p{L}\p{N}]+')"


@query(
    "t1_postings",
    f"""
    SELECT term, segment_hash, count(*) AS tf, string_agg(CAST(position AS VARCHAR), ' ' ORDER BY position) AS positions FROM (
        SELECT segment_hash, unnest(tokens) AS term, unnest(generate_series(0, len(tokens) - 1)) AS position
        FROM (SELECT segment_hash, {_tokens} AS tokens FROM {_chunks} WHERE content IS NOT NULL))
    GROUP BY term, segment_hash
    """,
)
def t1_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fulltext.postings(chunks(spark, sf_dir, "content"))
    return found.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), " "))


@query(
    "a7_corpus_stats",
    f"""
    SELECT count(*) AS n_chunks, CAST(coalesce(sum(len({_tokens})), 0) AS BIGINT) AS n_tokens,
           round(sum(len({_tokens})) / greatest(1, count(*)), 6) AS average_length
    FROM {_chunks} WHERE content IS NOT NULL
    """,
)
def a7_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.corpus_stats(chunks(spark, sf_dir, "content"))


@query(
    "a7_document_frequencies",
    f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_tokens})) AS term FROM {_chunks} WHERE content IS NOT NULL) GROUP BY term",
)
def a7_document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.document_frequencies(chunks(spark, sf_dir, "content"))


def _bm25(query: str) -> str:
    terms = fulltext.query_terms(query)
    tf = ", ".join(f"len(list_filter(tokens, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (list_contains(tokens, '{t}')) AS df{i}" for i, t in enumerate(terms))
    score = " + ".join(
        f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average))"
        for i in range(len(terms))
    )
    return f"""
    SELECT file_path, start_line, end_line, content AS code_chunk, round({score}, 9) AS score, segment_hash
    FROM (SELECT *, len(tokens) AS length, {tf} FROM (SELECT *, {_tokens} AS tokens FROM {_chunks} WHERE content IS NOT NULL)),
         (SELECT count(*) AS n, avg(len(tokens)) AS average, {df} FROM (SELECT {_tokens} AS tokens FROM {_chunks} WHERE content IS NOT NULL))
    WHERE {" + ".join(f"tf{i}" for i in range(len(terms)))} > 0
    """


@query("t2_fulltext_all", _bm25(TEXT_QUERY))
def t2_fulltext_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.search(table(spark, sf_dir, "chunks").where("segment_hash is not null"), TEXT_QUERY, limit=None)


@query("t2_fulltext_top", f"SELECT * FROM ({_bm25(TEXT_QUERY)}) WHERE starts_with(file_path, '{PREFIX}') ORDER BY score DESC, segment_hash LIMIT 20")
def t2_fulltext_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.search(table(spark, sf_dir, "chunks").where("segment_hash is not null"), TEXT_QUERY, PREFIX)


# Vectors


_literal = "[" + ", ".join(map(repr, QUERY_VECTOR)) + "]::DOUBLE[]"
_scored = f"""
    (SELECT id AS segment_hash, max(round(list_cosine_similarity(CAST(vector AS DOUBLE[]), {_literal}), 9)) AS score
     FROM vectors WHERE id IS NOT NULL AND len(vector) = {len(QUERY_VECTOR)} AND list_sum(list_transform(vector, lambda x: x * x)) > 0 GROUP BY id)
"""


@query("t2_postings_top", f"SELECT * FROM ({_bm25(TEXT_QUERY)}) WHERE starts_with(file_path, '{PREFIX}') ORDER BY score DESC, segment_hash LIMIT 20")
def t2_postings_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from postings as an index has them, with the texts of the results fetched after."""
    texts = chunks(spark, sf_dir, "file_path", "start_line", "end_line", "content").drop("indexed_at")
    words = fulltext.placed_postings(texts, [])
    sizes = fulltext.lengths(texts.withColumn("all", F.lit(1)), ["all"]).first()
    scored = fulltext.search_postings(words, sizes["n_chunks"], sizes["n_tokens"] / sizes["n_chunks"], TEXT_QUERY, PREFIX) if sizes else None
    scored = scored.select("segment_hash", "score") if scored is not None else spark.createDataFrame([], "segment_hash string, score double")
    return fulltext.with_contents(scored, texts, True)


def _vector(limit: int, where: str = "true") -> str:
    return f"""
    SELECT file_path, start_line, end_line, content AS code_chunk, score, segment_hash FROM (
        SELECT * FROM {_chunks} c JOIN {_scored} s USING (segment_hash) WHERE {where} ORDER BY score DESC, segment_hash LIMIT {limit}) WHERE score > 0.3
    """


@query("v1_vector_top", _vector(20))
def v1_vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search(table(spark, sf_dir, "chunks").where("segment_hash is not null"), table(spark, sf_dir, "vectors"), QUERY_VECTOR)


@query("v1_vector_prefix", _vector(20, f"starts_with(file_path, '{PREFIX}')"))
def v1_vector_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search(table(spark, sf_dir, "chunks").where("segment_hash is not null"), table(spark, sf_dir, "vectors"), QUERY_VECTOR, PREFIX)


@query(
    "v1_vector_many",
    """
    SELECT query_id, neighbour_id, score, rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id,
               round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score,
               CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY
                   round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, e.vec_id) AS INTEGER) AS rank
        FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
    WHERE rank <= 10
    """,
)
def v1_vector_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings")
    return vector.search_many(every, every.where("vec_id % 100 = 0"))


# Fusion


_ranked = """
    (SELECT query_id, channel, weight, file_path, start_line, end_line,
            row_number() OVER (PARTITION BY query_id, channel
                ORDER BY rank_no NULLS FIRST, file_path NULLS FIRST, start_line NULLS FIRST, end_line NULLS FIRST, weight NULLS FIRST, score NULLS FIRST) AS rank_no
     FROM ranked_lists)
"""


@query("w1_ranks", f"SELECT query_id, channel, file_path, start_line, end_line, CAST(rank_no AS INTEGER) AS rank_no FROM {_ranked}")
def w1_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = fusion.reranked(table(spark, sf_dir, "ranked_lists"))
    return lists.select("query_id", "channel", "file_path", "start_line", "end_line", "rank_no")


@query(
    "w2_fused",
    f"""
    SELECT query_id, file_path, start_line, end_line, score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_place, file_path NULLS FIRST, start_line NULLS FIRST, end_line NULLS FIRST) AS INTEGER) AS rank
    FROM (SELECT query_id, file_path, start_line, end_line, round(sum(coalesce(weight, 1.0::DOUBLE) / (60 + rank_no)), 9) AS score,
                 min(coalesce(channel, -1) * 1000000000 + rank_no) AS first_place
          FROM {_ranked} GROUP BY query_id, file_path, start_line, end_line)
    QUALIFY rank <= 20
    """,
)
def w2_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(fusion.reranked(table(spark, sf_dir, "ranked_lists")), per=("query_id",))


def _hybrid(channels: list[tuple[str, float, str]]) -> str:
    parts = [
        f"""SELECT {i} AS channel, {w}::DOUBLE AS weight, file_path, start_line, end_line, code_chunk,
               row_number() OVER (ORDER BY score DESC, file_path NULLS FIRST, start_line NULLS FIRST, end_line NULLS FIRST, code_chunk NULLS FIRST) AS rank_no
           FROM (SELECT * FROM ({sql}) ORDER BY score DESC, {order} LIMIT 60)"""
        for i, (sql, w, order) in enumerate(channels)
    ]
    return f"""
    SELECT file_path, start_line, end_line, code_chunk, score,
           CAST(row_number() OVER (ORDER BY score DESC, place, file_path, start_line, end_line) AS INTEGER) AS rank
    FROM (SELECT file_path, start_line, end_line, round(sum(weight / (60 + rank_no)), 9) AS score, min(channel * 1000 + rank_no) AS place,
                 arg_min(code_chunk, channel * 1000 + rank_no) AS code_chunk
          FROM ({" UNION ALL ".join(parts)}) GROUP BY file_path, start_line, end_line)
    QUALIFY rank <= 20
    """


@query(
    "h1_hybrid",
    _hybrid([(_vector(60), 1.0, "segment_hash"), (_bm25(TEXT_QUERY), 0.5, "segment_hash"), (_grep(TEXT_QUERY), 0.5, "file_path, start_line")]),
)
def h1_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.hybrid(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "vectors"), TEXT_QUERY, QUERY_VECTOR)


_ONE_WORD = "tariff"


@query(
    "h1_hybrid_word",
    _hybrid([(_vector(60), 1.0, "segment_hash"), (_bm25(_ONE_WORD), 0.5, "segment_hash"), (_grep(_ONE_WORD), 0.5, "file_path, start_line")]),
)
def h1_hybrid_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.hybrid(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "vectors"), _ONE_WORD, QUERY_VECTOR)


@query("h2_store_hybrid", _hybrid([(_vector(60), 1.0, "segment_hash"), (_bm25(TEXT_QUERY), 1.0, "segment_hash")]))
def h2_store_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.store_hybrid(table(spark, sf_dir, "chunks").where("segment_hash is not null"), table(spark, sf_dir, "vectors"), TEXT_QUERY, QUERY_VECTOR)
