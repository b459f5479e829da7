"""Queries and SQL of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelode import config
from trovelode.functions.text import utf16_length
from trovelode.llm import abuse, bpe, docpairs, generated, neardup, packing, secrets, split
from trovelode.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.decode_column(p6_ids(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p7_containers(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_reasons(spark, sf_dir).select(F.col("path").alias("file_path")).distinct()


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.not_hand_written(table(spark, sf_dir, "files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(table(spark, sf_dir, "chunks"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_chunks(table(spark, sf_dir, "chunks"))


def p2_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized chunks, put together again from their pieces."""
    pieces = split.split_chunks(table(spark, sf_dir, "chunks").where("segment_hash is not null").dropDuplicates(["segment_hash"]), overlap=0)
    ordered = F.array_sort(F.collect_list(F.struct("piece_no", "content")))
    return pieces.groupBy("segment_hash").agg(F.array_join(F.transform(ordered, lambda p: p["content"]), "").alias("content"))


def p2_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment_hash, over_limit, first_line, last_line): of the pieces of each chunk, how many are over the limit, and their lines."""
    pieces = p2_pieces(spark, sf_dir).where("segment_hash is not null")
    return pieces.groupBy("segment_hash").agg(
        F.count_if(utf16_length(F.col("content")) > config.CHUNK_LIMIT).alias("over_limit"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.found(table(spark, sf_dir, "chunks"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, "chunks"), similarity=0.6)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(table(spark, sf_dir, "chunks"), similarity=0.8)


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.table_counts(table(spark, sf_dir, "chunks"), similarity=0.6)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.credentials(table(spark, sf_dir, "chunks"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted(table(spark, sf_dir, "chunks"))


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment_hash, n_chars, n_lines): what redacting must not change."""
    rows = p5_redacted(spark, sf_dir).where("segment_hash is not null")
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return rows.select("segment_hash", F.length("content").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines")).distinct()


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: (documents, overfull, split): documents that have a container, containers over the capacity, and documents
    within the capacity that were divided."""
    packed = p7_containers(spark, sf_dir).where("container_id is not null")
    sums = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens")).agg(F.count_if(F.col("tokens") > 2048).alias("overfull"))
    parts = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("tokens"))
    counts = parts.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= 2048)).alias("split"))
    none = F.lit(0).cast("long")
    both = counts.withColumn("overfull", none).unionByName(sums.select(none.alias("documents"), none.alias("split"), "overfull"))
    return both.agg(*[F.sum(c).alias(c) for c in ("documents", "overfull", "split")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.abusive(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "p1_found": p1_found, "p1_reasons": p1_reasons, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_round_trip": p2_round_trip, "p2_limits": p2_limits,
    "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_groups": p4_groups, "p4_table": p4_table, "p5_found": p5_found,
    "p5_redacted": p5_redacted, "p5_kept": p5_kept, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
    "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_kept": p7_kept,
}

SQL = {
    "p6_round_trip": "SELECT doc_id, text FROM documents",
    "p2_found": """
        SELECT DISTINCT segment_hash FROM chunks
        WHERE segment_hash IS NOT NULL
          AND length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 4024
    """,
    "p4_found": r"""
        WITH words AS (
            SELECT segment_hash, regexp_extract_all(lower(any_value(content)), '[\p{L}\p{N}_]+') AS w
            FROM chunks WHERE segment_hash IS NOT NULL AND content IS NOT NULL GROUP BY segment_hash
        ), runs AS (
            SELECT DISTINCT segment_hash, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM words
        ), sized AS (SELECT *, count(*) OVER (PARTITION BY segment_hash) AS n FROM runs)
        SELECT a.segment_hash AS segment_hash_a, b.segment_hash AS segment_hash_b
        FROM sized a JOIN sized b ON a.run = b.run AND a.segment_hash < b.segment_hash
        GROUP BY a.segment_hash, b.segment_hash, a.n, b.n
        HAVING count(*) >= 0.6 * (a.n + b.n - count(*))
    """,
    "p2_round_trip": """
        SELECT segment_hash, any_value(content) AS content FROM chunks
        WHERE segment_hash IS NOT NULL AND length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 4024
        GROUP BY segment_hash
    """,
    "p2_limits": """
        SELECT segment_hash, 0 AS over_limit, min(first) AS first_line, max(first + len - length(replace(content, chr(10), '')) - CASE WHEN content[-1] = chr(10) THEN 1 ELSE 0 END) AS last_line
        FROM (SELECT *, length(content) AS len, CASE WHEN start_line > 0 THEN start_line
                WHEN end_line > length(content) - length(replace(content, chr(10), '')) - CASE WHEN content[-1] = chr(10) THEN 1 ELSE 0 END
                THEN end_line - (length(content) - length(replace(content, chr(10), '')) - CASE WHEN content[-1] = chr(10) THEN 1 ELSE 0 END) END AS first FROM chunks)
        WHERE segment_hash IS NOT NULL AND length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 4024
        GROUP BY segment_hash
    """,
    "p5_kept": """
        SELECT DISTINCT segment_hash, length(content) AS n_chars, length(content) - length(replace(content, chr(10), '')) AS n_lines
        FROM chunks WHERE segment_hash IS NOT NULL
    """,
    "p7_kept": "SELECT count(*) AS documents, 0 AS overfull, 0 AS split FROM documents WHERE text <> ''",
    "p4_groups": r"""
        WITH RECURSIVE words AS (
            SELECT segment_hash, regexp_extract_all(lower(any_value(content)), '[\p{L}\p{N}_]+') AS w
            FROM chunks WHERE segment_hash IS NOT NULL AND content IS NOT NULL GROUP BY segment_hash
        ), runs AS (
            SELECT DISTINCT segment_hash, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS run FROM words
        ), sized AS (SELECT *, count(*) OVER (PARTITION BY segment_hash) AS n FROM runs),
        links AS (
            SELECT a.segment_hash AS a, b.segment_hash AS b FROM sized a JOIN sized b ON a.run = b.run AND a.segment_hash <> b.segment_hash
            GROUP BY a.segment_hash, b.segment_hash, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))
        ), classes AS (
            SELECT segment_hash, min(segment_hash) OVER (PARTITION BY coalesce(runs, segment_hash)) AS class_id
            FROM words LEFT JOIN (SELECT segment_hash, string_agg(run, '|' ORDER BY run) AS runs FROM runs GROUP BY segment_hash) USING (segment_hash)
        ), reach AS (
            SELECT segment_hash AS s, segment_hash AS r FROM words
            UNION SELECT reach.s, links.b FROM reach JOIN links ON reach.r = links.a
        ), groups AS (SELECT s, min(r) AS group_id FROM reach GROUP BY s)
        SELECT c.segment_hash, class_id, group_id, (SELECT count(*) FROM links WHERE a = c.segment_hash) AS n_links
        FROM classes c JOIN groups ON s = c.segment_hash
    """,
}
