"""Queries that chunk files anew and gather them in an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelode.operators import chunking
from trovelode.plans.search import files
from trovelode.sources.embed import HashEmbedder, embed_column
from trovelode.streaming import ingest
from trovelode.tables import table


def k1_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_files(files(spark, sf_dir, "content"), structured=False)


def k6_structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_files(files(spark, sf_dir, "content"))


def k6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = k6_structure_chunks(spark, sf_dir).groupBy("language", "kind")
    return counted.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("symbol") != "").alias("n_named"))


def sc10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_column(files(spark, sf_dir, "content"), HashEmbedder(12), "path", "content").withColumnRenamed("id", "path")


def st_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the stream, over the table as one batch; no row is late in it."""
    found = ingest.late_window_counts(table(spark, sf_dir, "chunks").where("indexed_at is not null"))
    return found.select(F.col("window_start").cast("date").alias("window_start"), "workspace", "n_chunks")


QUERIES = {
    "k1_line_chunks": k1_line_chunks, "k6_structure_chunks": k6_structure_chunks, "k6_kinds": k6_kinds, "sc10_embeddings": sc10_embeddings,
    "st_window_counts": st_window_counts,
}

SQL = {
    "st_window_counts": """
        SELECT CAST(date_trunc('day', indexed_at) AS DATE) AS window_start, workspace, count(*) AS n_chunks
        FROM chunks WHERE indexed_at IS NOT NULL GROUP BY ALL
    """,
    "sc10_embeddings": r"""
        WITH once AS (SELECT path, any_value(content) AS content FROM files WHERE path IS NOT NULL GROUP BY path),
        words AS (SELECT path, sha256(unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+'))) AS h FROM once),
        parts AS (
            SELECT path, ('0x' || substr(h, 1, 8))::BIGINT % 12 AS d, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x
            FROM words GROUP BY ALL
        ), norms AS (SELECT path, sqrt(sum(x * x)) AS norm, map(list(d), list(x)) AS xs FROM parts GROUP BY path)
        SELECT o.path, CASE WHEN o.content IS NOT NULL THEN
            list_transform(generate_series(0, 11), lambda i: CAST(CASE WHEN norm > 0 THEN round(coalesce(xs[i], 0.0) / norm, 9) ELSE 0.0 END AS FLOAT)) END AS vector
        FROM once o LEFT JOIN norms n ON o.path = n.path
    """,
}
