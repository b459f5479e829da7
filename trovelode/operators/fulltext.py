"""Full-text search over chunks: postings and BM25.

Tokens are runs of letters and digits of the lower-cased text, without stemming or stop words.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelode import config
from trovelode.tables import checkpointed, latest_if_delivered

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("tokens", lambda t: t == term))


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query, sorted."""
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, segment_hash, tf, positions array from 0): the inverted index of chunks, each given once.

    Keyed by term and chunk, so that a term in very many chunks is no large group. Where the chunks are already spread by
    ``segment_hash``, as after removing repeated deliveries, this takes no shuffle of its own.
    """
    words = chunks.where("content is not null").select("segment_hash", F.posexplode(tokens(F.col("content"))).alias("position", "term"))
    return words.groupBy("term", "segment_hash").agg(
        F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions")
    )


def placed_postings(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, term, segment_hash, file_path, start_line, end_line, tf, length, positions): postings with all that a search
    needs of a chunk besides its text. A chunk that is given twice for the same ``keep`` counts once."""
    own = ["segment_hash", "file_path", "start_line", "end_line"]
    once = chunks.where("content is not null and segment_hash is not null").dropDuplicates([*keep, "segment_hash"])
    words = once.select(*keep, *own, tokens(F.col("content")).alias("tokens")).select(
        *keep, *own, F.size("tokens").alias("length"), F.posexplode("tokens").alias("position", "term")
    )
    return words.groupBy(*keep, "term", *own, "length").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def lengths(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, n_chunks, n_tokens): how many chunks with text there are, each once, and how many tokens they have."""
    once = chunks.where("content is not null and segment_hash is not null").select(*keep, "segment_hash", F.size(tokens(F.col("content"))).alias("length"))
    return once.dropDuplicates([*keep, "segment_hash"]).groupBy(*keep).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("length").alias("n_tokens"))


def search_postings(
    postings: DataFrame, n_chunks: int, average_length: float, query: str, path_prefix: str | None = None, limit: int | None = config.DEFAULT_LIMIT
) -> DataFrame:
    """(segment_hash, file_path, start_line, end_line, score): what :func:`search` gives, without the texts, from stored postings.

    Only the rows of the query's terms are read, and no text. In how many chunks each term is comes from those rows too: one
    small row for each term.
    """
    terms = query_terms(query)
    hits = postings.where(F.col("term").isin(terms))
    holders = {r["term"]: r["count"] for r in hits.groupBy("term").count().collect()}
    k1, b = config.BM25_K1, config.BM25_B
    idf = F.lit(0.0)
    for term, count in holders.items():
        idf = F.when(F.col("term") == term, F.lit(math.log(1 + (n_chunks - count + 0.5) / (count + 0.5)))).otherwise(idf)
    share = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(average_length or 1.0)))
    chosen = hits.where(F.col("file_path").startswith(path_prefix)) if path_prefix else hits
    scored = chosen.groupBy("segment_hash", "file_path", "start_line", "end_line").agg(F.round(F.sum(share), 9).alias("score"))
    ordered = scored.orderBy(F.desc("score"), "segment_hash")
    return ordered if limit is None else ordered.limit(limit)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: (n_chunks, n_tokens, average_length)."""
    length = F.size(tokens(F.col("content")))
    stats = chunks.where("content is not null").agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum(length), F.lit(0)).alias("n_tokens"))
    return stats.withColumn("average_length", F.round(F.col("n_tokens") / F.greatest(F.lit(1), F.col("n_chunks")), 6))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df): in how many chunks each term is."""
    words = chunks.where("content is not null").select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def search(
    chunks: DataFrame, query: str, path_prefix: str | None = None, limit: int | None = config.DEFAULT_LIMIT
) -> DataFrame:
    """(file_path, start_line, end_line, code_chunk, score, segment_hash): chunks with any term, by BM25.

    Statistics come from the whole collection (one row, computed at once), the prefix (a plain string prefix) only restricts
    the results. Only the terms of the query are counted, in the scan, and contents are fetched for the results alone. A
    query without terms has no results.
    """
    terms = query_terms(query)
    k1, b = config.BM25_K1, config.BM25_B
    kept = [c for c in chunks.columns if c == "indexed_at"]
    words = chunks.where("content is not null and segment_hash is not null").withColumn("tokens", tokens(F.col("content")))
    tf = [F.coalesce(_occurrences(term), F.lit(0)).alias(f"tf{i}") for i, term in enumerate(terms)]
    # A chunk delivered again counts once. What is shuffled for that is its key and counts, not its content.
    narrow = latest_if_delivered(
        words.select("segment_hash", "file_path", "start_line", "end_line", F.size("tokens").alias("length"), *tf, *kept), ["segment_hash"], "indexed_at"
    )
    # Tokenizing is the work; its narrow result serves both the statistics and the scores.
    narrow = checkpointed(narrow)
    frequencies = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    stats = narrow.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"), *frequencies).first()
    chosen = narrow.where(" + ".join(f"tf{i}" for i in range(len(terms))) + " > 0" if terms else "false")
    if path_prefix:
        chosen = chosen.where(F.col("file_path").startswith(path_prefix))
    # The statistics are one row, so they go into the plan as literals and nothing has to be joined.
    score = F.lit(0.0)
    for i in range(len(terms)):
        count, holders = F.col(f"tf{i}"), stats[f"df{i}"]
        idf = math.log(1 + (stats["n"] - holders + 0.5) / (holders + 0.5))
        score = score + F.lit(idf) * count * (k1 + 1) / (count + k1 * (1 - b + b * F.col("length") / F.lit(stats["average"] or 1.0)))
    scored = chosen.select("segment_hash", F.round(score, 9).alias("score"))
    if limit is not None:
        scored = scored.orderBy(F.desc("score"), "segment_hash").limit(limit)
    return with_contents(scored, chunks, limit is not None)


def with_contents(scored: DataFrame, chunks: DataFrame, few: bool) -> DataFrame:
    """Scored keys (segment_hash, score) with the place and content of their chunks, best first."""
    kept = [c for c in chunks.columns if c == "indexed_at"]
    rows = chunks.select("segment_hash", "file_path", "start_line", "end_line", F.col("content").alias("code_chunk"), *kept)
    met = rows.join(F.broadcast(scored) if few else scored, "segment_hash")
    once = latest_if_delivered(met, ["segment_hash"], "indexed_at")
    return once.select("file_path", "start_line", "end_line", "code_chunk", "score", "segment_hash").orderBy(F.desc("score"), "segment_hash")
