"""Reciprocal rank fusion of ranked lists, and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovelode import config
from trovelode.operators import fulltext, grep, vector

KEY = ["file_path", "start_line", "end_line"]


def ranked(results: DataFrame, channel: int, weight: float) -> DataFrame:
    """A channel's results with their rank from 1, by score and then place; ties in place go by text."""
    order = Window.orderBy(F.desc("score"), *KEY, "code_chunk")
    return results.select(*KEY, "code_chunk", F.row_number().over(order).alias("rank_no")).select(
        F.lit(channel).alias("channel"), F.lit(float(weight)).alias("weight"), "*"
    )


def fuse(
    lists: DataFrame, k: int = config.RRF_K, limit: int | None = config.DEFAULT_LIMIT, per: tuple[str, ...] = (), payload: tuple[str, ...] = ()
) -> DataFrame:
    """(*per, file_path, start_line, end_line, *payload, score, rank): lists fused, for each value of ``per`` on its own.

    ``lists`` has channel, weight and rank_no. A key gets weight / (k + rank) from each of its occurrences, twice if it is
    twice in a channel; its payload is that of the first, by channel and rank. Equal scores go by that first place. It is
    one aggregation over the union, not outer joins. A null weight counts as 1.
    """
    share = F.coalesce("weight", F.lit(1.0)) / (F.lit(k) + F.col("rank_no"))
    first = F.struct("channel", "rank_no")
    keyed = lists.groupBy(*per, *KEY).agg(
        F.round(F.sum(share), 9).alias("score"), F.min(first).alias("first"), *[F.min_by(c, first).alias(c) for c in payload]
    )
    order = Window.partitionBy(*[F.col(c) for c in per] or [F.lit(0)]).orderBy(F.desc("score"), "first", *KEY)
    if per or limit is None:
        placed = keyed.withColumn("rank", F.row_number().over(order))
        cut = placed if limit is None else placed.where(F.col("rank") <= limit)
    else:  # one list: the top rows are taken without a window over all
        cut = keyed.orderBy(F.desc("score"), "first", *KEY).limit(limit).withColumn("rank", F.row_number().over(order))
    return cut.select(*per, *KEY, *payload, "score", "rank")


def reranked(lists: DataFrame) -> DataFrame:
    """Lists with ``rank_no`` from 1 in each query and channel, by the delivered rank; each row of the list counts."""
    order = Window.partitionBy("query_id", "channel").orderBy("rank_no", *KEY, "weight", "score")
    return lists.withColumn("rank_no", F.row_number().over(order))


def hybrid(
    files: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    query: str,
    query_vector: list[float],
    path_prefix: str | None = None,
    limit: int = config.DEFAULT_LIMIT,
    min_score: float = config.DEFAULT_MIN_SCORE,
    text: DataFrame | None = None,
) -> DataFrame:
    """Vector (weight 1), full text (0.5) and grep (0.5), each with more rows than asked for, fused in one plan.

    ``text`` are results of full text that the caller has already, as from stored postings.
    """
    more = config.overfetch(limit)
    text = fulltext.search(chunks, query, path_prefix, more) if text is None else text
    channels = [
        ranked(vector.search(chunks, vectors, query_vector, path_prefix, more, min_score), 0, 1.0),
        ranked(text, 1, 0.5),
        ranked(grep.grep(files, query, path_prefix, more), 2, 0.5),
    ]
    return fuse(reduce(DataFrame.unionByName, channels), limit=limit, payload=("code_chunk",))


def store_hybrid(
    chunks: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], path_prefix: str | None = None, limit: int = config.DEFAULT_LIMIT
) -> DataFrame:
    """Vector and full text with equal weights."""
    more = config.overfetch(limit)
    channels = [
        ranked(vector.search(chunks, vectors, query_vector, path_prefix, more), 0, 1.0),
        ranked(fulltext.search(chunks, query, path_prefix, more), 1, 1.0),
    ]
    return fuse(reduce(DataFrame.unionByName, channels), limit=limit, payload=("code_chunk",))
