"""Exact vector search: cosine similarity of a query, or of a set of queries, with all vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelode import config
from trovelode.operators.fulltext import with_contents

#: Queries that one pass over the vectors answers; more queries take more passes.
QUERY_BLOCK = 2_000


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a literal query, in double precision; null where either has no direction."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    doubles = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(doubles, literal, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x)) * math.sqrt(sum(float(x) ** 2 for x in query))
    return F.when((F.size(vector) == len(query)) & (norm > 0), dot / norm)


def search(
    chunks: DataFrame,
    vectors: DataFrame,
    query: list[float],
    path_prefix: str | None = None,
    limit: int | None = config.DEFAULT_LIMIT,
    min_score: float = config.DEFAULT_MIN_SCORE,
) -> DataFrame:
    """(file_path, start_line, end_line, code_chunk, score, segment_hash): the chunks nearest to the query.

    The top rows are taken from the vectors alone and joined with the chunks after, unless a prefix has to restrict them
    first. Scores must exceed ``min_score``. Null vectors and those without direction are left out; of a chunk's vectors
    the best counts.
    """
    scored = vectors.where("id is not null").groupBy("id").agg(F.max(F.round(cosine(F.col("vector"), query), 9)).alias("score"))
    scored = scored.where("score is not null").withColumnRenamed("id", "segment_hash")
    known = chunks.where(F.col("file_path").startswith(path_prefix)) if path_prefix else chunks
    scored = scored.join(known.select("segment_hash"), "segment_hash", "left_semi")
    if limit is not None:
        scored = scored.orderBy(F.desc("score"), "segment_hash").limit(limit)
    # Threshold after the limit: it is on the sort key, so the rows are the same and the score is computed once.
    return with_contents(scored.where(F.col("score") > min_score), chunks, limit is not None)


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, neighbour_id, score, rank): for each query its k nearest vectors, itself included; exact.

    Queries go in blocks of ``QUERY_BLOCK``, each sent to all tasks as one matrix: a bounded broadcast. A task keeps the k
    best of its rows for each query, so the shuffle has k rows per query and task at most. Ties go to the lower id.
    """
    dimension = queries.select(F.max(F.size(vector))).first()[0] or 0
    usable = queries.where(f"{key} is not null").where(F.size(vector) == dimension).select(key, vector)
    total = usable.count()
    blocks = max(1, math.ceil(total / QUERY_BLOCK))
    passes = [
        _search_block(vectors, usable.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i), k, key, vector, dimension) for i in range(blocks)
    ]
    best = passes[0]
    for more in passes[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, dimension: int) -> DataFrame:
    rows = queries.toPandas()
    ids = rows[key].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    matrix = np.array([list(v) for v in rows[vector]], np.float64).reshape(len(ids), dimension)
    norms = np.linalg.norm(matrix, axis=1) if len(ids) else np.zeros(0)
    ids, matrix = ids[norms > 0], matrix[norms > 0] / norms[norms > 0][:, None]
    shipped = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = shipped.value
        best_score = np.full((len(names), 0), -np.inf)
        best_id = np.zeros((len(names), 0), np.int64)
        for batch in batches:
            own = [(i, v) for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()) if i is not None and v is not None and len(v) == dimension and None not in v]
            if not own or not len(names):
                continue
            table = np.array([v for _, v in own], np.float64)
            length = np.linalg.norm(table, axis=1)
            table, number = table[length > 0] / length[length > 0][:, None], np.array([i for i, _ in own], np.int64)[length > 0]
            scores = np.concatenate((best_score, np.round(wanted @ table.T, 9)), axis=1)
            numbers = np.concatenate((best_id, np.broadcast_to(number, (len(names), len(number)))), axis=1)
            order = np.lexsort((numbers, -scores), axis=1)[:, :k]
            best_score, best_id = np.take_along_axis(scores, order, 1), np.take_along_axis(numbers, order, 1)
        n, width = best_id.shape
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, width)), pa.array(best_id.ravel()), pa.array(best_score.ravel())], ["query_id", "neighbour_id", "score"]
        )

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(
        run, "query_id long, neighbour_id long, score double"
    )
