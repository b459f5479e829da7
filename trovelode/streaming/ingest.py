"""Indexing files as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trovelode.operators import chunking, diff
from trovelode.sources.embed import EmbeddingProvider, with_vectors
from trovelode.sources.store import Meta, Store
from trovelode.tables import latest


def chunks_of_stream(files: DataFrame) -> DataFrame:
    """The chunks of a stream of files (path, content); stateless, so it runs in any output mode."""
    return chunking.chunk_files(files)


def upsert_stream(files: DataFrame, store: Store, checkpoint: str, branch: str = "main", provider: EmbeddingProvider | None = None) -> StreamingQuery:
    """Keeps an index up to date with a stream of files (path, content, and scanned_at if there is one): each batch replaces
    the chunks of its files, and the index is complete after it.

    Of a path that comes several times in a batch the last delivered counts, without ``scanned_at`` the greatest content.
    Without a provider the vectors are null and only full text and grep find the files. A batch that is repeated after a
    failure gives the same generation, since chunks are named by their place and content.
    """
    size = provider.dimensions if provider else 0

    def apply(batch: DataFrame, _: int) -> None:
        if not store.usable(size):
            store.create(size)
        timed = batch if "scanned_at" in batch.columns else batch.withColumn("scanned_at", F.lit(None).cast("timestamp"))
        files_ = latest(timed.select("path", "content", "scanned_at").where("path is not null"), ["path"], "scanned_at").persist()
        cut = chunking.chunk_files(files_)
        vectors = with_vectors(cut, provider) if provider else cut.withColumn("vector", F.lit(None).cast("array<float>"))
        new = vectors.withColumn("branch", F.lit(branch))
        touched = [r["b"] for r in files_.select(store.bucket(F.col("path")).alias("b")).distinct().collect()]
        stored = store.rows_of(set(touched))
        kept = stored.where(F.col("branch") != branch).unionByName(diff.delete_by_paths(stored.where(F.col("branch") == branch), files_.select("path")))
        hashes = files_.select(F.lit(branch).alias("branch"), "path", F.sha2("content", 256).alias("file_hash"))
        manifest = store.manifest().join(hashes.select("branch", "path"), ["branch", "path"], "left_anti").unionByName(hashes)
        store.write(kept.unionByName(new.select(*stored.columns)), manifest, store.meta() or Meta(size), touched)
        store.complete(store.manifest().where(F.col("branch") == branch).count())
        files_.unpersist()

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_window_counts(chunks: DataFrame, delay: str = "7 days", window: str = "1 day") -> DataFrame:
    """(window_start, workspace, n_chunks): chunks indexed in each window, for a stream with late rows.

    Rows later than ``delay`` behind the newest are dropped from state, and a window is emitted once it can't change.
    """
    timed = chunks.withColumn("at", F.col("indexed_at").cast("timestamp")).withWatermark("at", delay)
    return (
        timed.groupBy(F.window("at", window), "workspace")
        .agg(F.count(F.lit(1)).alias("n_chunks"))
        .select(F.col("window.start").alias("window_start"), "workspace", "n_chunks")
    )
