"""The engine: index a source tree, search it, list what is in the index."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelode import config
from trovelode.operators import chunking, diff, fulltext, fusion, grep, listing, vector
from trovelode.sources import scan
from trovelode.sources.embed import EmbeddingProvider, HashEmbedder, with_vectors
from trovelode.sources.store import MANIFEST_SCHEMA, Busy, IndexMissing, Lock, Meta, Store

log = logging.getLogger(__name__)

RESULT = "file_path string, start_line int, end_line int, code_chunk string, score double, rank int"


@dataclass
class IndexState:
    status: str = "standby"  # standby, indexing, indexed, error
    message: str = ""
    files_processed: int = 0
    files_total: int = 0


class Engine:
    """One source tree with its index. Searches never write; indexing makes a new generation and then points to it."""

    def __init__(
        self, spark: SparkSession, root: str, provider: EmbeddingProvider | None = None, shared: str | None = None, branch: str | None = None, enabled: bool = True
    ):
        self.spark, self.root, self.provider, self.enabled = spark, root, provider or HashEmbedder(), enabled
        self.branch = branch or scan.current_branch(root)
        self.store = Store(spark, scan.index_location(root, shared))
        self.lock = Lock(str(self.store.folder))
        self.state = IndexState()
        self._callbacks: list[Callable[[IndexState], None]] = []

    # Progress

    def on_progress(self, callback: Callable[[IndexState], None]) -> None:
        self._callbacks.append(callback)

    def off_progress(self, callback: Callable[[IndexState], None]) -> None:
        self._callbacks = [c for c in self._callbacks if c is not callback]

    def _tell(self, **changes) -> None:
        for name, value in changes.items():
            setattr(self.state, name, value)
        for callback in self._callbacks:
            try:
                callback(self.state)
            except Exception:  # a listener's error is its own
                pass

    # Indexing

    def is_enabled(self) -> bool:
        return self.enabled and self.provider.is_configured()

    def index(self, force: bool = False) -> IndexState:
        """Brings the index up to date: only files whose hash changed are chunked and embedded again.

        ``force`` starts from nothing, as does a change of the schema or of the vectors' dimension. On an error the index
        stays as it was.
        """
        if not self.is_enabled():
            self._tell(status="error", message="indexing is not enabled or not configured")
            return self.state
        try:
            if not self.lock.acquire(lambda: not force and self._is_current()):
                self._tell(status="indexed", message="another process has just finished", files_processed=self.store.meta().indexed_file_count)
                return self.state
        except Busy as error:
            self._tell(status="error", message=str(error))
            return self.state
        try:
            self._tell(status="indexing", message="", files_processed=0, files_total=0)
            self._index(force)
        except Exception as error:
            log.exception("indexing failed")
            self._tell(status="error", message=str(error)[:500])
        finally:
            self.lock.release()
        return self.state

    def _is_current(self) -> bool:
        """Whether the index is complete and has this branch."""
        meta = self.store.meta()
        return bool(meta and meta.indexing_complete and self.store.usable(self.provider.dimensions)) and not self.store.manifest().where(F.col("branch") == self.branch).isEmpty()

    def _index(self, force: bool) -> None:
        fresh = force or not self.store.usable(self.provider.dimensions)
        files = scan.read_tree(self.spark, self.root).persist()
        total = files.count()
        current = files.select("path", "file_hash")
        manifest = self.spark.createDataFrame([], MANIFEST_SCHEMA) if fresh else self.store.manifest()
        # A branch that is new goes on from the main one: its files and their vectors are taken over.
        known = {r["branch"] for r in manifest.select("branch").distinct().collect()}
        source = next((b for b in (self.branch, "main", "master") if b in known), None)
        previous = manifest.where(F.col("branch") == source).select("path", "file_hash")
        changes = diff.diff(previous, current).where("status != 'unchanged'").persist()
        todo = files.join(changes.where("status in ('added', 'changed')").select("path"), "path", "left_semi")
        self._tell(files_total=total)
        columns = "file_path start_line end_line content file_hash segment_hash language symbol parent_scope kind vector".split()
        new = with_vectors(chunking.chunk_files(todo), self.provider).select(F.lit(self.branch).alias("branch"), *columns)
        touched = None
        if not fresh:
            if source == self.branch:
                # Only the buckets of changed files are written again.
                touched = [r["b"] for r in changes.select(self.store.bucket(F.col("path")).alias("b")).distinct().collect()]
                stored = self.store.rows_of(set(touched))
            else:
                stored = self.store.chunks()
            kept = stored.where(F.col("branch") != self.branch)
            if source is not None:
                own = stored.where(F.col("branch") == source).select(F.lit(self.branch).alias("branch"), *columns)
                kept = kept.select("branch", *columns).unionByName(diff.delete_by_paths(own, changes.select("path")))
            new = kept.select("branch", *columns).unionByName(new)
        own = current.select(F.lit(self.branch).alias("branch"), "path", "file_hash")
        meta = Meta(self.provider.dimensions) if fresh else self.store.meta()
        self.store.write(new, manifest.where(F.col("branch") != self.branch).unionByName(own), meta, touched)
        self.store.complete(total)
        changes.unpersist()
        files.unpersist()
        self._tell(status="indexed", files_processed=total)

    def clear(self) -> None:
        self.store.delete_all()
        self.lock.release()
        self._tell(status="standby", message="")

    def release_lock(self) -> None:
        self.lock.release()

    # Searching

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], RESULT)

    def _shaped(self, results: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        if "rank" not in results.columns:
            results = results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "file_path", "start_line", "end_line")))
        return results.select("file_path", "start_line", "end_line", "code_chunk", "score", "rank")

    def has_index(self) -> bool:
        meta = self.store.meta()
        return bool(meta and meta.indexing_complete and not self.store.chunks(self.branch).isEmpty())

    def _text_search(self, query: str, path_prefix: str | None, limit: int) -> DataFrame:
        """Full text from the stored postings; then the texts of the results alone are read."""
        found = fulltext.search_postings(self.store.postings(self.branch), *self.store.stats(self.branch), query, path_prefix, limit).collect()
        scored = self.spark.createDataFrame([(r["segment_hash"], r["score"]) for r in found], "segment_hash string, score double")
        return fulltext.with_contents(scored, self.store.of_files(sorted({r["file_path"] for r in found}), self.branch), True)

    def search(
        self, query: str, mode: str = "hybrid", path_prefix: str | None = None, limit: int = config.DEFAULT_LIMIT, min_score: float = config.DEFAULT_MIN_SCORE
    ) -> DataFrame:
        """(file_path, start_line, end_line, code_chunk, score, rank): ``mode`` is hybrid, vector, fts or grep.

        Vector and fts without a usable index have no results; hybrid then falls back to grep, as it does on any error. The
        results are few, so they are computed here and given back as a local table: an error can't come later.
        """
        query = query.strip()
        if not query:
            return self._nothing()
        files = scan.read_tree(self.spark, self.root)
        if mode == "grep":
            return self._local(grep.grep(files, query, path_prefix, limit))
        if mode not in ("hybrid", "vector", "fts"):
            raise ValueError(f"unknown mode {mode}")
        try:
            if not self.is_enabled() or not self.has_index():
                raise IndexMissing("there is no complete index")
            chunks = self.store.chunks(self.branch)
            vectors = chunks.select(F.col("segment_hash").alias("id"), "vector")
            if mode == "fts":
                return self._local(self._text_search(query, path_prefix, limit))
            wanted = self.provider.embed([query])[0]
            if mode == "vector":
                return self._local(vector.search(chunks, vectors, wanted, path_prefix, limit, min_score))
            text = self._text_search(query, path_prefix, config.overfetch(limit))
            return self._local(fusion.hybrid(files, chunks, vectors, query, wanted, path_prefix, limit, min_score, text))
        except IndexMissing:
            return self._local(grep.grep(files, query, path_prefix, limit)) if mode == "hybrid" else self._nothing()
        except Exception as error:
            log.exception("search failed")
            self._tell(message=str(error)[:500])
            return self._local(grep.grep(files, query, path_prefix, limit)) if mode == "hybrid" else self._nothing()

    def _local(self, results: DataFrame) -> DataFrame:
        return self.spark.createDataFrame(self._shaped(results).orderBy("rank").collect(), RESULT)

    # Listings

    def list_chunks(self, path: str | None = None, limit: int = 50) -> DataFrame:
        return listing.list_chunks(self.store.chunks(self.branch), path, limit)

    def list_files(self) -> DataFrame:
        return listing.list_files(self.store.chunks(self.branch))

    def rechunk(self, path: str, limit: int = 50) -> DataFrame:
        """Fresh chunks of one file, without the index; a path that leads out of the tree is refused."""
        if PurePosixPath(path).is_absolute() or ".." in PurePosixPath(path).parts:
            raise ValueError("the path leads out of the tree")
        files = scan.read_tree(self.spark, self.root, path=path)
        return chunking.chunk_files(files).orderBy("start_line", "end_line", "segment_hash").limit(limit)

    def stats(self) -> dict:
        """Files listed at the last run, also those without chunks, and distinct files that have chunks."""
        meta = self.store.meta()
        stored = self.store.chunks(self.branch).select("file_path").distinct().count() if meta else 0
        return {"file_count": meta.indexed_file_count if meta else 0, "stored_files": stored}

    def status(self) -> IndexState:
        if self.state.status in ("standby", "indexed"):
            self.state.status = "indexed" if self.has_index() else "standby"
        return self.state


class Workspaces:
    """The list of source trees: paths are trimmed, each once."""

    def __init__(self):
        self.paths: dict[str, str] = {}

    def add(self, path: str, at: str = "") -> None:
        if path.strip():
            self.paths.setdefault(path.strip(), at)

    def remove(self, path: str) -> None:
        self.paths.pop(path.strip(), None)
