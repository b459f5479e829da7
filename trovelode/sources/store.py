"""The index on disk: immutable generations of Parquet tables, and a pointer that is replaced in one step.

Rows lie in buckets by the hash of their file's path. A writer makes a new generation of the buckets that it touched and
then moves the pointer, which names for each bucket the generation that has it; so a small change rewrites little. Each
bucket has its ``chunks`` (with vectors, by branch), the ``postings`` of full-text search sorted by term, and ``stats``.
Readers resolve the pointer once, so they never see a half-written index, and reading never writes. What the pointer before
the current one names is kept, so a search that began before a writer ended still finds its files.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelode.operators import fulltext

SCHEMA_VERSION = 2
CHUNK_SCHEMA = (
    "branch string, file_path string, start_line int, end_line int, content string, file_hash string, segment_hash string, language string, "
    "symbol string, parent_scope string, kind string, vector array<float>"
)
POSTING_SCHEMA = (
    "branch string, term string, segment_hash string, file_path string, start_line int, end_line int, tf long, length int, positions array<int>"
)
STATS_SCHEMA = "branch string, n_chunks long, n_tokens long"
MANIFEST_SCHEMA = "branch string, path string, file_hash string"
SCHEMAS = {"chunks": CHUNK_SCHEMA, "postings": POSTING_SCHEMA, "stats": STATS_SCHEMA}
#: Buckets of an index; one is the least that a change rewrites. A large index wants more of them.
BUCKETS = 64


class IndexMissing(Exception):
    """There is no index yet: run indexing first."""


class Busy(Exception):
    """Another process holds the lock."""


@dataclass
class Meta:
    vector_size: int
    indexing_complete: bool = False
    last_indexed_at: str | None = None
    indexed_file_count: int = 0
    schema_version: int = SCHEMA_VERSION
    buckets: int = BUCKETS


class Store:
    """One index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)

    # Pointer and metadata

    def _pointer(self) -> dict | None:
        try:
            return json.loads((self.folder / "current.json").read_text())
        except (OSError, ValueError):
            return None

    def generation(self) -> Path | None:
        pointer = self._pointer()
        return self.folder / pointer["generation"] if pointer else None

    def meta(self) -> Meta | None:
        pointer = self._pointer()
        return Meta(**pointer["meta"]) if pointer else None

    def _point(self, pointer: dict) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        new = self.folder / f"current.{uuid.uuid4().hex}.tmp"
        new.write_text(json.dumps(pointer))
        os.replace(new, self.folder / "current.json")

    # Tables

    def chunks(self, branch: str | None = None) -> DataFrame:
        """The chunks of a branch, or of all with their ``branch``."""
        return self._rows("chunks", branch)

    def postings(self, branch: str | None = None) -> DataFrame:
        """The postings of a branch; a filter on ``term`` reads the row groups of those terms only."""
        return self._rows("postings", branch)

    def stats(self, branch: str) -> tuple[int, float]:
        """How many chunks a branch has, and how many tokens one has on average. One row for each bucket is read."""
        row = self._rows("stats", branch).agg(F.sum("n_chunks"), F.sum("n_tokens")).first()
        return row[0] or 0, (row[1] or 0) / max(1, row[0] or 0)

    def of_files(self, paths: list[str], branch: str) -> DataFrame:
        """The chunks of a few files: only their buckets are read."""
        wanted = self.spark.createDataFrame([(p,) for p in paths], "path string").select(self.bucket(F.col("path")).alias("b")).distinct()
        return self._rows("chunks", branch, {r["b"] for r in wanted.collect()}).where(F.col("file_path").isin(paths))

    def rows_of(self, buckets: set[int]) -> DataFrame:
        """The chunks of some buckets, of all branches."""
        return self._rows("chunks", None, buckets)

    def bucket(self, path: Column) -> Column:
        meta = self.meta()
        return F.pmod(F.xxhash64(path), F.lit(meta.buckets if meta else BUCKETS)).cast("int")

    def _rows(self, name: str, branch: str | None = None, buckets: set[int] | None = None) -> DataFrame:
        pointer = self._pointer()
        if pointer is None:
            raise IndexMissing("there is no index yet: run indexing first")
        places = [str(self.folder / g / name / f"bucket={b}") for b, g in sorted(pointer["parts"].items()) if buckets is None or int(b) in buckets]
        there = self.spark.read.schema(SCHEMAS[name]).parquet(*places) if places else self.spark.createDataFrame([], SCHEMAS[name])
        return there if branch is None else there.where(F.col("branch") == branch).drop("branch")

    def manifest(self) -> DataFrame:
        place = self.generation()
        if place is None:
            raise IndexMissing("there is no index yet: run indexing first")
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(str(place / "manifest"))

    def usable(self, vector_size: int) -> bool:
        """Whether the current generation fits: same schema and dimension. If not, the next run starts from nothing."""
        pointer = self._pointer()
        meta = pointer["meta"] if pointer else {}
        return meta.get("schema_version") == SCHEMA_VERSION and meta.get("vector_size") == vector_size

    def create(self, vector_size: int) -> None:
        """An empty generation."""
        empty = self.spark.createDataFrame([], CHUNK_SCHEMA), self.spark.createDataFrame([], MANIFEST_SCHEMA)
        self.write(*empty, Meta(vector_size))

    def write(self, chunks: DataFrame, manifest: DataFrame, meta: Meta, touched: list[int] | None = None) -> None:
        """A new generation, pointed to once all of it is written.

        ``chunks`` (of all branches) replaces the buckets in ``touched``, or all of them where it is None; the others stay as
        they are. The postings come from the chunks as written.
        """
        name = f"gen-{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        place = self.folder / name
        old = self._pointer()
        bucket = F.pmod(F.xxhash64("file_path"), F.lit(meta.buckets)).cast("int")
        columns = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
        self._by_bucket(chunks.select(*columns, bucket.alias("bucket")), ["file_path", "start_line"], place / "chunks")
        parts = {} if touched is None or old is None else {b: g for b, g in old["parts"].items() if int(b) not in set(touched)}
        fresh = sorted(int(p.name.split("=")[1]) for p in (place / "chunks").glob("bucket=*"))
        if fresh:
            written = self.spark.read.schema(f"{CHUNK_SCHEMA}, bucket int").parquet(str(place / "chunks"))
            words = fulltext.placed_postings(written, ["branch", "bucket"])
            self._by_bucket(words.select(*[f.split()[0] for f in POSTING_SCHEMA.split(", ")], "bucket"), ["term", "segment_hash"], place / "postings")
            stats = fulltext.lengths(written, ["branch", "bucket"])
            stats.coalesce(1).write.partitionBy("bucket").parquet(str(place / "stats"))
            for b in fresh:
                for table in ("postings", "stats"):  # chunks without any word have none
                    (place / table / f"bucket={b}").mkdir(parents=True, exist_ok=True)
        manifest.write.parquet(str(place / "manifest"))
        parts.update({str(b): name for b in fresh})
        before = sorted({*old["parts"].values(), old["generation"]}) if old else []
        self._point({"generation": name, "meta": asdict(meta), "parts": parts, "before": before})
        self.purge()

    def _by_bucket(self, rows: DataFrame, order: list[str], place: Path) -> None:
        """Rows as files of one bucket each, sorted; a large bucket gets several, small ones are gathered in few tasks."""
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(str(place))

    def mark(self, **changes) -> None:
        """Rewrites the metadata of the current generation."""
        pointer = self._pointer()
        if pointer:
            self._point({**pointer, "meta": {**pointer["meta"], **changes}})

    def complete(self, files: int) -> None:
        self.mark(indexing_complete=True, indexed_file_count=files, last_indexed_at=datetime.now(timezone.utc).isoformat())

    def optimize(self, buckets: int | None = None) -> None:
        """Writes all buckets anew, in a new generation, and in another number of buckets if one is given."""
        meta = self.meta()
        if meta is None:
            return
        meta.buckets = buckets or meta.buckets
        self.write(self.chunks(), self.manifest(), meta)

    def purge(self) -> None:
        """Removes generations that neither the current pointer nor the one before it names; a failure to do so is no error."""
        pointer = self._pointer()
        if pointer is None:
            return
        needed = {pointer["generation"], *pointer["parts"].values(), *pointer["before"]}
        for place in self.folder.glob("gen-*"):
            if place.name not in needed and place.name < pointer["generation"]:
                shutil.rmtree(place, ignore_errors=True)

    def delete_all(self) -> None:
        (self.folder / "current.json").unlink(missing_ok=True)
        for place in self.folder.glob("gen-*"):
            shutil.rmtree(place, ignore_errors=True)


class Lock:
    """A lock file that only one process can create."""

    def __init__(self, folder: str, wait: float = 1.0, attempts: int = 10):
        self.path, self.wait, self.attempts = Path(folder) / "index.lock", wait, attempts

    def acquire(self, done: Callable[[], bool] = lambda: False) -> bool:
        """Takes the lock. While another process has it, ``done`` is asked: if that process has done the work, False is
        given back and the lock isn't taken."""
        self.path.parent.mkdir(parents=True, exist_ok=True)
        for attempt in range(self.attempts):
            try:
                handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if done():
                    return False
                if attempt + 1 < self.attempts:
                    time.sleep(self.wait)
                continue
            os.write(handle, f"{os.getpid()}".encode())
            os.close(handle)
            return True
        raise Busy(f"{self.path} is held by another process")

    def held(self) -> bool:
        return self.path.exists()

    def release(self) -> None:
        """Also for a lock that a dead process left."""
        self.path.unlink(missing_ok=True)

    def __enter__(self) -> "Lock":
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()
