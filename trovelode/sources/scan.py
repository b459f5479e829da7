"""Reading a source tree: listing, size guard, ignore rules and decoding in one distributed scan."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelode import config
from trovelode.functions.hashing import file_hash
from trovelode.functions.paths import is_scanned
from trovelode.sources import ignore
from trovelode.tables import spread

#: Directories that the driver lists at most before the tasks walk the rest.
DIRECTORIES_TO_DEAL = 256


def _relative(base: Path) -> Column:
    """The path of a scanned file below the base, with forward slashes."""
    uri = F.regexp_replace("path", "^file:/+", "/")
    return F.substring(F.url_decode(F.regexp_replace(uri, r"\+", "%2B")), len(str(base)) + 2, 1 << 20)


def read_tree(spark: SparkSession, root: str, rules: list[ignore.Rule] | None = None, git_semantics: bool = False, path: str | None = None) -> DataFrame:
    """(path, content, size, file_hash) of the files of a tree that belong to an index; of one file if ``path`` is given, and
    then nothing else is listed.

    Files over 1 MiB and those of ignored names, directories or patterns are left out; the size is compared in the scan, so
    large files aren't read. Bytes that are no UTF-8 become U+FFFD. Paths are relative, with forward slashes.
    """
    base = Path(root).resolve()
    rules = tree_rules(spark, str(base), git_semantics) if rules is None else rules
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if path is None:
        source = reader.load(str(base)).select(_relative(base).alias("path"), "length", "content")
        source = source.unionByName(hidden_files(spark, base))
    else:
        # One file: its folder is a list of one for the tasks, and nothing else is listed.
        there = base / path
        source = _read(spark.createDataFrame([(str(there.parent), False)] if there.is_file() else [], "directory string, deep boolean"), base, there.name)
    return (
        source.where(F.col("length") <= config.MAX_FILE_SIZE_BYTES)
        .select("path", F.col("length").alias("size"), "content")
        .where(is_scanned(F.col("path")) & ~ignore.ignored(F.col("path"), rules))
        .withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
        .select("path", "content", "size", file_hash(F.col("content")).alias("file_hash"))
    )


def hidden_files(spark: SparkSession, base: Path, name: str | None = None) -> DataFrame:
    """(path, length, content) of the files that Spark's listing leaves out, as they or a directory above begin with ``_`` or
    ``.``; of those of one name if it is given. The tree must be on a file system that the tasks see as a folder.

    The driver lists directories only until there are enough to deal out; the tasks walk the rest and read the files.
    """
    open_, done = [base], []
    while open_ and len(open_) + len(done) < DIRECTORIES_TO_DEAL:
        directory = open_.pop(0)
        done.append(directory)
        try:
            open_ += sorted(e for e in directory.iterdir() if e.is_dir() and not e.is_symlink() and e.name not in _never())
        except OSError:
            continue
    dealt = [(str(d), True) for d in open_] + [(str(d), False) for d in done]
    return _read(spread(spark.createDataFrame(dealt, "directory string, deep boolean")), base, name, hidden=True)


def _never() -> set[str]:
    return {*config.IGNORED_DIRECTORIES, config.INDEX_DIRECTORY}


def _read(directories: DataFrame, base: Path, name: str | None, hidden: bool = False) -> DataFrame:
    """The files of directories, with those below if ``deep``: of one name, or those that belong to an index by their name."""
    root, never, wanted = str(base), _never(), {*config.EXTENSIONS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for directory, deep in zip(*(c.to_pylist() for c in batch.columns)):
                for folder, below, names in os.walk(directory):
                    below[:] = [d for d in below if d not in never] if deep else []
                    for own in names:
                        relative = os.path.relpath(os.path.join(folder, own), root).replace(os.sep, "/")
                        if hidden and not any(part[0] in "_." for part in relative.split("/")):
                            continue
                        if own != name if name else own.rpartition(".")[2].lower() not in wanted and own not in config.FILE_NAMES:
                            continue
                        try:
                            size = os.stat(os.path.join(folder, own)).st_size
                            if size > config.MAX_FILE_SIZE_BYTES or os.path.islink(os.path.join(folder, own)):
                                continue
                            content = Path(folder, own).read_bytes()
                        except OSError:
                            continue
                        yield pa.RecordBatch.from_arrays([pa.array([relative]), pa.array([size]), pa.array([content])], ["path", "length", "content"])

    return directories.mapInArrow(run, "path string, length long, content binary")


def tree_rules(spark: SparkSession, root: str, git_semantics: bool = False) -> list[ignore.Rule]:
    """Rules of the ignore files of a tree, found by the tasks; those in ignored directories don't count. The rules themselves,
    which all tasks need, go to the driver."""
    base = Path(root)
    found = hidden_files(spark, base.resolve(), ".gitignore")
    below, own_root = {}, ""
    for row in found.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")).collect():
        directory = row["path"].rpartition("/")[0]
        if not directory:
            own_root = row["text"]
        elif not {*config.IGNORED_DIRECTORIES, config.INDEX_DIRECTORY}.intersection(directory.split("/")):
            below[directory] = row["text"]
    own = base / config.INDEX_DIRECTORY / "own.ignore"
    return ignore.load_rules(own_root, own.read_text(encoding="utf-8", errors="replace") if own.is_file() else "", below, git_semantics)


def _git(root: str, *arguments: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, timeout=3)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def current_branch(root: str) -> str:
    return _git(root, "rev-parse", "--abbrev-ref", "HEAD") or "main"


def index_location(root: str, shared: str | None = None, origin: str | None = None) -> str:
    """Where the index of a tree is: in the shared folder, named by its origin, else inside the tree."""
    origin = origin or (_git(root, "remote", "get-url", "origin") if shared else None)
    if shared and origin:
        return str(Path(shared) / hashlib.sha256(origin.encode()).hexdigest()[:16])
    return str(Path(root) / config.INDEX_DIRECTORY)
