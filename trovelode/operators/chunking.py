"""Cutting files into chunks: by structure where the language is known, else by lines.

The work on one file is a sequential fold, so it runs as a function per file inside Spark tasks; files are limited to 1 MiB
and are independent, which is where the parallelism comes from. Lengths are in UTF-16 code units.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelode import config
from trovelode.operators import structure
from trovelode.operators.structure import Node
from trovelode.tables import spread

SCHEMA = (
    "file_path string, start_line int, end_line int, content string, file_hash string, segment_hash string, language string, "
    "symbol string, parent_scope string, kind string"
)


@dataclass(frozen=True)
class Piece:
    """A chunk of one file; lines count from 1."""

    start: int
    end: int
    text: str
    kind: str = ""
    symbol: str = ""
    scope: str = ""


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) if text.isascii() else len(text) + sum(c > "\uffff" for c in text)


def segment_id(path: str, piece: Piece) -> str:
    name = f"{path}-{piece.start}-{piece.end}-{units(piece.text)}-{piece.text[:100]}"
    return hashlib.sha256(name.encode("utf-8", "surrogatepass")).hexdigest()


def _cut(line: str, size: int) -> Iterator[str]:
    """Parts of at most so many units, without cutting a surrogate pair."""
    part, length = [], 0
    for char in line:
        own = 2 if char > "\uffff" else 1
        if length + own > size:
            yield "".join(part)
            part, length = [], 0
        part.append(char)
        length += own
    if part:
        yield "".join(part)


def chunk_lines(
    lines: list[str], path: str = "", base: int = 1, like: Piece | None = None, prefix: str = "", strict_compat: bool = False
) -> list[Piece]:
    """Fills chunks with whole lines up to the limit.

    A chunk shorter than 100 units is dropped. A line over the limit becomes pieces of 3,500 units. A remainder below 300
    units takes lines from the chunk before it. With a prefix, chunks after the first begin with it and continue the first.
    ``strict_compat`` keeps a known fault: where a remainder takes lines, the text of the chunk before still has them.
    """
    like = like or Piece(0, 0, "")
    limit = config.CHUNK_LIMIT
    if prefix and limit - (units(prefix) + 1) > 100:
        limit -= units(prefix) + 1
    last = len(lines) - 1
    sizes = [units(line) + (1 if i < last else 0) for i, line in enumerate(lines)]
    found: list[Piece] = []
    seen: set[str] = set()
    current: list[str] = []
    length, start, emitted = 0, 0, 0

    def emit(piece: Piece) -> None:
        name = segment_id(path, piece)
        if name not in seen:
            seen.add(name)
            found.append(piece)

    def flush(end: int) -> None:
        nonlocal current, length, start, emitted
        if length >= config.MIN_CHUNK_CHARS:
            text = "\n".join(current)
            piece = Piece(base + start, base + end, text, like.kind, like.symbol, like.scope)
            if prefix and emitted:
                scope = ".".join(filter(None, (like.scope, like.symbol)))
                piece = replace(piece, text=f"{prefix}\n{text}", kind="continuation", scope=scope)
            emit(piece)
            emitted += 1
        current, length, start = [], 0, end + 1

    for i, line in enumerate(lines):
        size = sizes[i]
        if size > limit:
            if current:
                flush(i - 1)
            for part in _cut(line, config.MAX_CHUNK_CHARS):
                emit(Piece(base + i, base + i, part, like.kind, like.symbol, like.scope))
            start = i + 1
            continue
        if length and length + size > limit:
            split = i - 1
            if length >= config.MIN_CHUNK_CHARS and sum(sizes[i:]) < config.MIN_CHUNK_REMAINDER_CHARS and len(current) > 1:
                head, tail = sum(sizes[start : i - 1]), sum(sizes[i - 1 :])
                for k in range(i - 2, start - 1, -1):
                    # head has the line end that the joined text lacks, as the rule's "+ 1" asks for; tail ends without one
                    if head >= config.MIN_CHUNK_CHARS and tail + 1 >= config.MIN_CHUNK_REMAINDER_CHARS:
                        split = k
                        break
                    head, tail = head - sizes[k], tail + sizes[k]
            carried = [] if strict_compat else lines[split + 1 : i]
            if not strict_compat:
                current = lines[start : split + 1]
                length = sum(sizes[start : split + 1])
            flush(split)
            current, length = list(carried), sum(sizes[split + 1 : i]) if carried else 0
        current.append(line)
        length += size
    if current:
        flush(last)
    return found


def _overlap_filter(nodes: list[Node], lines: list[str]) -> list[Node]:
    """Drops a node inside a larger one that fits the limit, and an oversized node that has another inside."""
    lengths = [0]
    for line in lines:
        lengths.append(lengths[-1] + units(line) + 1)
    fits = lambda n: lengths[n.end + 1] - lengths[n.start] - 1 <= config.CHUNK_LIMIT
    dropped, outer, order = set(), set(), []
    for n, around in structure.with_ancestors(nodes):
        order.append(n)
        outer.update(id(o) for o in around)
        if any(fits(o) for o in around):
            dropped.add(id(n))
    return [n for n in order if id(n) not in dropped and (fits(n) or id(n) not in outer)]


def signature(lines: list[str], start: int, end: int) -> str:
    """The head of a definition: lines until its brace is open and brackets are even, at most five."""
    taken, depth, opened = [], 0, False
    for line in lines[start : min(end + 1, start + 5)]:
        taken.append(line)
        depth += line.count("(") - line.count(")")
        opened = opened or "{" in line
        if opened and depth <= 0:
            break
    return "\n".join(taken)


def _structure_chunks(path: str, lines: list[str], nodes: list[Node]) -> list[Piece]:
    found: list[Piece] = []
    for n in _overlap_filter(nodes, lines):
        start = min(n.start, n.comment if n.comment is not None else n.start)
        text = "\n".join(lines[start : n.end + 1])
        if units(text) < config.MIN_CHUNK_CHARS:
            continue
        piece = Piece(start + 1, n.end + 1, text, n.kind, n.symbol, n.scope)
        if units(text) > config.CHUNK_LIMIT:
            named = ".".join(filter(None, (n.scope, n.symbol or "(anonymous)")))
            prefix = f"// Context: {named}\n{signature(lines, n.start, n.end)}"
            found += chunk_lines(lines[start : n.end + 1], path, start + 1, piece, prefix)
        else:
            found.append(piece)
    return found


def fill_gaps(path: str, lines: list[str], pieces: list[Piece]) -> list[Piece]:
    """Chunks of kind ``gap`` for the lines before, between and after the pieces."""
    ordered = sorted(pieces, key=lambda p: p.start)
    ranges, before = [], 0
    for p in ordered:
        ranges.append((before + 1, p.start - 1))
        before = p.end
    ranges.append((before + 1, len(lines)))
    gaps: list[Piece] = []
    for a, b in ranges:
        if b >= a and units("\n".join(lines[a - 1 : b])) >= config.MIN_CHUNK_CHARS:
            gaps += chunk_lines(lines[a - 1 : b], path, a, Piece(0, 0, "", "gap"))
    return gaps


def merge_small(pieces: list[Piece]) -> list[Piece]:
    """Joins neighbours below 400 units that are at most a line apart and don't have different symbols."""
    merged: list[Piece] = []
    for p in pieces:
        if merged:
            c = merged[-1]
            small = units(c.text) < config.MERGE_MAX_CHUNK_CHARS and units(p.text) < config.MERGE_MAX_CHUNK_CHARS
            fits = units(c.text) + units(p.text) + 1 <= config.CHUNK_LIMIT and p.start <= c.end + 2
            differ = bool(c.symbol) and bool(p.symbol) and c.symbol != p.symbol
            alike = c.kind == p.kind or not (c.symbol or p.symbol)
            if small and fits and not differ and alike:
                kind = p.kind if c.kind == "gap" and p.kind != "gap" else c.kind
                merged[-1] = Piece(c.start, p.end, f"{c.text}\n{p.text}", kind, c.symbol or p.symbol, c.scope or p.scope)
                continue
        merged.append(p)
    return merged


def chunk_file(path: str, content: str, strict_compat: bool = False) -> list[Piece]:
    """The chunks of a file: by structure where it has any that is known, else by lines."""
    lines = content.split("\n")
    try:
        nodes = structure.extract(path, content, lines)
        pieces = _structure_chunks(path, lines, nodes) if nodes else []
    except (RecursionError, ValueError, IndexError):
        pieces = []
    if not pieces:
        return chunk_lines(lines, path, strict_compat=strict_compat)
    both = sorted(pieces + fill_gaps(path, lines, pieces), key=lambda p: p.start)
    return merge_small(both)


def chunk_files(files: DataFrame, structured: bool = True, strict_compat: bool = False) -> DataFrame:
    """The chunks of each file (path, content), with identities; one pass without shuffle.

    Null contents, files over 1 MiB and files shorter than 100 units have no chunks.
    """
    chosen = files.where("path is not null and content is not null").where(F.octet_length("content") <= config.MAX_FILE_SIZE_BYTES)
    source = spread(chosen.select("path", "content"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                digest = hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()
                extension = structure.extension_of(path) or None
                pieces = chunk_file(path, content, strict_compat) if structured else chunk_lines(content.split("\n"), path, strict_compat=strict_compat)
                for p in pieces:
                    rows.append((path, p.start, p.end, p.text, digest, segment_id(path, p), extension, p.symbol, p.scope, p.kind))
            kinds = [pa.int32() if n in ("start_line", "end_line") else pa.string() for n in names]
            values = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    return source.mapInArrow(run, SCHEMA)
