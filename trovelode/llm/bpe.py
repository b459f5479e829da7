"""Encoding a corpus with a byte-level pair-merge vocabulary, exactly and in linear time.

A sequence of tokens is what the merges give if and only if each two neighbours, joined and merged alone, give those two
again. So the encoder walks over a piece of text with the longest token that starts at each place, as an Aho-Corasick
automaton over the vocabulary reports them, and takes a token only if it is compatible with the one before it. Where none
is, the place is marked as dead and the walk goes back one token. Each prefix of a piece has one valid encoding, hence a
dead place stays dead and every place is left at most once.

Defined results: a null text has null ids, an empty text an empty list. Decoding joins token bytes by an offset table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelode.tables import spread

#: Fixed value: the pattern that splits text before merging, as published with the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces longer than this are not kept in the cache, and the cache starts anew at this many pieces.
CACHED_LENGTH, CACHED_PIECES = 48, 400_000
#: The table of compatible pairs starts anew at this many; what is kept of single tokens is bounded by the vocabulary.
KNOWN_PAIRS = 500_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a vocabulary file: in ``folder``, else in TOKENIZERS_DIR, else in the folder of the installed files."""
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


class Encoder:
    """Encodes and decodes texts; one for each Python worker (see :func:`encoder`)."""

    def __init__(self, vocabulary: bytes):
        import ahocorasick
        import regex

        self.bytes_of: dict[int, bytes] = {}
        self.rank: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton()
        for line in vocabulary.splitlines():
            if line.strip():
                word, number = line.split()
                token, number = base64.b64decode(word), int(number)
                self.bytes_of[number], self.rank[token] = token, number
                self.automaton.add_word(token.decode("latin-1"), (number, len(token)))
        self.automaton.make_automaton()
        self.findall = regex.compile(PIECES).findall
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.cache = _Cache(self.encode_piece)
        # The offset table: the bytes of token i are pool[offset[i]:offset[i + 1]].
        size = max(self.bytes_of) + 1
        lengths = np.zeros(size + 1, np.int64)
        for number, token in self.bytes_of.items():
            lengths[number + 1] = len(token)
        self.offset = np.cumsum(lengths)
        self.pool = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def merged(self, data: bytes) -> list[int]:
        """The merges of a few bytes, done one by one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def halves(self, token: int) -> tuple[bytes, bytes]:
        """The two parts whose merge makes the token."""
        data = self.bytes_of[token]
        limit, parts = self.rank[data], [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, limit) for a, b in zip(parts, parts[1:])]
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that touch the token's left (0) or right (1) edge while it is merged, each with the rank that ends it."""
        known = self.spines[side].get(token)
        if known is None:
            known, part, ends = [], self.bytes_of[token], 1 << 30
            while True:
                known.append((part, ends))
                if len(part) == 1:
                    break
                ends = self.rank[part]
                part = self.halves(ends)[side]
            self.spines[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, as neighbours, stay as they are: no merge across their border comes in time.

        Both must be reachable. Of equal ranks, the merge further left comes first.
        """
        key = (left, right)
        known = self.compatible_pairs.get(key)
        if known is None:
            rank = self.rank.get
            known = self.reachable(right) and not any(
                (across := rank(a + b)) is not None and across < ends and across <= stops
                for a, ends in self.spine(left, 1)
                for b, stops in self.spine(right, 0)
            )
            if len(self.compatible_pairs) >= KNOWN_PAIRS:
                self.compatible_pairs.clear()
            self.compatible_pairs[key] = known
        return known

    def reachable(self, token: int) -> bool:
        """Whether the merges of the token's own bytes give the token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece (of what the splitting pattern gives)."""
        data = piece.encode("utf-8", "surrogatepass")
        single = self.rank.get(data)
        if single is not None and self.reachable(single):
            return (single,)
        n = len(data)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            starting[end + 1 - length].append((token, length))  # shorter tokens come first
        dead = bytearray(n + 1)
        taken: list[tuple[int, int, int]] = []  # token, its length, its place in the list of its start
        at, choice = 0, len(starting[0]) - 1
        while at < n:
            while choice >= 0:
                token, length = starting[at][choice]
                if not dead[at + length] and (self.compatible(taken[-1][0], token) if taken else self.reachable(token)):
                    break
                choice -= 1
            if choice >= 0:
                taken.append((token, length, choice))
                at += length
                choice = len(starting[at]) - 1
            else:
                dead[at] = 1
                _, length, choice = taken.pop()
                at, choice = at - length, choice - 1
        return tuple(token for token, _, _ in taken)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens."""
        return list(chain.from_iterable(map(self.cache.__getitem__, self.findall(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.cache.__getitem__, self.findall(text))))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 come as U+FFFD."""
        ids = np.asarray(list(ids), np.int64)
        starts, lengths = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
        return self.pool[places].tobytes().decode("utf-8", "replace")


class _Cache(dict):
    """Ids by piece."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(vocabulary: bytes) -> Encoder:
    """The encoder of a vocabulary, as its file's bytes; made once in each Python worker."""
    return Encoder(vocabulary)


def shipped(spark: SparkSession, path: str | None = None) -> Broadcast[bytes]:
    """The vocabulary, read by the driver and sent along with the job; its size is that of the file, under a megabyte. Executors
    need no file of their own."""
    return spark.sparkContext.broadcast(Path(path or vocabulary_path()).read_bytes())


def encode_column(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each row's text; null for null, an empty list for an empty text.

    One pass without shuffle; rows are kept as they come, repeated rows too. Only the two columns are read, so other
    columns, of whatever name, play no part.
    """
    vocabulary = shipped(documents.sparkSession, path)
    source = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = source.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary.value)
        for batch in batches:
            texts = batch.column("text")
            flat, ends, null = [], [0], []
            for value in texts:
                value = value.as_py()
                null.append(value is None)
                if value:
                    flat.extend(own.encode(value))
                ends.append(len(flat))
            offsets = pa.array([None if n else e for n, e in zip([*null, False], ends)], pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids], ["key", "ids"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(run, schema).select(F.col("key").alias(key), "ids")


def decode_column(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the inverse of :func:`encode_column`."""
    vocabulary = shipped(encoded.sparkSession, path)
    source = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = source.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary.value)
        for batch in batches:
            texts = [None if v is None else own.decode(v) for v in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("text", T.StringType())])
    return source.mapInArrow(run, schema).select(F.col("key").alias(key), "text")
