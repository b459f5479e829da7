"""Embedding providers, and embedding a column with one."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelode import config
from trovelode.tables import spread


class EmbeddingProvider(Protocol):
    """What turns texts into vectors; it is sent to the tasks, so it must be picklable."""

    dimensions: int

    def is_configured(self) -> bool: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors from hashed words; needs no network. A text without words has the null direction."""

    def __init__(self, dimensions: int = 12):
        self.dimensions = dimensions

    def is_configured(self) -> bool:
        return True

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_one(text) for text in texts]

    def embed_one(self, text: str) -> list[float]:
        vector = [0.0] * self.dimensions
        for word in re.findall(r"\w+", text.lower()):
            digest = hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()
            vector[int.from_bytes(digest[:4], "big") % self.dimensions] += 1.0 if digest[4] & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in vector))
        return [round(x / norm, 9) for x in vector] if norm else vector


class HttpEmbedder:
    """Posts batches to ``<url>/embeddings``; three attempts, one and two seconds apart. Vectors come back by ``index``."""

    WAITS = (1.0, 2.0)

    def __init__(self, url: str, model: str, api_key: str, dimensions: int = config.EMBEDDING_DIMENSIONS, timeout: float = 60):
        self.url, self.model, self.api_key, self.dimensions, self.timeout = url.rstrip("/"), model, api_key, dimensions, timeout

    def is_configured(self) -> bool:
        return bool(self.api_key)

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts, "dimensions": self.dimensions}).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        for wait in (*self.WAITS, None):
            try:
                request = urllib.request.Request(f"{self.url}/embeddings", body, headers)
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    data = json.loads(answer.read())["data"]
                return [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
            except Exception:
                if wait is None:
                    raise
                time.sleep(wait)
        raise AssertionError


def with_vectors(rows: DataFrame, provider: EmbeddingProvider, text: str = "content", batch: int = config.EMBEDDING_BATCH) -> DataFrame:
    """The rows with a column ``vector`` of their text, embedded in batches of ``batch``; null texts have a null vector.

    The vector travels in its row, so nothing has to be joined.
    """
    source = spread(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column(text).to_pylist()
            vectors: list[list[float] | None] = [None] * len(texts)
            there = [i for i, t in enumerate(texts) if t is not None]
            for start in range(0, len(there), batch):
                places = there[start : start + batch]
                for i, v in zip(places, provider.embed([texts[i] for i in places])):
                    if len(v) != provider.dimensions:
                        raise ValueError(f"a vector has {len(v)} numbers, not {provider.dimensions}")
                    vectors[i] = v
            column = pa.array(vectors, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "vector"])

    schema = T.StructType([*source.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
    return source.mapInArrow(run, schema)


def embed_column(rows: DataFrame, provider: EmbeddingProvider, key: str = "segment_hash", text: str = "content") -> DataFrame:
    """(id, vector) of each row."""
    return with_vectors(rows.select(F.col(key).alias("id"), F.col(text).alias("text")), provider, "text").select("id", "vector")
