"""Cutting oversized chunks into pieces within a limit, at natural boundaries and with a set overlap.

Cuts are content-defined: a rolling hash over the last 32 characters marks landmarks, and the cut goes to the natural
boundary nearest to the first landmark that leaves the piece at least the minimum size. Landmarks depend on nothing but
the text around them, so after an edit the cuts fall back into place within a piece or two and only neighbouring pieces
change. Boundaries, best first: a line after a blank line, a line without indentation, any line, white space, any
character (but never the middle of a surrogate pair or of CR LF).

Lengths are in UTF-16 code units. Defined results: null contents and contents within the limit have no pieces; a chunk
delivered twice counts once; without a usable ``start_line`` lines are counted back from ``end_line``, and without either
the pieces have null lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelode.config import CHUNK_LIMIT
from trovelode.functions.hashing import segment_hash
from trovelode.functions.text import utf16_length

#: Characters that the rolling hash sees, and the average distance of landmarks (a power of two).
WINDOW, LANDMARK_EVERY = 32, 256


def _landmarks(codes: np.ndarray) -> np.ndarray:
    """Places (between characters) where the hash of the characters before is 0 in its low bits."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    rolled = np.zeros(len(codes), np.uint64)
    for back in range(min(WINDOW, len(codes))):
        rolled[back:] += mixed[: len(codes) - back] << np.uint64(back)
    rolled ^= rolled >> np.uint64(31)
    return np.flatnonzero(rolled & np.uint64(LANDMARK_EVERY - 1) == 0) + 1


def _boundaries(text: str, codes: np.ndarray) -> list[np.ndarray]:
    """Places of each class of boundary, best class first; a better place is in the poorer classes too."""
    lines = np.flatnonzero(codes[:-1] == 10) + 1
    blank = np.isin(codes, (9, 10, 13, 32))
    before = np.concatenate(([0], lines[:-1])) if len(lines) else lines
    words = np.concatenate(([0], np.cumsum(~blank)))
    after_blank = lines[words[lines] == words[before]]
    outer = lines[~blank[lines]]
    return [after_blank, np.union1d(outer, after_blank), lines, np.flatnonzero(blank[:-1]) + 1]


def cut_places(text: str, limit: int, overlap: int = 0, minimum: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of each piece in characters; all of ``text`` when it is within the limit.

    Each piece but the first starts ``overlap`` units before the end of the one before it (one unit less where that would
    be inside a surrogate pair or CR LF).
    """
    if not 0 <= overlap < limit - 2:
        raise ValueError("the overlap must be less than the limit")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    units = np.concatenate(([0], np.cumsum(1 + (codes > 0xFFFF))))
    total = int(units[-1])
    if total <= limit:
        return [(0, len(text))] if text else []
    marks, classes = _landmarks(codes), _boundaries(text, codes)

    def last(unit: int) -> int:
        """The last place at or before so many units that is not inside CR LF."""
        place = int(np.searchsorted(units, unit, "right")) - 1
        return place - 1 if 0 < place < len(codes) and codes[place] == 10 and codes[place - 1] == 13 else place

    pieces, start, cut = [], 0, 0
    while True:
        if total - int(units[start]) <= limit:
            pieces.append((start, len(text)))
            return pieces
        core = limit - int(units[cut] - units[start])
        least = max(1, min(core // 4 if minimum is None else minimum, core - 1))
        low = max(cut + 1, int(np.searchsorted(units, units[cut] + least)))
        high = max(cut + 1, last(int(units[start]) + limit))
        low = min(low, high)
        at = int(np.searchsorted(marks, low))
        mark = int(marks[at]) if at < len(marks) and marks[at] <= high else high
        reach = max(1, (high - low) // 4)
        end = 0
        for known, near in ((classes[0], reach), (classes[1], reach), (classes[2], high), (classes[3], high)):
            inside = known[np.searchsorted(known, low) : np.searchsorted(known, high, "right")]
            if len(inside):
                best = int(inside[np.argmin(np.abs(inside - mark))])
                if abs(best - mark) <= near:
                    end = best
                    break
        if not end:
            end = max(cut + 1, last(int(units[mark])))
        pieces.append((start, end))
        cut = end
        start = int(np.searchsorted(units, units[end] - overlap)) if overlap else end
        if overlap and 0 < start < len(codes) and codes[start] == 10 and codes[start - 1] == 13:
            start += 1
        start = min(max(start, pieces[-1][0] + 1), end)


def split_chunks(chunks: DataFrame, limit: int = CHUNK_LIMIT, overlap: int = 200, minimum: int | None = None) -> DataFrame:
    """The pieces of each chunk longer than ``limit``.

    (segment_hash, file_path, piece_no int from 0, start_line int, end_line int, content, n_units int, piece_hash). Chunks
    within the limit are filtered in the scan's stage and never reach Python; the shuffle that removes repeated deliveries
    carries the oversized ones alone, and combines before it, so many copies of one chunk are no hot group.
    """
    columns = ["segment_hash", "file_path", "start_line", "end_line", "content"]
    long = chunks.select(*columns).where(F.octet_length("content") > limit).where(utf16_length(F.col("content")) > limit)
    once = long.dropDuplicates(columns)
    layout = "segment_hash string, file_path string, piece_no int, start_line int, end_line int, content string, n_units int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, path, first, final, text in zip(*(c.to_pylist() for c in batch.columns)):
                inner = text.count("\n", 0, len(text) - 1)
                base = first if first and first > 0 else final - inner if final and final > inner else None
                for number, (a, b) in enumerate(cut_places(text, limit, overlap, minimum)):
                    start = end = None
                    if base is not None:
                        start = base + text.count("\n", 0, a)
                        end = base + text.count("\n", 0, b - 1)
                    piece = text[a:b]
                    rows.append((name, path, number, start, end, piece, len(piece) + sum(c > "\uffff" for c in piece)))
            names = [part.split()[0] for part in layout.split(", ")]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
            values = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    pieces = once.mapInArrow(run, layout)
    return pieces.withColumn("piece_hash", segment_hash(*(F.col(c) for c in ("file_path", "start_line", "end_line", "content"))))


def oversized(chunks: DataFrame, limit: int = CHUNK_LIMIT) -> DataFrame:
    """(segment_hash): the chunks that :func:`split_chunks` cuts."""
    return split_chunks(chunks, limit).where("segment_hash is not null").select("segment_hash").distinct()
