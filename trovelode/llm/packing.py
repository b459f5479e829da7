"""Filling containers of one capacity, in tokens, with texts.

Only the number of texts of each length decides which lengths share a container, and there are at most ``capacity``
lengths. So Spark counts the texts by length, the plan is made on that bounded histogram, and Spark then deals the texts
of each length out to the places that the plan has for it.

The plan is Martello and Toth's reduction on counts: the longest length is fixed together with the partner that provably
dominates every other choice, or alone if nothing fits beside it, as long as there is such a length; what is left goes
best-fit, longest first.

Defined results: a text longer than the capacity is cut into full containers and a rest, other texts are never cut. Null
and empty texts have 0 tokens and no container (null). Each row is an item of its own, also repeated rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelode.llm.bpe import encoder, shipped
from trovelode.tables import checkpointed, spread

#: Texts that share a length are numbered in buckets of about this many rows.
BUCKET_ROWS = 50_000

#: A container's lengths with how often it has each, and the number of such containers.
Pattern = tuple[list[tuple[int, int]], int]


def token_counts(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long): 0 for null and empty texts."""
    vocabulary = shipped(documents.sparkSession, path)
    source = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary.value)
        for batch in batches:
            counts = [own.count(v) if v else 0 for v in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64())], ["key", "n_tokens"])

    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("n_tokens", T.LongType())])
    return source.mapInArrow(run, schema)


def dominated_sets(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets that belong to some best packing, with what is left of the counts.

    Beside the longest length w, with room r = capacity - w: if no length fits in r, w stays alone. Otherwise let s be the
    longest that fits. If no lengths together come to more than s and at most r, then whatever else would go beside w
    fits in the place of s, so {w, s} dominates all other sets with w. With s = r that is always so.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(counts)
    fixed: list[Pattern] = []

    def take(size: int, n: int) -> None:
        counts[size] -= n
        if not counts[size]:
            del counts[size]
            sizes.pop(bisect_left(sizes, size))

    below = capacity + 1
    while (at := bisect_left(sizes, below) - 1) >= 0:
        w = sizes[at]
        room, n = capacity - w, counts[w]
        best = bisect_left(sizes, room + 1) - 1
        if best == at and n == 1:  # w itself would fit beside w, but there is no second
            best -= 1
        if best < 0:
            fixed.append(([(w, 1)], n))
            take(w, n)
        elif sizes[best] == room or not _sum_between(sizes[: best + 1], sizes[best], room):
            s = sizes[best]
            if s == w:
                fixed.append(([(w, 2)], n // 2))
                take(w, n // 2 * 2)
            else:
                both = min(n, counts[s])
                fixed.append(([(w, 1), (s, 1)], both))
                take(w, both)
                take(s, both)
        else:
            below = w
    return fixed, counts


def _sum_between(sizes: list[int], low: int, high: int) -> bool:
    """Whether some of the sizes, each as often as one likes, together come to more than ``low`` and at most ``high``."""
    window = (1 << high + 1) - 1
    sums = 1  # bit i: i can be reached
    for size in sizes:
        step = size
        while step <= high:
            sums |= sums << step & window
            step *= 2
        if sums >> low + 1:
            return True
    return False


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: what placing the items one by one, longest first, would give."""
    open_by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern) -> None:
        if room not in open_by_room:
            insort(rooms, room)
        open_by_room.setdefault(room, []).append(pattern)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                content, copies = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            else:
                room, content, copies = capacity, [], left
            each = min(room // size, left)
            used = min(copies, left // each)
            put(room - each * size, (content + [(size, each)], used))
            if used < copies and content:
                put(room, (content, copies - used))
            left -= used * each
    return [pattern for group in open_by_room.values() for pattern in group]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """The containers to use for so many items of each length (1..capacity)."""
    fixed, rest = dominated_sets(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first container, places of the length in each container) for each part of a plan."""
    ranks: dict[int, int] = {}
    rows, container = [], 0
    for content, copies in patterns:
        for size, each in content:
            low = ranks.get(size, 0)
            ranks[size] = low + each * copies
            rows.append((size, low, low + each * copies, container, each))
        container += copies
    return rows


def pack(
    documents: DataFrame, capacity: int = 2048, path: str | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, part int, first_token long, n_tokens long, container_id long): the container of each text, or part of one.

    The driver gets the histogram of lengths, at most ``capacity`` rows whatever the corpus, and broadcasts the plan made
    of it, whose size also depends on the capacity alone. A length that a third of all texts have is numbered in many
    buckets, so it makes no hot task.
    """
    spark = documents.sparkSession
    counted = checkpointed(token_counts(documents, path, key, text))
    first = F.explode(F.expr(f"sequence(0L, greatest(n_tokens - 1, 0L), {capacity}L)"))
    items = (
        counted.withColumn("first_token", first)
        .withColumn("size", F.least(F.lit(capacity), F.col("n_tokens") - F.col("first_token")))
        .withColumn("part", (F.col("first_token") / capacity).cast("int"))
    )
    histogram = {r["size"]: r["count"] for r in items.where("size > 0").groupBy("size").count().collect()}
    layout = "size long, low long, high long, first_container long, each long"
    planned = spark.createDataFrame(places(plan(histogram, capacity)), layout)

    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    placed = items.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("size", "bucket").count().select(
        "size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    within = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("key", "part"))
    ranked = placed.withColumn("n", within).join(starts, ["size", "bucket"]).withColumn("rank", F.col("start") + F.col("n") - 1)
    dealt = (
        ranked.join(F.broadcast(planned.withColumnRenamed("size", "length")), F.expr("size = length and rank >= low and rank < high"))
        .withColumn("container_id", F.col("first_container") + F.expr("(rank - low) div each"))
    )
    columns = [F.col("key").alias(key), "part", "first_token", F.col("size").cast("long").alias("n_tokens")]
    return dealt.select(*columns, "container_id").unionByName(
        items.where("size <= 0").select(*columns, F.lit(None).cast("long").alias("container_id"))
    )


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: (containers, tokens, least_containers, fill): how far the packing is from the bound tokens / capacity."""
    total = packed.agg(F.coalesce(F.max("container_id") + 1, F.lit(0)).alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return total.withColumn("least_containers", F.ceil(F.col("tokens") / capacity)).withColumn(
        "fill", F.round(F.col("tokens") / F.greatest(F.lit(1), F.col("containers") * capacity), 6)
    )
