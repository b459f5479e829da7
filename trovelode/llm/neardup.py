"""Chunks that are the same up to small edits: all pairs whose shared word runs reach a similarity.

A chunk is the set of its runs of five consecutive words, and similarity is shared runs over all runs of the two. Chunks
with equal sets are one class. Each class has a fingerprint of 1,024 bits, one parity bit for the runs that fall on it, so
the Hamming distance of two fingerprints is at most the number of runs that only one of the two has, and at similarity t
that is at most (1 - t) / (1 + t) times the sum of their sizes. The table of distances to 48 reference fingerprints
(empty, random halves, and those of sampled chunks) is made once; by the triangle inequality a pair whose distances to any
reference differ by more is no pair. Both bounds are strict, so discarding loses nothing. Survivors are verified exactly.

The table can discard a pair but not name one, and all pairs are too many. So the pairs it is asked about come from a
join: two sets of that similarity share a run among the first n - ceil(t n) + 1 of each, in any order common to all.
Rarest first makes these groups small. The join's key also holds the band of the size, the distance to the empty
reference, so that sizes that rule each other out don't meet; runs that many classes share are salted.

Defined results: null contents and texts of fewer than five words have no runs, hence no pair and a class of their own;
a chunk delivered more than once (equal ``segment_hash``) counts once, with the text delivered last; rows with a null
``segment_hash`` are left out. Runs are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovelode.tables import checkpointed, spread

WORDS_IN_A_RUN = 5
FINGERPRINT_BITS = 1024
RANDOM_REFERENCES, CHUNK_REFERENCES = 15, 32
#: Chunks sampled to find runs that are common everywhere and to take references from. It decides the order of the runs
#: and thus speed alone; results don't depend on it.
SAMPLE_ROWS = 20_000
#: A run in so many of the sampled chunks comes last in the order; there are at most (runs of the sample) / (this) of them.
COMMON_IN_SAMPLE = 12
#: Rows of one run and band that one task joins with another; more are dealt out by a salt.
SALTED_FROM = 500
#: Members of a class that are paired as one block; larger classes are dealt into several. Speed alone depends on it.
MEMBERS_IN_A_BLOCK = 1000

_COMMON = 1 << 40
_word = re.compile(r"\w+")


class _Runs:
    """Turns texts into run hashes, many texts at once; one for each task."""

    def __init__(self):
        import xxhash

        self.digest, self.known = xxhash.xxh64_intdigest, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ends): the distinct runs of text i are hashes[ends[i]:ends[i + 1]], in order."""
        if len(self.known) > 500_000:
            self.known.clear()
        known, digest = self.known, self.digest
        words: list[int] = []
        counts = []
        for text in texts:
            found = _word.findall(text.lower()) if text else ()
            for word in found:
                number = known.get(word)
                if number is None:
                    number = known[word] = digest(word.encode("utf-8", "surrogatepass"))
                words.append(number)
            counts.append(len(found))
        of = np.repeat(np.arange(len(texts)), counts)
        values = np.array(words, np.uint64)
        n = max(0, len(values) - WORDS_IN_A_RUN + 1)
        mixed = np.zeros(n, np.uint64)
        for i in range(WORDS_IN_A_RUN):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + values[i : n + i]
        mixed = _mix(mixed)
        inside = of[:n] == of[WORDS_IN_A_RUN - 1 :][:n]
        of, mixed = of[:n][inside], mixed[inside]
        order = np.lexsort((mixed, of))
        of, mixed = of[order], mixed[order]
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (mixed[1:] != mixed[:-1])
        of, mixed = of[fresh], mixed[fresh]
        return mixed, np.searchsorted(of, np.arange(len(texts) + 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, modulo 2**64."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[ends[1:]] - total[ends[:-1]]


def _fingerprints(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of parity bits for each text."""
    rows = len(ends) - 1
    at = np.repeat(np.arange(rows), np.diff(ends)) * FINGERPRINT_BITS + (hashes & np.uint64(FINGERPRINT_BITS - 1)).astype(np.int64)
    return (np.bincount(at, minlength=rows * FINGERPRINT_BITS).reshape(rows, FINGERPRINT_BITS) & 1).astype(np.float32)


def _references(sampled: list[list[int]]) -> np.ndarray:
    """The reference fingerprints: the empty one, random halves from a fixed seed, those of sampled chunks."""
    rng = np.random.default_rng(20240229)
    rows = [np.zeros(FINGERPRINT_BITS, np.float32)]
    rows += [rng.integers(0, 2, FINGERPRINT_BITS).astype(np.float32) for _ in range(RANDOM_REFERENCES)]
    for bits in sampled:
        row = np.zeros(FINGERPRINT_BITS, np.float32)
        row[bits] = 1
        rows.append(row)
    return np.stack(rows)


def _distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distance of each print to each reference."""
    ones = prints.sum(1)[:, None] + references.sum(1)[None, :]
    return (ones - 2 * (prints @ references.T)).astype(np.int16)



def _sampled(texts: DataFrame, total: int) -> tuple[DataFrame, list[list[int]]]:
    """(run) of the runs that are common in a sample, and the set bits of the reference chunks' fingerprints."""
    share = max(1, math.ceil(total / SAMPLE_ROWS))
    sample = texts.where(F.pmod(F.xxhash64("segment_hash", F.lit("sample")), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()
        for batch in batches:
            hashes, ends = runs(batch.column("content").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("segment_hash"), lists], ["segment_hash", "runs"])

    found = sample.mapInArrow(run, "segment_hash string, runs array<long>")
    common = (
        found.select(F.explode("runs").alias("run")).groupBy("run").count().where(F.col("count") >= COMMON_IN_SAMPLE)
    )
    chosen = found.where(F.size("runs").between(50, 400)).orderBy(F.xxhash64("segment_hash"), "segment_hash").limit(CHUNK_REFERENCES).collect()
    bits = [sorted(b for b in set(h) if h.count(b) % 2) for h in ([x & (FINGERPRINT_BITS - 1) for x in r["runs"]] for r in chosen)]
    return common.withColumnRenamed("count", "in_sample"), bits


def _shared_runs(chunks: DataFrame) -> DataFrame:
    """What is needed of all chunks, in two kinds of rows: of each chunk (run null) its class, size and distances; of each
    class the runs that it shares with another, with their place in the order of runs. Written to the checkpoint folder."""
    at = F.col("indexed_at").cast("timestamp") if "indexed_at" in chunks.columns else F.lit(None).cast("timestamp")
    texts = chunks.select("segment_hash", "content", at.alias("at")).where("segment_hash is not null and content is not null")
    common, bits = _sampled(texts, chunks.count())
    references = _references(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, seen = _Runs(), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                hashes, ends = runs(part.column("content").to_pylist())
                sizes = np.diff(ends)
                sums = _sums(hashes, ends) ^ _mix(_sums(_mix(hashes ^ np.uint64(0xD1B54A32D192ED03)), ends))
                classes = _mix(sums + sizes.astype(np.uint64)).view(np.int64)
                table = _distances(_fingerprints(hashes, ends), references)
                fresh = np.zeros(len(classes), bool)  # equal chunks of one task give their runs once
                for i, (c, n) in enumerate(zip(classes.tolist(), sizes.tolist())):
                    if n and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                kept = np.repeat(fresh, sizes)
                offsets = np.concatenate(([0], np.cumsum(sizes * fresh)))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[kept].view(np.int64)))
                width = table.shape[1]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * width, pa.int32()), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("segment_hash"), part.column("at"), pa.array(classes), pa.array(sizes.astype(np.int32)), flat, lists],
                    ["segment_hash", "at", "class", "n", "distances", "runs"],
                )

    layout = "segment_hash string, at timestamp, class long, n int, distances array<short>, runs array<long>"
    found = spread(texts).mapInArrow(run, layout)
    none = F.array(F.lit(None).cast("long"))
    own = F.col("run").isNull()
    rows = found.select("segment_hash", "at", "class", "n", "distances", F.explode(F.concat(none, "runs")).alias("run")).select(
        "class", "n", "run", *[F.when(own, F.col(c)).alias(c) for c in ("segment_hash", "at", "distances")]
    )
    placed = rows.join(F.broadcast(common), "run", "left").withColumn(
        "salt",
        F.when(own, F.pmod(F.xxhash64("segment_hash"), F.lit(4096)) + 1)
        .when(F.col("in_sample").isNotNull(), F.pmod(F.xxhash64("class"), F.lit(4096)) + 1)
        .otherwise(0),
    )
    counted = placed.withColumn("holders", F.count(F.lit(1)).over(Window.partitionBy("run", "salt")))
    place = F.coalesce(F.col("in_sample") + _COMMON, F.col("holders"))
    kept = counted.where(own | F.col("in_sample").isNotNull() | (F.col("holders") > 1))
    return checkpointed(kept.select("class", "n", "run", "segment_hash", "at", "distances", F.when(~own, place).alias("place")))


def _far_apart(a: Column, b: Column, bound: Column) -> Column:
    """Whether some reference shows that the two are further apart than ``bound``."""
    return F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d > bound)


class _Stages(NamedTuple):
    """What a search for pairs goes through: the chunks with their class, and the pairs of classes that the join names, that the
    table leaves, and that are similar."""

    members: DataFrame
    named: DataFrame
    left: DataFrame
    pairs: DataFrame


def _members_and_pairs(chunks: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(class, segment_hash, n) of each chunk and (class_a, class_b, shared) of each pair of classes."""
    stages = _stages(chunks, similarity)
    return stages.members, stages.pairs


def table_counts(chunks: DataFrame, similarity: float) -> DataFrame:
    """One row: (named, left, similar): how many pairs of classes the join names, the table of distances leaves and are similar."""
    stages = _stages(chunks, similarity)
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in (("named", stages.named), ("left", stages.left), ("similar", stages.pairs))]
    return rows[0].union(rows[1]).union(rows[2]).groupBy().pivot("stage", ["named", "left", "similar"]).agg(F.first("n"))


def _stages(chunks: DataFrame, similarity: float) -> _Stages:
    t = similarity
    rows = _shared_runs(chunks)
    own = rows.where("run is null")
    # Of deliveries of a chunk with different texts the last counts, of those at once the greater class.
    last = F.max(F.struct(F.col("at").isNotNull(), "at", "class", "n")).alias("last")
    members = own.groupBy("segment_hash").agg(last).select("segment_hash", "last.class", "last.n")
    table = own.where("n > 0").groupBy("class").agg(F.first("distances").alias("distances"))

    # The runs of a class come from as many partitions, so nothing combines before the shuffle; as plain rows they are smaller.
    flat = rows.where("run is not null").select("class", "n", "place", "run").repartition("class")
    sets = flat.groupBy("class").agg(F.first("n").alias("n"), F.collect_set(F.struct("place", "run")).alias("runs"))
    # Runs that no other class holds come first in the order; what they leave of the prefix is taken from the shared ones.
    reach = F.col("n") - F.ceil(F.col("n") * F.lit(t) - 1e-9) + 1 - (F.col("n") - F.size("runs"))
    sets = checkpointed(sets.withColumn("reach", reach.cast("int")).where("reach > 0"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / t)).cast("int")
    prefix = sets.select("class", "n", band.alias("band"), F.explode(F.slice(F.sort_array("runs"), 1, F.col("reach"))).alias("r")).select(
        "class", "n", "band", F.col("r.run").alias("run")
    )
    meeting = prefix.groupBy("run", "band").count().where(F.col("count") > SALTED_FROM)
    heavy = meeting.groupBy("run").agg((F.max("count") / SALTED_FROM).cast("int").alias("salts"))
    salted = prefix.join(heavy, "run", "left").withColumn("salts", F.coalesce("salts", F.lit(0)))
    left = salted.select(
        "run", "band", F.col("class").alias("class_a"), F.col("n").alias("n_a"), F.pmod(F.xxhash64("class"), F.col("salts") + 1).cast("int").alias("salt")
    )
    right = salted.select(
        "run",
        F.col("class").alias("class_b"),
        F.col("n").alias("n_b"),
        F.col("band").alias("band_b"),
        F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"),
        "salts",
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts"))))
    near = (
        ((F.col("band") < F.col("band_b")) | (F.col("class_a") < F.col("class_b")))
        & (F.col("n_a") >= F.ceil(F.col("n_b") * F.lit(t) - 1e-9))
        & (F.col("n_b") >= F.ceil(F.col("n_a") * F.lit(t) - 1e-9))
    )
    asked = left.join(right, ["run", "band", "salt"]).where(near).select("class_a", "n_a", "class_b", "n_b").distinct()
    bound = (F.col("n_a") + F.col("n_b")) * F.lit((1 - t) / (1 + t)) + 1e-9
    survivors = (
        asked.join(table.select(F.col("class").alias("class_a"), F.col("distances").alias("distances_a")), "class_a")
        .join(table.select(F.col("class").alias("class_b"), F.col("distances").alias("distances_b")), "class_b")
        .where(~_far_apart(F.col("distances_a"), F.col("distances_b"), bound))
        .select("class_a", "n_a", "class_b", "n_b")
    )
    held = sets.select("class", F.transform("runs", lambda r: r["run"]).alias("runs"))
    verified = (
        survivors.join(held.select(F.col("class").alias("class_a"), F.col("runs").alias("runs_a")), "class_a")
        .join(held.select(F.col("class").alias("class_b"), F.col("runs").alias("runs_b")), "class_b")
        .withColumn("shared", F.size(F.array_intersect("runs_a", "runs_b")))
        .where(F.col("shared") >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * F.lit(t) - 1e-9)
    )
    pairs = verified.select(
        F.least("class_a", "class_b").alias("class_a"),
        F.greatest("class_a", "class_b").alias("class_b"),
        "shared",
        (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("similarity"),
    )
    return _Stages(members, asked, survivors, pairs)


def similar_pairs(chunks: DataFrame, similarity: float = 0.6, all_pairs_up_to: int | None = None) -> DataFrame:
    """(segment_hash_a, segment_hash_b), a < b: the pairs of different chunks of at least the similarity.

    All members of all classes are paired, however large a class is. Classes are dealt into blocks of members, and each
    pair of blocks is a group of the join of its own, so a hot class is spread over the tasks.

    A caller may set ``all_pairs_up_to`` to have less: of classes with more members each is then paired with the first of
    them, which stands for them in pairs with other texts.
    """
    members, pairs = _members_and_pairs(chunks, similarity)
    sizes = members.where("n > 0").groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("segment_hash").alias("first"))
    pairs = checkpointed(pairs.select("class_a", "class_b"))
    several = sizes.where("copies > 1")
    needed = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).union(several.select("class")).distinct()
    # Only classes that have a partner or copies go on, which are few; their members are found once.
    known = checkpointed(members.join(needed, "class", "left_semi").join(sizes, "class").select("class", "segment_hash", "copies", "first"))
    standing, linked = known, None
    if all_pairs_up_to is not None:
        standing = known.where((F.col("copies") <= all_pairs_up_to) | (F.col("segment_hash") == F.col("first")))
        linked = known.where((F.col("copies") > all_pairs_up_to) & (F.col("segment_hash") != F.col("first"))).select(
            F.col("first").alias("s_a"), F.col("segment_hash").alias("s_b")
        )
    blocks = F.ceil(F.col("copies") / MEMBERS_IN_A_BLOCK).cast("int")
    dealt = standing.select("class", "segment_hash", F.pmod(F.xxhash64("segment_hash"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
    counts = dealt.groupBy("class").agg(F.max("blocks").alias("blocks"), F.count(F.lit(1)).alias("standing"))
    counts = checkpointed(counts)
    within = counts.where("standing > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    of = [counts.select(F.col("class").alias(f"class_{x}"), F.col("blocks").alias(f"blocks_{x}")) for x in "ab"]
    met = (
        pairs.union(within)
        .join(of[0], "class_a")
        .join(of[1], "class_b")
        .withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)))
        .withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
        .where("class_a != class_b or block_a <= block_b")
        .select("class_a", "block_a", "class_b", "block_b")
    )
    sides = [
        met.join(dealt.select(F.col("class").alias(f"class_{x}"), F.col("block").alias(f"block_{x}"), F.col("segment_hash").alias(f"s_{x}")), [f"class_{x}", f"block_{x}"])
        for x in "ab"
    ]
    found = (
        sides[0]
        .join(sides[1], ["class_a", "block_a", "class_b", "block_b"])
        .where("class_a != class_b or block_a != block_b or s_a < s_b")
        .select("s_a", "s_b")
    )
    found = found if linked is None else found.union(linked)
    return found.select(F.least("s_a", "s_b").alias("segment_hash_a"), F.greatest("s_a", "s_b").alias("segment_hash_b"))


def similar_groups(chunks: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(segment_hash, class_id string, group_id string, n_links long): groups that links of the similarity connect.

    ``class_id`` and ``group_id`` are the least ``segment_hash`` of the chunks with the same runs and of the whole group; a chunk
    without runs is a class and group of its own. ``n_links`` counts the other chunks that a chunk is similar to, copies
    included.
    """
    members, pairs = _members_and_pairs(chunks, similarity)
    members = checkpointed(members)
    pairs = checkpointed(pairs.select("class_a", "class_b"))
    copies = members.where("n > 0").groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("segment_hash").alias("first"))
    links = pairs.union(pairs.select("class_b", "class_a")).toDF("class", "other")
    linked = links.join(copies.select(F.col("class").alias("other"), "copies"), "other").groupBy("class").agg(F.sum("copies").alias("others"))
    groups = connected(pairs)
    # Only classes with a partner are in ``groups``, which are few.
    least = groups.join(copies, "class").groupBy("group").agg(F.min("first").alias("group_id"))
    known = copies.join(groups, "class", "left").join(least, "group", "left").join(linked, "class", "left").select(
        "class",
        F.col("first").alias("class_id"),
        F.coalesce("group_id", "first").alias("group_id"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    own = F.col("segment_hash")
    return members.withColumn("class", F.when(F.col("n") > 0, F.col("class"))).join(known, "class", "left").select(
        "segment_hash", F.coalesce("class_id", own).alias("class_id"), F.coalesce("group_id", own).alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def connected(edges: DataFrame) -> DataFrame:
    """(class, group): the least node of the connected component of each node of the edges (two columns of longs).

    Large-star and small-star steps in turn, until nothing changes: the number of rounds is about the logarithm of the
    number of nodes. Each step is a group by with partial aggregation and a join; a node with very many neighbours makes
    no list.
    """
    a, b = edges.columns
    current = checkpointed(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())

    def star(links: DataFrame, both: bool) -> DataFrame:
        """Links each neighbour (``both``: each larger one) of a node to the least of the node and its neighbours."""
        around = links.union(links.select("v", "u")) if both else links.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = around.join(least, "u")
        moved = joined.where("v > u" if both else "true").select(F.col("m").alias("u"), F.col("v"))
        if not both:
            moved = moved.union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
        return moved.where("u != v").distinct()

    while True:
        after = checkpointed(star(star(current, True), False))
        if after.exceptAll(current).isEmpty() and current.exceptAll(after).isEmpty():
            break
        current = after
    return current.select(F.col("v").alias("class"), F.col("u").alias("group")).union(current.select("u", "u").distinct())
