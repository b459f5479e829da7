import random
import re

import pytest

from trovelode.llm import neardup
from trovelode.tables import table


def runs(text):
    words = re.findall(r"\w+", text.lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows, t):
    sets = {h: runs(text) for h, text in rows if h is not None and text is not None}
    names = sorted(h for h in sets if sets[h])
    return {
        (a, b)
        for i, a in enumerate(names)
        for b in names[i + 1 :]
        if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9
    }


def found(spark, rows, t, **more):
    df = spark.createDataFrame([(h, x, "clash", 1) for h, x in rows], "segment_hash string, content string, run string, n int")
    pairs = [(r[0], r[1]) for r in neardup.similar_pairs(df, t, **more).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    return set(pairs)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        rng.choice([lambda: words.pop(i), lambda: words.insert(i, f"new{rng.random()}"), lambda: words.__setitem__(i, "other")])()
    return " ".join(words)


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_pairs_are_those_of_brute_force(spark, t):
    rng = random.Random(11)
    rows = []
    for g in range(25):
        base = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(8, 120))]
        rows += [(f"{g:02d}-{i}", edited(base, rng, rng.choice([0, 0, 1, 2, 4, 9]))) for i in range(4)]
    rows += [(None, rows[0][1]), ("null", None), ("empty", ""), ("short", "only four words here"), rows[0]]
    assert found(spark, rows, t) == brute(rows, t)


def test_given_table(spark, data):
    chunks = table(spark, data, "chunks")
    rows = {(r[0], r[1]) for r in chunks.select("segment_hash", "content").collect()}
    got = {(r[0], r[1]) for r in neardup.similar_pairs(chunks, 0.6).collect()}
    assert got == brute(rows, 0.6)


def test_hot_runs_are_salted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SALTED_FROM", 3)
    rng = random.Random(5)
    head = [f"licence{i}" for i in range(12)]
    rows = [(f"{i:03d}", edited(head, rng, 1)) for i in range(40)]
    assert found(spark, rows, 0.6) == brute(rows, 0.6)


def test_large_class_of_copies_is_linked_to_its_first(spark):
    rows = [(f"{i:02d}", "one two three four five six seven") for i in range(12)] + [("zz", "one two three four five six seven eight")]
    assert found(spark, rows, 0.6, all_pairs_up_to=5) == {("00", f"{i:02d}") for i in range(1, 12)} | {("00", "zz")}
    assert len(found(spark, rows, 0.6)) == 13 * 12 // 2


def test_large_class_gives_all_pairs(spark):
    same = [(f"{i:04d}", ("One two, three four five six seven", "one two three four (five) six seven")[i % 2]) for i in range(1001)]
    rows = same + [("zz", "one two three four five six seven eight")]
    df = spark.createDataFrame(rows, "segment_hash string, content string")
    pairs = neardup.similar_pairs(df, 0.6)
    assert pairs.distinct().count() == pairs.count() == 1002 * 1001 // 2
    assert pairs.where("segment_hash_b = 'zz'").count() == 1001


def test_classes_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS_IN_A_BLOCK", 3)
    texts = ["one two three four five six seven", "one two three four five six seven eight", "something else that has nothing in common"]
    rows = [(f"{i:02d}", texts[i % 5 % 3]) for i in range(40)]
    assert found(spark, rows, 0.6) == brute(rows, 0.6)


def test_distances_never_discard_a_pair():
    import numpy as np

    runs_of = neardup._Runs()
    rng = random.Random(2)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(10, 300))]
        texts += [" ".join(base), edited(base, rng, 3)]
    hashes, ends = runs_of(texts)
    table_ = neardup._distances(neardup._fingerprints(hashes, ends), neardup._references([[1, 2, 3]])).astype(int)
    for i in range(0, len(texts), 2):
        a, b = set(hashes[ends[i] : ends[i + 1]]), set(hashes[ends[i + 1] : ends[i + 2]])
        assert np.abs(table_[i] - table_[i + 1]).max() <= len(a ^ b)


def test_of_different_deliveries_the_last_counts(spark):
    old, new = "one two three four five six seven", "some other words that are not like those"
    rows = [("a", old, "2024-01-01"), ("a", new, "2024-02-01"), ("b", old, "2024-01-05"), ("c", new, None), ("c", old, "2024-01-02")]
    df = spark.createDataFrame(rows, "segment_hash string, content string, indexed_at string").selectExpr("segment_hash", "content", "to_timestamp_ntz(indexed_at) as indexed_at")
    assert [tuple(r) for r in neardup.similar_pairs(df, 0.6).collect()] == [("b", "c")]


def test_groups(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [("a", text), ("b", text), ("c", text + " fourteen"), ("d", "something else entirely that is not at all like it"), ("e", None), ("f", "few words")]
    df = spark.createDataFrame(rows, "segment_hash string, content string")
    by = {r["segment_hash"]: r for r in neardup.similar_groups(df, 0.8).collect()}
    assert set(by) == {"a", "b", "c", "d", "f"}
    assert by["a"]["group_id"] == by["b"]["group_id"] == by["c"]["group_id"] != by["d"]["group_id"]
    assert [by[x]["class_id"] for x in "abcdf"] == ["a", "a", "c", "d", "f"] and [by[x]["group_id"] for x in "abcdf"] == ["a", "a", "a", "d", "f"]
    assert [by[x]["n_links"] for x in "abcdf"] == [2, 2, 2, 0, 0]


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in neardup.connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert got == want


def test_empty(spark):
    empty = spark.createDataFrame([], "segment_hash string, content string")
    assert neardup.similar_pairs(empty).count() == 0 and neardup.similar_groups(empty).count() == 0
