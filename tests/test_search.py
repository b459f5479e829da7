import math
import random

import numpy as np
import pytest

from trovelode.operators import diff, fulltext, fusion, grep, vector
from trovelode.sources.embed import HashEmbedder, embed_column

FILES = "path string, content string"


def windows(spark, text, query, **more):
    df = spark.createDataFrame([("a", text), ("b", None), (None, text)], FILES)
    return sorted((r["start_line"], r["end_line"], r["code_chunk"]) for r in grep.content_windows(df, query, **more).collect())


def brute(text, query, context, sensitive):
    lines = text.split("\n")
    lines = lines[:-1] if text.endswith("\n") else lines
    hit = [i for i, x in enumerate(lines) if (query in x if sensitive else query.lower() in x.lower())]
    near = sorted({j for i in hit for j in range(max(0, i - context), min(len(lines), i + context + 1))})
    found = []
    for i in near:
        if found and found[-1][1] == i:
            found[-1] = (found[-1][0], i + 1)
        else:
            found.append((i + 1, i + 1))
    return [(a, b, "\n".join(lines[a - 1 : b])) for a, b in found]


def test_windows_are_those_of_brute_force(spark):
    rng = random.Random(1)
    for context in (0, 1, 2):
        text = "\n".join(rng.choice(["foo", "Foo bar", "", "zap"]) for _ in range(60)) + rng.choice(["", "\n"])
        assert windows(spark, text, "zap", context=context) == brute(text, "zap", context, False)
        assert windows(spark, text, "Foo", context=context) == brute(text, "Foo", context, True)


def test_blank_query_and_empty_files(spark):
    assert windows(spark, "a\nb", " ") == [] and windows(spark, "", "a") == []


def test_grep_prefix_is_a_path_and_names_fill_in(spark):
    df = spark.createDataFrame([("src/lock.ts", "none"), ("srcx/a.ts", "lock"), ("src/b.ts", "a lock")], FILES)
    found = [(r["file_path"], r["score"]) for r in grep.grep(df, "lock", "src").collect()]
    assert found == [("src/b.ts", 1.0), ("src/lock.ts", 0.9)]


def test_later_delivery_counts(spark):
    rows = [("a", "zap", 1), ("a", "nothing", 2), ("b", "nothing", 1), ("b", "zap", 2)]
    df = spark.createDataFrame(rows, "path string, content string, scanned_at int")
    assert [r["file_path"] for r in grep.content_windows(df, "zap").collect()] == ["b"]


CHUNKS = "segment_hash string, file_path string, start_line int, end_line int, content string"


def test_bm25_by_hand(spark):
    texts = ["alpha beta beta", "alpha", "gamma delta epsilon zeta", None, ""]
    df = spark.createDataFrame([(str(i), f"f{i}", 1, 1, t) for i, t in enumerate(texts)], CHUNKS)
    got = {r["segment_hash"]: r["score"] for r in fulltext.search(df, "Beta alpha!").collect()}
    n, average = 4, 8 / 4

    def part(tf, df_, length):
        return math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))

    assert got == {"0": pytest.approx(part(2, 1, 3) + part(1, 2, 3)), "1": pytest.approx(part(1, 2, 1))}
    assert fulltext.search(df, "...").count() == 0


def test_vector_search_and_degenerate_vectors(spark):
    chunks = spark.createDataFrame([(x, x, 1, 1, "t") for x in "abcd"], CHUNKS)
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 0.0]), ("d", None), ("a", [0.0, 1.0]), (None, [1.0, 0.0]), ("zz", [1.0, 0.0])],
        "id string, vector array<float>",
    )
    found = [(r["segment_hash"], round(r["score"], 4)) for r in vector.search(chunks, vectors, [1.0, 0.0]).collect()]
    assert found == [("a", 1.0), ("b", 0.6)]


def test_many_queries_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    data = rng.normal(size=(120, 6)).astype(np.float32)
    data[7] = data[8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(500, None), (501, [0.0] * 6)], "vec_id long, embedding array<float>")
    got = vector.search_many(df.repartition(3), df.where("vec_id % 10 = 0"), k=5).collect()
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1)[:, None]
    for q in range(0, 120, 10):
        scores = np.round(unit @ unit[q], 9)
        want = np.lexsort((np.arange(120), -scores))[:5].tolist()
        assert [r["neighbour_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_fusion_first_payload_and_repeats(spark):
    rows = [(0, 1.0, "a", 1), (0, 1.0, "b", 2), (0, 1.0, "a", 3), (1, 0.5, "b", 1), (1, None, "c", 2)]
    df = spark.createDataFrame([(c, w, p, 1, 1, r, f"{p}{c}{r}") for c, w, p, r in rows], "channel int, weight double, file_path string, start_line int, end_line int, rank_no int, code_chunk string")
    got = fusion.fuse(df, payload=("code_chunk",)).collect()
    assert [(r["file_path"], r["code_chunk"]) for r in got] == [("a", "a01"), ("b", "b02"), ("c", "c12")]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 63) and got[1]["score"] == pytest.approx(1 / 62 + 0.5 / 61) and got[2]["score"] == pytest.approx(1 / 62)
    again = fusion.fuse(df.repartition(7), payload=("code_chunk",)).collect()
    assert again == got


def test_diff_and_upsert(spark):
    previous = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4")], "path string, file_hash string")
    current = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("e", "5")], "path string, file_hash string")
    got = {r["path"]: r["status"] for r in diff.diff(previous, current).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "deleted", "e": "added"}
    base = spark.createDataFrame([("1", "old"), ("2", "old"), (None, "old")], "segment_hash string, content string")
    new = spark.createDataFrame([("2", "new"), ("2", "new"), ("3", "new")], "segment_hash string, content string")
    assert sorted(map(str, diff.upsert(base, new).collect())) == sorted(map(str, [base.collect()[0], base.collect()[2], *new.collect()]))


def test_embedding_keeps_null_texts(spark):
    df = spark.createDataFrame([("a", "some words"), ("b", None), ("c", "")], "segment_hash string, content string")
    got = {r["id"]: r["vector"] for r in embed_column(df, HashEmbedder(5)).collect()}
    assert got["b"] is None and got["c"] == [0.0] * 5 and abs(sum(x * x for x in got["a"]) - 1) < 1e-6


def test_numbers_of_a_hot_group(spark):
    from trovelode.tables import numbered

    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), f"{rng.random():.9f}") for _ in range(3000)]
    got = numbered(spark.createDataFrame(rows, "g string, x string").repartition(5), "g", ["x"]).collect()
    for group in ("hot", "a", None):
        own = sorted((r["n"], r["x"]) for r in got if r["g"] == group)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [x for _, x in own] == sorted(x for _, x in own)
    assert len(got) == 3000
