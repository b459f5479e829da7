import base64
import random

import pytest

from trovelode.llm import bpe
from trovelode.tables import table

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(open(PATH, "rb").read())


def test_random_texts(own, reference):
    rng = random.Random(1)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", " \n\tab", "éüñß漢字😀", "0123456789", "'s're \u00a0\u2028!?<>{}=_", "aeiou\u0301\u200b"]
    for _ in range(1500):
        letters = "".join(rng.sample(alphabets, rng.randint(1, 3)))
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text) and own.decode(ids) == text and own.count(text) == len(ids)


@pytest.mark.parametrize("text", ["a" * 30_000, "xyz" * 9_000, " " * 5_000 + "x", "é" * 9_000, "<|endoftext|>", "\x00\ufffd"])
def test_long_and_odd_texts(own, reference, text):
    assert own.encode(text) == reference.encode_ordinary(text)


def test_compatibility_agrees_with_merging(own):
    rng = random.Random(3)
    ids = sorted(own.bytes_of)
    for _ in range(20_000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert own.compatible(a, b) == (own.merged(own.bytes_of[a] + own.bytes_of[b]) == [a, b])


def test_work_is_linear(own):
    import time

    def seconds(n):
        text = "".join(random.Random(5).choice("abcdefgh") for _ in range(n))
        began = time.perf_counter()
        own.encode_piece(text)
        return time.perf_counter() - began

    seconds(20_000)
    assert seconds(80_000) < 20 * max(seconds(20_000), 0.01)


def test_edge_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "z", None), (4, "w" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_column(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    found = sorted(((r[0] or 0, r[1]) for r in got.collect()), key=lambda x: (x[0], x[1] is None))
    assert [x[0] for x in found] == [0, 1, 1, 2, 3, 4]
    assert found[3][1] is None and found[4][1] == [] and found[1] == found[2]
    back = {r[0]: r[1] for r in bpe.decode_column(got).collect()}
    assert back == {1: "a b", 2: None, 3: "", None: "z", 4: "w" * 200_000}
    assert bpe.encode_column(df.limit(0)).count() == 0


def test_given_documents(spark, data, reference):
    texts = {r[0]: r[1] for r in table(spark, data, "documents").select("doc_id", "text").collect()}
    for r in bpe.encode_column(table(spark, data, "documents")).collect():
        text = texts[r["doc_id"]]
        assert r["ids"] == (None if text is None else reference.encode_ordinary(text))


def test_tables_of_pairs_start_anew(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 50)
    own = bpe.Encoder(open(PATH, "rb").read())
    text = " ".join(f"wørd{i}-xyz_{i * 7}Ab" for i in range(200))
    assert own.encode(text) == reference.encode_ordinary(text) and len(own.compatible_pairs) <= 50
