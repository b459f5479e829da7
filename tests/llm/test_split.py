import random

import pytest

from trovelode.llm.split import cut_places, oversized, split_chunks

SCHEMA = "segment_hash string, file_path string, start_line int, end_line int, content string, kind string, piece_no int"


def units(text):
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def check(text, limit, overlap):
    places = cut_places(text, limit, overlap)
    assert (places[0][0], places[-1][1]) == (0, len(text))
    assert all(a < b and units(text[a:b]) <= limit for a, b in places)
    for (a, b), (c, d) in zip(places, places[1:]):
        assert a < c <= b < d
        assert overlap - 1 <= units(text[c:b]) <= overlap if limit > 40 and overlap else True
        assert not (text[b - 1 : b] == "\r" and text[b : b + 1] == "\n")
    if not overlap:
        assert "".join(text[a:b] for a, b in places) == text
    return places


@pytest.mark.parametrize("limit, overlap", [(10, 0), (10, 3), (60, 20), (300, 0)])
def test_pieces_cover_the_text(limit, overlap):
    random.seed(limit + overlap)
    for _ in range(150):
        text = "".join(random.choice("ab \n\r\t\U0001f600é") for _ in range(random.randint(1, 700)))
        check(text, limit, overlap)


def test_very_long_text_without_boundaries():
    check("x" * 100_000, 4024, 200)


def test_cuts_are_at_lines_and_an_edit_moves_few():
    random.seed(3)
    text = "".join(f"def f{i}(a):\n    return a + {random.randint(0, 10**6)}\n\n" for i in range(600))
    pieces = {text[a:b] for a, b in check(text, 4024, 0)}
    assert all(p.endswith("\n") for p in pieces)
    edited = text[:400] + "# one more line\n" + text[400:]
    again = {edited[a:b] for a, b in check(edited, 4024, 0)}
    assert len(pieces - again) <= 3


def test_limits():
    assert cut_places("", 10) == [] and cut_places("x" * 10, 10) == [(0, 10)]
    with pytest.raises(ValueError):
        cut_places("abc", 10, 10)


def test_split_edge_rows(spark):
    long, wide = "line\n" * 1000, "\U0001f600" * 2013
    rows = [
        ("a", "f", 10, 1010, long, "k", 1), ("a", "f", 10, 1010, long, "k", 1), ("b", "f", 7, 7, wide, None, 2), ("c", "f", 1, 1, "short", None, 3),
        ("d", "f", None, 1100, long, None, 4), ("e", "f", None, None, long, None, 5), (None, "f", 1, 2, long, None, 6), ("g", None, 1, 1, None, None, 7),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r[0] for r in oversized(df).collect()) == ["a", "b", "d", "e"]
    pieces = split_chunks(df, overlap=0).collect()
    own = sorted((p for p in pieces if p["segment_hash"] == "a"), key=lambda p: p["piece_no"])
    assert "".join(p["content"] for p in own) == long
    assert own[0]["start_line"] == 10 and all(p["end_line"] + 1 == q["start_line"] for p, q in zip(own, own[1:]))
    assert all((p["start_line"], p["end_line"]) == (7, 7) for p in pieces if p["segment_hash"] == "b")
    assert min(p["start_line"] for p in pieces if p["segment_hash"] == "d") == 101
    assert all(p["start_line"] is None for p in pieces if p["segment_hash"] == "e")
    assert split_chunks(df.limit(0)).count() == 0
