import random

import pytest

from trovelode import config
from trovelode.operators import chunking, structure
from trovelode.operators.chunking import Piece, chunk_file, chunk_lines, fill_gaps, merge_small, signature, units


def test_constants():
    assert config.CHUNK_LIMIT == 4024
    assert len(config.EXTENSIONS) == 43 and len(config.IGNORED_DIRECTORIES) == 30 and len(config.IGNORED_FILES) == 13
    assert len(config.STRUCTURED_EXTENSIONS) == 44


@pytest.mark.parametrize("n, chunks", [(0, 0), (99, 0), (100, 1), (3500, 1), (4024, 1)])
def test_one_line_sizes(n, chunks):
    assert len(chunk_lines(["x" * n])) == chunks


def test_short_chunk_counts_its_line_ends():
    assert chunk_lines(["x" * 99, ""])[0].text == "x" * 99 + "\n"


def test_overlong_line_is_cut_into_pieces_of_the_same_line():
    found = chunk_lines(["a" * 200, "b" * 4025, "c" * 200])
    assert [(p.start, p.end, len(p.text)) for p in found] == [(1, 1, 200), (2, 2, 3500), (2, 2, 525), (3, 3, 200)]


def test_equal_pieces_of_one_line_are_one_chunk():
    assert len(chunk_lines(["z" * 7000 + "y" * 10])) == 2  # the second piece has the name of the first


def test_surrogate_pairs_are_not_cut():
    found = chunk_lines(["\U0001f600" * 2013])  # 4,026 units
    assert "".join(p.text for p in found) == "\U0001f600" * 2013
    assert all(units(p.text) <= 3500 for p in found)


def test_full_chunks_keep_all_lines():
    random.seed(7)
    for _ in range(200):
        lines = ["w" * random.randint(0, 300) for _ in range(random.randint(1, 80))]
        found = chunk_lines(lines)
        for p in found:
            assert p.text == "\n".join(lines[p.start - 1 : p.end]) and units(p.text) <= 4024
        covered = [i for p in found for i in range(p.start, p.end + 1)]
        assert covered == sorted(set(covered))
        if found and sum(map(len, lines)) > 8000:
            assert covered[0] == 1


def test_small_remainder_takes_lines_from_the_chunk_before():
    lines = ["a" * 99] * 40 + ["b" * 49] * 4
    found = chunk_lines(lines)
    assert len(found) == 2 and units(found[1].text) + 1 >= 300
    assert found[0].end + 1 == found[1].start
    strict = chunk_lines(lines, strict_compat=True)
    assert strict[0].end == found[0].end and len(strict[0].text) > len(found[0].text)


def test_prefix_marks_continuations():
    like = Piece(0, 0, "", "function", "load", "Outer")
    found = chunk_lines(["x" * 99] * 90, "a.ts", 11, like, "// Context: Outer.load\nfunction load() {")
    assert found[0].kind == "function" and found[0].start == 11
    assert all(p.kind == "continuation" and p.scope == "Outer.load" and p.text.startswith("// Context") for p in found[1:])
    assert all(units(p.text) <= 4024 for p in found)


def test_merge_joins_small_neighbours_only():
    a, b = Piece(1, 3, "a" * 120, "gap"), Piece(5, 6, "b" * 130, "gap")
    assert merge_small([a, b]) == [Piece(1, 6, a.text + "\n" + b.text, "gap")]
    assert len(merge_small([a, Piece(6, 7, "b" * 130, "gap")])) == 2  # two lines apart
    assert len(merge_small([Piece(1, 3, "a" * 120, "function", "f"), Piece(4, 5, "b" * 120, "function", "g")])) == 2
    assert len(merge_small([Piece(1, 3, "a" * 400, "gap"), b])) == 2


def test_gaps_use_the_end_of_the_chunk_before():
    lines = ["x" * 60] * 20
    found = fill_gaps("a", lines, [Piece(5, 8, ""), Piece(12, 14, "")])
    assert [(p.start, p.end, p.kind) for p in found] == [(1, 4, "gap"), (9, 11, "gap"), (15, 20, "gap")]


def test_signature_ends_with_the_open_brace():
    assert signature(["f(", "  a,", ") {", "x"], 0, 3) == "f(\n  a,\n) {"
    assert signature(["a", "b", "c", "d", "e", "f"], 0, 5).count("\n") == 4


TYPESCRIPT = """import { x } from './x';

/** Adds numbers. */
export function add(a: number, b: number): number {
  const text = "}";
%s
  return a + b;
}

export class Box {
  value = 0;
  grow(by: number) {
%s
  }
}
"""


def test_typescript_names_and_comments():
    body = "\n".join(f"  // a longer comment about the sum number {i}" for i in range(6))
    found = chunk_file("src/a.ts", TYPESCRIPT % (body, body))
    named = {p.symbol: p for p in found if p.symbol}
    assert set(named) == {"add", "Box"} and named["add"].text.startswith("/** Adds numbers. */")
    assert named["add"].kind == "function" and named["Box"].kind == "class"


def test_large_class_gives_its_methods():
    body = "\n".join(f"    // a longer comment about the sum number {i}" for i in range(60))
    methods = "\n".join(f"  grow{i}(by: number) {{\n{body}\n  }}" for i in range(3))
    found = chunk_file("src/a.mts", f"export class Box {{\n{methods}\n}}\n")
    assert [p.symbol for p in found if p.kind == "method"] == ["grow0", "grow1", "grow2"]
    assert all(p.scope == "Box" for p in found if p.kind == "method")


@pytest.mark.parametrize(
    "path, text, kinds",
    [
        ("a.py", "class A:\n    def f(self):\n        return 1\n\n\n@d\ndef g():\n    return 2\n", ["class", "function", "fallback"]),
        ("a.go", "func F(a int) int {\n\treturn 1\n}\n\nfunc (s *T) G() {\n}\n", ["function", "method"]),
        ("a.rs", "pub fn f() -> u8 {\n  1\n}\nimpl T {\n  fn g(&self) {}\n}\n", ["function", "fallback", "function"]),
        ("A.java", "public class A {\n  public int f() {\n    return 1;\n  }\n}\n", ["class", "method"]),
        ("a.php", "<?php\nfunction f() {\n}\nclass A {\n  public function g() {\n  }\n}\n", ["function", "class", "method"]),
        ("a.rb", "module M\n  class A\n    def f\n    end\n  end\nend\n", ["module", "class", "method"]),
        ("a.c", "static int f(int a)\n{\n  return a;\n}\nint g(int a);\n", ["function"]),
        ("a.md", "# One\ntext\n## Two\nmore\n", ["fallback", "fallback"]),
        ("a.toml", "[a]\nx = 1\n[b]\ny = 2\n", ["module", "module"]),
        ("a.sql", "CREATE TABLE t (\n a INT);\nCREATE FUNCTION f() AS 'x';\n", ["type", "function"]),
        ("a.css", ".a {\n  color: red;\n}\n@media print {\n  .b { color: blue; }\n}\n", ["fallback", "fallback"]),
        ("a.graphql", "type A {\n  b: Int\n}\nenum E {\n  X\n}\n", ["type", "enum"]),
        ("a.vue", "<template>\n  <p>x</p>\n</template>\n<script>\nexport default {}\n</script>\n", ["module", "module"]),
        ("a.html", "<div>\n  <p>x</p>\n</div>\n<br>\n", ["fallback", "fallback"]),
        ("a.xyz", "function f() {}\n", []),
    ],
)
def test_kinds_by_language(path, text, kinds):
    assert [n.kind for n in structure.extract(path, text, text.split("\n"))] == kinds


def test_chunk_files_edge_rows(spark):
    rows = [("a.ts", None), (None, "x"), ("b.ts", ""), ("c.ts", "y" * 150), ("d.ts", "z" * (1024 * 1024 + 1))]
    found = chunking.chunk_files(spark.createDataFrame(rows, "path string, content string")).collect()
    assert [r["file_path"] for r in found] == ["c.ts"]
    assert chunking.chunk_files(spark.createDataFrame([], "path string, content string, extra int")).count() == 0


@pytest.mark.parametrize("path, line", [("a.html", "<br>"), ("a.html", "<p>"), ("a.rb", "def f"), ("a.py", "def f():"), ("a.ts", "function f() {"), ("a.java", "{ /*"), ("a.c", "int f(int a"), ("a.md", "# x"), ("a.css", ".a {")])
def test_time_is_about_linear_in_the_file(path, line):
    import time

    text = "\n".join([line] * (200_000 // (len(line) + 1)))
    began = time.perf_counter()
    chunk_file(path, text)
    assert time.perf_counter() - began < 10


def test_heads_of_any_length():
    from trovelode.operators import structure

    names = ",\n".join(f"  parameter{i}: {{ a: number; b: string }} = {{ a: {i}, b: '' }}" for i in range(60))
    text = f"export class Holder extends {'Base' * 300} {{\n  total(\n{names}\n  ): number {{\n    return 1;\n  }}\n}}\n"
    found = [(n.kind, n.symbol, n.scope) for n in structure.extract("a/x.ts", text, text.split("\n"))]
    assert found == [("class", "Holder", ""), ("method", "total", "Holder")]
    text = f"int total(\n{','.join(f'{chr(10)}    int parameter{i}' for i in range(200))}\n)\n{{\n  return 1;\n}}\n"
    assert [n.kind for n in structure.extract("x.c", text, text.split("\n"))] == ["function"]
    assert structure.extract("x.c", text.replace(")\n{", ");\nstruct x y = {"), text.split("\n")) == []
