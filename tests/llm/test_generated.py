import random

import pytest

from trovelode.llm import generated

CODE = "import { a } from './b';\n\nexport function load(x) {\n  // walks over all entries\n  return a(x) + 1;\n}\n" * 6
RNG = random.Random(1)
NUMBERS = "export const T = [\n" + "\n".join("  [" + ", ".join(f"{RNG.random() * 900:.4f}" for _ in range(8)) + "]," for _ in range(40)) + "\n];\n"
MINIFIED = "".join(f"function {a}(b,c){{return b.{a}x(c)||d{a}}}var {a}1=e(f),g=[\"{a}\",1];" for a in "abcdefghijklmnop") * 2
LOCK = "".join(f"/pkg-{i}/1.2.{i}:\n  resolved: https://r.invalid/p-{i}.tgz\n  integrity: sha512-{'Ab' * 20}{i}==\n  dev: false\n" for i in range(9))
FONT = "@font-face {\n  src: url(data:font/woff2;base64," + "".join(RNG.choice("ABCDabcd0123+/") for _ in range(3000)) + ");\n}\n"


@pytest.mark.parametrize(
    "path, text",
    [
        ("w/src/a.ts", "// Code generated by x-tool 1.2. DO NOT EDIT.\n" + CODE), ("w/src/a.ts", "/*\n * @generated by x from a.proto\n */\n" + CODE),
        ("w/src/a.py", "# <auto-generated>\n#  Produced by x\n# </auto-generated>\nx = 1\n"), ("w/src/a.rs", "// This file was automatically generated from a/b.idl.\n" + CODE),
        ("w/src/a.go", "// Generated from a.yaml on 2021-02-03\npackage a\n"), ("w/a.md", "<!-- auto-generated Produced by x, version 9 /auto-generated -->\n\n# T\n"),
        ("w/src/a.c", "// Dieses Modul wird vom Werkzeug x erzeugt und bei jedem Lauf überschrieben.\n" + CODE), ("w/a.json", '{\n  "//": "Generated from a.idl on 2022-09-28",\n  "b": 1\n}\n'),
        ("w/b.json", '{\n  "_comment": "Autogenerated by x-codegen source: a.yaml",\n  "b": 1\n}\n'), ("w/src/a_pb2.py", "x = 1\n"), ("w/src/AOuterClass.java", CODE), ("w/src/a.py", "K = (\n" + "".join(f'    b"{"Ab3/" * 19}"\n' for _ in range(30)) + ")\n"),
        ("w/src/a.c", "/*\n * Copyright (c) the kit project authors. All rights reserved.\n * Use is governed by the licence in the kit distribution.\n */\n" + CODE), ("w/src/a.ts", "// kit - tiny\n// version: 2.3.4\n// license: MIT\n" + CODE),
        ("w/src/a.js", "/*! x v1.2.3 | (c) the x contributors | MIT */\n" + CODE), ("w/src/a.js", "// Vendored from x 1.2, do not patch here.\n" + CODE),
        ("w/src/a.js", "// upstream: https://x.invalid/y\n// local modifications: none\n" + CODE), ("w/src/a.ts", NUMBERS), ("w/src/a.js", MINIFIED), ("w/src/a.yaml", LOCK), ("w/src/a.css", FONT),
        ("w/src/d.sql", "".join(f"INSERT INTO t VALUES ({i}, 'x', 1.5);\n" for i in range(30))),
        ("w/src/A.java", "public final class A extends AbstractStub {\n" + "".join(f"  public static final int F{i}_FIELD_NUMBER = {i};\n" for i in range(9)) + "}\n"),
    ],
)
def test_cases(path, text):
    assert generated.reasons(path, text)


@pytest.mark.parametrize(
    "path, text",
    [
        ("w/src/a.ts", CODE), ("w/src/a.ts", ""), ("w/src/deps/graph.py", CODE), ("w/external/client.py", CODE), ("w/src/gen/rand.py", CODE), ("w/third_party/a-1.2/b.js", CODE),
        ("w/src/a.py", "# License: MIT\n" + CODE), ("w/src/a.py", "# Copyright (c) the X Project Authors\n" + CODE),
        ("kit/src/a.py", "# Copyright (c) the kit project authors.\n# Licence: see LICENCE in the kit repository\n" + CODE), ("w/src/codegen/a.ts", "// Written by hand; the generated x lives elsewhere.\n" + CODE), ("w/src/vendors/a.ts", CODE),
        ("w/src/a.ts", "// Do not edit the x here, ask the y team first.\n" + CODE), ("w/src/a.ts", "// This module generates the x and must not be edited while it runs.\n" + CODE),
        ("w/src/a.ts", "// Minified output of the x is written to y z.\n" + CODE), ("w/src/a.ts", "// Copyright (c) the w maintainers\n" + CODE),
        ("w/a.toml", "[a]\nchecksum = \"ab12\"\nb = 1\nc = 2\nd = 3\ne = 4\n"), ("w/a.md", "# Vendored code\n\nThis page tells how code generated by tools is kept. " * 30),
        ("w/src/t.ts", "const T = [\n" + "".join(f"  [{i}, {i}.5, {i + 1}, {i + 2}], // why {i}\n" for i in range(14)) + "];\n" + CODE),
        ("w/src/long.ts", CODE + "const s = '" + "plain prose in a string that goes on and on " * 200 + "';\n"), ("w/.env", "A=1\nB=2\n"), ("w/.env.x", "A=1\nK=\"-----BEGIN PRIVATE KEY-----\n" + "\n".join("Ab3/" * 16 for _ in range(25)) + "\n-----END PRIVATE KEY-----\"\n"),
    ],
)
def test_hand_written(path, text):
    assert generated.reasons(path, text) == []


def test_notice_below_a_long_licence():
    licence = "".join(f" * licence text, line {i} of it\n" for i in range(60))
    body = "export const x = compute(other);\n"
    assert generated.reasons("a/x.ts", f"/*\n{licence} * Code generated by tool. DO NOT EDIT.\n */\n{body}") == ["generated header"]
    assert generated.reasons("a/x.ts", f"/*\n{licence} */\n// Upstream: https://x.invalid\n{body}") == ["vendored header"]
    assert generated.reasons("a/x.ts", f"/*\n{licence} */\n{body}// Upstream: https://x.invalid\n") == []


def found(spark, rows):
    df = spark.createDataFrame(rows, "workspace string, path string, content string")
    return {r["path"]: r["reasons"] for r in generated.not_hand_written(df).collect()}


def test_names_count_where_the_corpus_bears_them_out(spark):
    own = [("w", f"w/{d}/f.py", CODE.replace("load", d.replace("/", "_"))) for d in ("src/deps", "external", "src/gen", "third_party/kit")]
    assert found(spark, own) == {}
    header = "// Vendored from kit 1.2, do not patch here.\n"
    stated = [("v", f"v/third_party/kit{i}/f{i}.ts", header + f"export const a{i} = {i};\n") for i in range(4)]
    silent = [("v", "v/third_party/other-1.2/f.ts", CODE), ("v", "v/third_party/own.ts", CODE.replace("load", "own"))]
    got = found(spark, own + stated + silent)
    assert set(got) == {r[1] for r in stated} | {"v/third_party/other-1.2/f.ts", "w/third_party/kit/f.py"}
    assert got["v/third_party/other-1.2/f.ts"] == ["vendored place"] and got[stated[0][1]] == ["vendored header", "vendored place"]


def test_checkouts_of_one_origin_prove_nothing(spark):
    body = [f"export const v{i} = compute({i}, other{i}); // some longer line of code number {i}\n" * 9 for i in range(12)]
    tree = [(f"src/m{i}.ts" if i % 2 else f"lib/m{i}.ts", body[i]) for i in range(10)]
    checkouts = [(w, f"{w}/{p}", t) for w in ("a", "b", "c") for p, t in tree] + [("b", "b/src/new.ts", body[10])]
    assert found(spark, checkouts) == {}
    # The same library in a tree of another origin is a copy in all of them.
    other = [("z", "z/libs/kit/m1.ts", body[1]), ("z", "z/src/own.ts", body[11])]
    assert set(found(spark, checkouts + other)) == {f"{w}/src/m1.ts" for w in "abc"} | {"z/libs/kit/m1.ts"}


def test_equal_long_files_beside_different_short_ones(spark):
    long = "const value = compute(other); // a long enough line of code\n" * 6
    rows = [(w, f"{w}/vnd/{n}.ts", t) for w in "ab" for n, t in (("x", long), ("y", f"export const own{w} = 1;\n"))]
    assert set(found(spark, rows)) == {"a/vnd/x.ts", "b/vnd/x.ts"}
    small = [f"export {{ name{i}, another{i}, third{i} }} from './module{i}/with/a/path/{i}';\n" for i in range(6)]
    rows = [(w, f"{w}/vnd/f{i}.ts", t) for w in "ab" for i, t in enumerate(small)] + [(w, f"{w}/own.ts", f"export const {w} = 1;\n" * 20) for w in "ab"]
    assert set(found(spark, rows)) == {f"{w}/vnd/f{i}.ts" for w in "ab" for i in range(6)}


def test_merkle_finds_shared_subtrees(spark):
    body = [f"export const v{i} = compute({i}, other{i}); // some longer line of code number {i}\n" * 9 for i in range(5)]
    rows = [("a", "a/src/kit/x.ts", body[0]), ("a", "a/src/kit/deep/y.ts", body[1]), ("a", "a/src/own.ts", body[2])]
    rows += [("b", "b/libs/util/x.ts", "// a licence\n" + body[0].replace("\n", "\r\n")), ("b", "b/libs/util/deep/y.ts", body[1]), ("b", "b/libs/mine.ts", body[3])]
    rows += [("c", "c/src/once.ts", body[4]), ("c", "c/src/twice.ts", body[4]), ("c", None, body[4]), ("c", "c/src/null.ts", None)]
    df = spark.createDataFrame(rows + rows[:2], "workspace string, path string, content string").selectExpr("*", "1 as node_hash")
    tree = generated.merkle(generated.judged(df).distinct())
    shared = {(r["path"], r["directory"]) for r in generated.shared_subtrees(tree).collect()}
    assert shared == {
        ("a/src/kit", True), ("a/src/kit/deep", True), ("a/src/kit/x.ts", False), ("a/src/kit/deep/y.ts", False),
        ("b/libs/util", True), ("b/libs/util/deep", True), ("b/libs/util/x.ts", False), ("b/libs/util/deep/y.ts", False),
    }
    found = {r["path"]: r["reasons"] for r in generated.not_hand_written(df).collect()}
    assert set(found) == {"a/src/kit/x.ts", "a/src/kit/deep/y.ts", "b/libs/util/x.ts", "b/libs/util/deep/y.ts"}
    assert all(r == ["shared subtree"] for r in found.values())


def test_short_files_count_in_the_hashes(spark):
    body = "const value = compute(other); // a long enough line of code\n" * 6
    small = [f"export {{ name{i}, another{i}, third{i} }} from './module{i}/with/a/path/{i}';\n" for i in range(6)]
    # "kit" is made of small files alone and shared; "half" has a long shared file and a short one of each workspace.
    rows = [(w, f"{w}/{d}/kit/f{i}.ts", small[i]) for w, d in (("a", "x"), ("b", "y")) for i in range(6)]
    rows += [(w, f"{w}/{d}/half/{name}", text) for w, d in (("a", "x"), ("b", "y")) for name, text in (("long.ts", body), ("own.ts", f"export const own{w} = 1;\n"))]
    rows += [(w, f"{w}/{d}/none/index.ts", "export {};\n") for w, d in (("a", "x"), ("b", "y"))]
    df = spark.createDataFrame(rows, "workspace string, path string, content string")
    found = {r["path"] for r in generated.not_hand_written(df).collect()}
    assert found == {f"{p}/kit/f{i}.ts" for p in ("a/x", "b/y") for i in range(6)} | {"a/x/half/long.ts", "b/y/half/long.ts"}


def test_a_directory_differs_by_names_and_contents(spark):
    body = "const value = compute(other); // a long enough line of code\n" * 6
    rows = [("a", "a/p/q/x.ts", body), ("b", "b/p/q/renamed.ts", body)]
    df = spark.createDataFrame(rows, "workspace string, path string, content string")
    shared = {(r["path"], r["directory"]) for r in generated.shared_subtrees(generated.merkle(generated.judged(df))).collect()}
    assert shared == {("a/p/q/x.ts", False), ("b/p/q/renamed.ts", False)}


def test_empty(spark):
    assert generated.not_hand_written(spark.createDataFrame([], "workspace string, path string, content string")).count() == 0
