import json
from pathlib import Path

import pytest

from trovelode.engine import Engine, Workspaces
from trovelode.operators import chunking
from trovelode.sources import ignore, scan
from trovelode.sources.embed import HashEmbedder
from trovelode.sources.store import Busy, IndexMissing, Lock, Meta, Store
from trovelode.streaming import ingest


@pytest.mark.parametrize(
    "rules, path, expected",
    [
        ("*.log", "a/b.log", True), ("*.log", "a/b.txt", False), ("/build", "build/x", True), ("/build", "a/build/x", False),
        ("docs/", "a/docs/x", True), ("docs/", "docs", False), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("!keep.log\n*.log", "keep.log", True),
        ("*.log\n!keep.log", "x/keep.log", False), ("# x\n\nfoo", "foo", True), ("file[0-9].c", "file7.c", True), ("a?c", "abc", True), ("a?c", "a/c", False),
        ("\\#x", "#x", True), ("a.c", "abc", False),
    ],
)
def test_ignore_rules(spark, rules, path, expected):
    compiled = ignore.compile_rules(rules)
    assert ignore.is_ignored(path, compiled) is expected
    row = spark.createDataFrame([(path,)], "path string").select(ignore.ignored(__import__("pyspark").sql.functions.col("path"), compiled)).first()
    assert row[0] is expected


def test_nested_patterns_are_anchored_unless_asked():
    assert ignore.nested("foo\n!bar\n/baz\n# c", "sub") == "sub/foo\n!sub/bar\nsub/baz"
    assert ignore.nested("foo", "sub", git_semantics=True) == "sub/**/foo"


BODY = "\n".join(f"  total += {i}; // ledger entry" for i in range(12))


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "src/alpha.ts": f"export function alphaLoader(total: number) {{\n{BODY}\n}}\n",
        "src/odd name+1.py": "def gamma(a):\n" + "\n".join(f"    a += {i}  # harbor master" for i in range(20)) + "\n",
        "node_modules/x.js": "ledger\n" * 40, "src/skip.log.ts": "ledger\n" * 40, "src/sub/.gitignore": "hidden.ts\n", "src/sub/hidden.ts": "ledger\n" * 40,
        ".gitignore": "*.log.ts\n", "big.ts": "x" * (1024 * 1024 + 1), "notes.bin": "ledger",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "bytes.md").write_bytes(b"# caf\xe9 ledger\n")
    return root


def test_scan(spark, tree):
    found = {r["path"]: r for r in scan.read_tree(spark, str(tree)).collect()}
    assert set(found) == {"src/alpha.ts", "src/odd name+1.py", "bytes.md"}
    for name in ("src/__init__.py", "src/_private/x.py", ".env.example", ".hidden/y.ts", "src/_skip.log.ts"):
        (tree / name).parent.mkdir(exist_ok=True)
        (tree / name).write_text("a = 1\n")
    assert {r["path"] for r in scan.read_tree(spark, str(tree)).collect()} == set(found) | {"src/__init__.py", "src/_private/x.py", ".env.example", ".hidden/y.ts"}
    assert [r["path"] for r in scan.read_tree(spark, str(tree), path="src/_private/x.py").collect()] == ["src/_private/x.py"]
    assert found["bytes.md"]["content"] == "# caf\ufffd ledger\n"


def test_engine_life(spark, tree):
    engine = Engine(spark, str(tree), HashEmbedder(8))
    told = []
    engine.on_progress(lambda state: told.append(state.status))
    engine.on_progress(lambda state: 1 / 0)
    assert not engine.has_index() and engine.search("ledger", "fts").count() == 0
    assert engine.search("ledger").first()["file_path"] == "bytes.md"  # grep, as there is no index
    assert not Path(engine.store.folder).exists()  # searching writes nothing
    assert engine.index().status == "indexed" and told[-1] == "indexed"
    assert {r[0] for r in engine.list_files().collect()} == {"src/alpha.ts", "src/odd name+1.py"}
    assert engine.stats() == {"file_count": 3, "stored_files": 2}
    for mode in ("hybrid", "vector", "fts", "grep"):
        assert engine.search("ledger", mode).columns == ["file_path", "start_line", "end_line", "code_chunk", "score", "rank"]
    assert [r[0] for r in engine.search("harbor", "fts").collect()] == ["src/odd name+1.py"]
    assert engine.search("  ").count() == 0
    first = engine.store.generation()
    (tree / "src/alpha.ts").unlink()
    assert engine.index().status == "indexed"
    assert {r[0] for r in engine.list_files().collect()} == {"src/odd name+1.py"} and engine.store.generation() != first
    assert [r["file_path"] for r in engine.rechunk("src/odd name+1.py").collect()] == ["src/odd name+1.py"]
    with pytest.raises(ValueError):
        engine.rechunk("../x")
    assert engine.rechunk("no/such.py").count() == 0
    engine.store.optimize(4)
    assert first.exists()  # the pointer before names it
    engine.store.optimize()
    assert engine.store.chunks().count() == 1 and engine.store.meta().buckets == 4 and not first.exists()
    assert engine.store.postings().where("term = 'harbor'").count() == 1
    engine.clear()
    assert not engine.has_index() and engine.status().status == "standby"


class Failing(HashEmbedder):
    def embed(self, texts):
        raise RuntimeError("no vectors")


def test_failing_provider_leaves_the_index(spark, tree):
    good = Engine(spark, str(tree), HashEmbedder(8))
    good.index()
    bad = Engine(spark, str(tree), Failing(8))
    (tree / "src/new.ts").write_text(f"export function added(total: number) {{\n{BODY}\n}}\n")
    assert bad.index().status == "error"
    assert not bad.lock.held() and good.list_files().count() == 2
    assert bad.search("ledger", "vector").count() == 0 and bad.search("ledger", "hybrid").count() > 0


def test_change_of_dimension_starts_anew(spark, tree):
    Engine(spark, str(tree), HashEmbedder(8)).index()
    engine = Engine(spark, str(tree), HashEmbedder(6))
    assert engine.index().status == "indexed" and engine.store.meta().vector_size == 6
    assert {len(r[0]) for r in engine.store.chunks().select("vector").collect()} == {6}


class Counting(HashEmbedder):
    """Writes down each text it embeds; tasks run in other processes, so in files."""

    def __init__(self, dimensions, folder):
        super().__init__(dimensions)
        self.folder = folder

    def embed(self, texts):
        import uuid

        for text in texts:
            (Path(self.folder) / uuid.uuid4().hex).write_text(text)
        return super().embed(texts)


def of(engine):
    return {r["file_path"]: r["content"] for r in engine.store.chunks(engine.branch).collect()}


def test_branches_keep_their_chunks(spark, tree, tmp_path):
    """Indexing a, then b with other files, then a again gives a's chunks, and what is unchanged is not embedded again."""
    embedded = tmp_path / "embedded"
    embedded.mkdir()
    for branch in ("a", "main"):
        assert Engine(spark, str(tree), HashEmbedder(8), branch=branch).index().status == "indexed"
    first = of(Engine(spark, str(tree), HashEmbedder(8), branch="a"))
    old = (tree / "src/alpha.ts").read_text()
    (tree / "src/alpha.ts").write_text(old.replace("alphaLoader", "betaLoader"))
    (tree / "src/only_b.ts").write_text(f"export function onlyB(total: number) {{\n{BODY}\n}}\n")
    # The new branch takes the files of the main one over and embeds only what differs.
    b = Engine(spark, str(tree), Counting(8, str(embedded)), branch="b")
    assert b.index().status == "indexed" and len(list(embedded.iterdir())) == 2
    assert set(of(b)) == {"src/alpha.ts", "src/odd name+1.py", "src/only_b.ts"} and "betaLoader" in of(b)["src/alpha.ts"]
    assert [r["file_path"] for r in b.search("onlyB", "fts").collect()] == ["src/only_b.ts"]
    (tree / "src/alpha.ts").write_text(old)
    (tree / "src/only_b.ts").unlink()
    a = Engine(spark, str(tree), HashEmbedder(8), branch="a")
    assert of(a) == first and a.search("onlyB", "fts").count() == 0 and a.search("betaLoader", "vector", min_score=-1.0).count() == 2
    assert a.index().status == "indexed" and of(a) == first and "betaLoader" in of(b)["src/alpha.ts"]
    assert {r[0] for r in a.store.manifest().select("branch").distinct().collect()} == {"a", "b", "main"}


def test_a_reader_survives_a_writer(spark, tree):
    engine = Engine(spark, str(tree), HashEmbedder(8))
    engine.index()
    reading = engine.store.chunks(engine.branch)
    before = {r["segment_hash"] for r in reading.collect()}
    (tree / "src/alpha.ts").unlink()
    assert engine.index().status == "indexed"
    assert {r["segment_hash"] for r in reading.collect()} == before and set(of(engine)) == {"src/odd name+1.py"}


def test_a_change_rewrites_its_buckets_only(spark, tree):
    engine = Engine(spark, str(tree), HashEmbedder(8))
    engine.index()
    before = engine.store._pointer()["parts"]
    (tree / "src/odd name+1.py").write_text("def delta(a):\n" + "\n".join(f"    a -= {i}  # pallet tower" for i in range(20)) + "\n")
    engine.index()
    after = engine.store._pointer()["parts"]
    assert len(before) == 2 and sorted(before[b] == after[b] for b in before) == [False, True]
    assert [r[0] for r in engine.search("pallet", "fts").collect()] == ["src/odd name+1.py"] and engine.search("harbor", "fts").count() == 0
    assert {r[0] for r in engine.search("ledger", "fts").collect()} == {"src/alpha.ts"}


def test_another_process_that_finished_is_enough(spark, tree):
    engine = Engine(spark, str(tree), HashEmbedder(8))
    engine.index()
    generation = engine.store.generation()
    other = Engine(spark, str(tree), HashEmbedder(8))
    with engine.lock:
        assert other.index().status == "indexed" and "finished" in other.state.message
    assert engine.store.generation() == generation
    engine.lock.wait = other.lock.wait = 0.01
    with engine.lock:
        assert other.index(force=True).status == "error"


def test_stored_postings_give_what_a_scan_gives(spark, data, tmp_path):
    from pyspark.sql import functions as F

    from trovelode.operators import fulltext, listing

    chunks = listing.current_chunks(spark.read.parquet(f"{data}/chunks.parquet")).drop("indexed_at", "workspace")
    rows = chunks.withColumn("branch", F.lit("main")).withColumn("vector", F.lit(None).cast("array<float>"))
    store = Store(spark, str(tmp_path / "index"))
    store.write(rows, spark.createDataFrame([], "branch string, path string, file_hash string"), Meta(0, buckets=5))
    for prefix in (None, "harbor-ledger/"):
        want = [(r["segment_hash"], r["score"]) for r in fulltext.search(chunks, "pending ledger token", prefix, 30).collect()]
        found = fulltext.search_postings(store.postings("main"), *store.stats("main"), "pending ledger token", prefix, 30)
        assert [(r["segment_hash"], r["score"]) for r in found.collect()] == want and want
    assert "In(term, [ledger,pending,token])" in found._jdf.queryExecution().toString()
    assert fulltext.search_postings(store.postings("main"), *store.stats("main"), "?!").count() == 0


def test_very_many_ignore_rules(spark):
    from pyspark.sql import functions as F

    rules = ignore.compile_rules("\n".join(("!" if i % 500 == 7 else "") + f"dir{i}/*.log" for i in range(3000)))
    paths = [("dir3/a.log",), ("dir507/a.log",), ("dir2999/a.log",), ("other/a.log",)]
    assert [r[0] for r in spark.createDataFrame(paths, "path string").select(ignore.ignored(F.col("path"), rules)).collect()] == [True, False, True, False]


def test_lock(tmp_path):
    lock, other = Lock(str(tmp_path), 0.01, 2), Lock(str(tmp_path), 0.01, 2)
    with lock:
        with pytest.raises(Busy):
            other.acquire()
    other.acquire()
    lock.release()
    assert not other.held()


def test_store_without_index(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    with pytest.raises(IndexMissing):
        store.chunks()
    store.create(4)
    assert store.chunks().count() == 0 and store.usable(4) and not store.usable(5)
    store.complete(3)
    assert json.loads((tmp_path / "index/current.json").read_text())["meta"]["indexed_file_count"] == 3 and store.meta() == Meta(**vars(store.meta()))


def test_index_location():
    assert scan.index_location("/w", "/shared", "git@example.invalid:a/b.git").startswith("/shared/") and len(scan.index_location("/w", "/shared", "x")) == len("/shared/") + 16
    assert scan.index_location("/w").endswith("/.trovelode")


def test_stream_upserts(spark, tmp_path, data):
    arriving = tmp_path / "in"
    schema = "path string, content string"
    store = Store(spark, str(tmp_path / "index"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(arriving))
        ingest.upsert_stream(stream, store, str(tmp_path / "progress"), provider=HashEmbedder(6)).awaitTermination()

    spark.createDataFrame([("a.ts", "x" * 200), ("b.ts", "y" * 200)], schema).write.parquet(str(arriving / "1"))
    run_ = spark.read.parquet(str(arriving / "1"))
    run_.write.mode("append").parquet(str(arriving))
    run()
    assert store.chunks().count() == 2
    spark.createDataFrame([("a.ts", "z" * 300)], schema).write.mode("append").parquet(str(arriving))
    run()
    assert {r[0]: len(r[1]) for r in store.chunks().select("file_path", "content").collect()} == {"a.ts": 300, "b.ts": 200}
    assert store.manifest().count() == 2 and store.meta().indexing_complete and store.meta().indexed_file_count == 2
    assert {len(r[0]) for r in store.chunks().select("vector").collect()} == {6}


def test_stream_windows_agree_with_the_batch(spark, tmp_path, data):
    chunks = spark.read.parquet(f"{data}/chunks.parquet")
    stream = spark.readStream.schema(chunks.schema).option("pathGlobFilter", "chunks.parquet").parquet(data)
    query = ingest.late_window_counts(stream, delay="10000 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    got = spark.table("windows").agg({"n_chunks": "sum"}).first()[0]
    assert got == chunks.where("indexed_at is not null").count()


def test_stream_of_chunks_is_the_batch(spark, tmp_path, data):
    files = spark.read.parquet(f"{data}/files.parquet").select("path", "content")
    stream = spark.readStream.schema(files.schema).option("pathGlobFilter", "files.parquet").parquet(data)
    query = ingest.chunks_of_stream(stream).writeStream.format("memory").queryName("chunked").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert spark.table("chunked").count() == chunking.chunk_files(files).count()


def test_workspaces():
    known = Workspaces()
    known.add(" /a ")
    known.add("/a", "later")
    known.add("  ")
    assert known.paths == {"/a": ""}
    known.remove("/a")
    assert not known.paths
