import random
from collections import Counter

from trovelode.llm import packing
from trovelode.tables import table


def total(patterns):
    return sum(copies for _, copies in patterns)


def check(counts, capacity):
    patterns, got = packing.plan(dict(counts), capacity), Counter()
    for content, copies in patterns:
        assert copies > 0 and sum(s * n for s, n in content) <= capacity
        for s, n in content:
            got[s] += n * copies
    assert got == Counter(counts)
    return patterns


def best(items, capacity):
    items, least = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(items):
            least[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            more = list(bins)
            more[more.index(room)] += items[i]
            go(i + 1, more)
        go(i + 1, bins + [items[i]])

    go(0, [])
    return least[0]


def test_plans_hold_all_items():
    rng = random.Random(1)
    for _ in range(1500):
        capacity = rng.choice([1, 5, 7, 20, 50])
        check({s: rng.randint(1, 9) for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 9)))}, capacity)
    check({}, 10)


def test_reduction_is_part_of_a_best_packing():
    rng = random.Random(2)
    for _ in range(500):
        capacity = rng.choice([7, 10, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        fixed, rest = packing.dominated_sets(Counter(items), capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert total(fixed) + (best(left, capacity) if left else 0) == best(items, capacity)


def test_counts_give_what_one_by_one_gives():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([10, 30])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 60)))
        rooms = []
        for s in sorted(counts.elements(), reverse=True):
            fitting = [r for r in rooms if r >= s]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - s)
            else:
                rooms.append(capacity - s)
        assert total(packing.best_fit(dict(counts), capacity)) == len(rooms)


def test_fill_is_close_to_the_bound():
    rng = random.Random(4)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(5.8, 1.2)))) for _ in range(50_000))
    patterns = check(counts, 2048)
    assert total(patterns) <= 1.005 * sum(s * n for s, n in counts.items()) / 2048 + 1


def assert_packed(rows, sizes, capacity):
    filled, parts = Counter(), {}
    for r in rows:
        if r["container_id"] is None:
            assert r["n_tokens"] == 0 and r["part"] == 0
        else:
            filled[r["container_id"]] += r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part"], r["first_token"], r["n_tokens"]))
    assert all(n <= capacity for n in filled.values()) and set(filled) == set(range(len(filled)))
    for key, n in sizes.items():
        own = sorted(parts[key])
        assert sum(p[2] for p in own) == n and (n <= capacity) <= (len(own) == 1)
        assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))


def test_given_documents_and_many_buckets(spark, data, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    docs = table(spark, data, "documents")
    sizes = {r["key"]: r["n_tokens"] for r in packing.token_counts(docs).collect()}
    for capacity in (300, 2048):
        assert_packed(packing.pack(docs, capacity).collect(), sizes, capacity)


def test_edge_rows(spark):
    rows = [(1, "one two", 0), (2, None, 0), (3, "", 0), (4, "x y " * 3000, 0), (None, "three", 0), (5, "one two", 0)] + [(9, "same text", 1)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = packing.pack(df, 64).collect()
    assert sum(r["doc_id"] == 9 for r in got) == 50
    assert {r["doc_id"] for r in got if r["container_id"] is None} == {2, 3}
    assert packing.fill(packing.pack(df, 64), 64).first()["fill"] > 0.9
    assert packing.pack(df.limit(0)).count() == 0 and packing.fill(packing.pack(df.limit(0))).first()["containers"] == 0
