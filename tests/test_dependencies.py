"""Missing dependencies and circles against plain versions, and what they cost on long chains."""

import random

from tessella.operators import quality, search

CHUNK = "doc_id long, chunk_no int, name string, content string, dependencies array<string>"


def plain_missing(rows, most=5):
    out = {}
    for doc in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        out[doc] = [f"{a[2]} -> {b[2]}" for a in own for b in own if a[1] != b[1] and None not in (a[2], a[3], b[2], a[4]) and b[2] in a[3] and b[2] not in a[4] and None not in a[4]][:most]
    return out


def test_missing_dependencies_are_those_of_all_pairs(spark):
    rnd = random.Random(1)
    names = ["f", "ff", "g_1", "g", "", "é", "class", "w w"]
    rows = [(i % 9 if i < 200 else i, i // 9, rnd.choice([*names, None]), rnd.choice([None, " ".join(rnd.sample(names, 4)), "xffg_12", ""]), rnd.choice([None, [], ["f", "g"], ["ff", None], ["é"]])) for i in range(240)]
    got = {r.doc_id: r.missing for r in quality.missing_dependencies(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == plain_missing(rows) and any(len(m) == 5 for m in got.values()) and any(len(m) < 5 for m in got.values())
    assert quality.missing_dependencies(spark.createDataFrame([], CHUNK)).count() == 0


def test_one_document_of_many_chunks(spark):
    """20,000 chunks of which none holds another's name: all pairs would be 400 million tests."""
    rows = [(1, i, f"name_{i:05d}", f"text {i} " + "word " * 5, []) for i in range(20_000)]
    assert [r.missing for r in quality.missing_dependencies(spark.createDataFrame(rows, CHUNK)).collect()] == [[]]


def has_circle(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    while True:
        left = {a: {b for b in bs if b in after} for a, bs in after.items()}
        left = {a: bs for a, bs in left.items() if bs}
        if left == after:
            return bool(after)
        after = left


def test_circles_of_random_graphs(spark):
    rnd = random.Random(5)
    graphs = {g: [(rnd.randrange(12), rnd.randrange(12)) for _ in range(rnd.randrange(1, 16))] for g in range(150)}
    graphs |= {500: [(i, i + 1) for i in range(40)] + [(40, 3)], 501: [(i, j) for i in range(9) for j in range(i + 1, 9)], 502: [(7, 7)], 503: [(None, 1), (1, None), (1, 2)]}
    rows = [(g, *e) for g, es in graphs.items() for e in es]
    found = {r[0] for r in search.circular_dependencies(spark.createDataFrame(rows, "group long, src long, dst long")).collect()}
    want = {g for g, es in graphs.items() if has_circle([e for e in es if None not in e])}
    assert found == want and 20 < len(want) < 140


def test_a_long_path_takes_few_rounds(spark):
    path = [(1, i, i + 1) for i in range(10_000)]
    circle = [(2, i, (i + 1) % 3_000) for i in range(3_000)]
    rounds = []
    found = search.circular_dependencies(spark.createDataFrame(path + circle, "group long, src long, dst long"), rounds).collect()
    assert [r[0] for r in found] == [2] and len(rounds) <= 2


def test_edges_are_of_chunks_that_are_there(spark):
    rows = [(1, 0, "a", "", ["b", "nowhere"]), (1, 1, "b", "", ["a"]), (2, 0, "a", "", ["b"]), (2, 1, "c", "", None)]
    edges = quality.dependency_edges(spark.createDataFrame(rows, CHUNK))
    assert sorted(map(tuple, edges.collect())) == [(1, "a", "b"), (1, "b", "a")]
    assert [r[0] for r in search.circular_dependencies(edges).collect()] == [1]
