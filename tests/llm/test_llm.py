"""The training-data operators: queries against SQL or brute force, and nulls, ties, repeats and empty tables."""

import base64
import gzip
import hashlib
import heapq
import itertools
import random
import re
import time
from collections import Counter
from html import unescape
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessella.llm import chat, decontaminate, html, langid, mix, neighbours, setjoin, substrings, toxicity, warc
from tessella.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(map(str, ([r[c] for c in names] for r in got.collect()))) == sorted(map(str, (list(r) for r in want.fetchall())))


@pytest.fixture(scope="module")
def odd_docs(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rnd.randint(1, 80))) for _ in range(40)]
    line = " ".join(word() for _ in range(12))
    texts += [" ".join([word() for _ in range(5)] + [line] + [word() for _ in range(9)]) for _ in range(30)]
    texts += [texts[0] + " x", texts[1].upper(), texts[2], texts[2], "", " \t ", None, "one", "a b c", "a b c", "z " * 3000, texts[5] + "\n" + texts[6]]
    rows = [(i, t, ["s1", "s2", None, ""][i % 4], "clash") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "s1", "again"), (None, texts[4], "s1", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, hash string").cache()


def test_substring_dedup_against_brute_force(spark, odd_docs):
    rows = odd_docs.collect()
    assert substrings.remove_repeats(odd_docs.limit(0)).count() == 0
    for hot, few, words in ((1_000, 9, 9), (2, 1_000_000, 100_000), (2, 1_000_000, 20), (2, 0, 9)):
        first = {}
        for r in rows:
            w = split(r.text)
            for i in range(len(w) - 12 if r.doc_id is not None else 0):
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, r.doc_id), r.doc_id)
        want = []
        for r in rows:
            w = split(r.text)
            gone = {i + j for i in range(len(w) - 12) for j in range(13) if r.doc_id is not None and first[tuple(w[i : i + 13])] < r.doc_id}
            kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
            want.append((str(r.doc_id), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
        got = substrings.remove_repeats(odd_docs, hot_stretches=hot, broadcast_windows=few, shard_words=words).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(want) == sorted((str(r[0]), *r[1:]) for r in got)


def test_automaton_tells_the_least_holder():
    rnd = random.Random(7)
    texts = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(1, 25))] for _ in range(40)]
    automaton = substrings.SuffixAutomaton()
    for name, text in sorted(enumerate(texts[:30]), key=lambda x: -x[0]):
        automaton.add(text, name)
    automaton.settle()
    for size in (1, 3, 5):
        for text in texts:
            own = [text[max(0, e + 1 - size) : e + 1] for e in range(len(text))]
            want = [min((n for n, t in enumerate(texts[:30]) for i in range(len(t) - size + 1) if t[i : i + size] == w), default=None) if len(w) == size else None for w in own]
            assert automaton.holders(text, size) == want


def test_jaccard_components_against_brute_force(spark, odd_docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = odd_docs.collect()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := split((r.text or "").translate(low))) else set() for r in rows]
    root = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and a.doc_id is not None and rows[j].doc_id is not None and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = find(a.doc_id), find(rows[j].doc_id)
                root[max(x, y)] = min(x, y)
    want = sorted((str(r.doc_id), len(s), str(None if r.doc_id is None else find(r.doc_id))) for r, s in zip(rows, sets))
    for sizes in ({}, {"slack": 1}, {"block_sets": 2, "broadcast_ids": 0}, {"block_shingles": 90}):
        assert want == sorted((str(r[0]), r[1], str(r[2])) for r in setjoin.jaccard_components(odd_docs, **sizes).collect())
    assert setjoin.jaccard_components(odd_docs.limit(0)).count() == 0


def test_jaccard_components_of_large_groups_and_long_texts(spark):
    """Near copies in chains, in a hot group and of long texts, with a line that most share, in blocks of a few sets."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    line, rows = [word() for _ in range(30)], []
    for n in (60, 90, 700):
        base = [word() for _ in range(n)]
        for i in range(25):
            base = list(base)
            for _ in range(max(1, n // 90)):
                base[rnd.randrange(n)] = word()
            rows.append(base + (line if i > 12 else []))
    rows += [[word() for _ in range(40)] + line for _ in range(30)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    of = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((of[i], of[j]))
                of = [x if k == y else k for k in of]
    assert len(set(of)) < len(of) - 40
    for sizes in ({}, {"block_sets": 3}, {"block_shingles": 400, "slack": 8}):
        assert sorted((r.doc_id, r.component_id) for r in setjoin.jaccard_components(docs, **sizes).collect()) == list(enumerate(of))


def test_group_links_join_what_brute_force_joins():
    rnd = np.random.RandomState(5)
    base = rnd.randint(0, 1 << 40, 150).astype(np.uint64)
    sets = [np.unique(base)] + [np.unique(np.where(rnd.rand(150) < rnd.choice([0.02, 0.08, 0.15, 0.4, 0.9]), rnd.randint(0, 1 << 40, 150).astype(np.uint64), base)) for _ in range(120)]
    of = list(range(len(sets)))

    def union(a, b):
        x, y = of[a], of[b]
        of[:] = [x if k == y else k for k in of]

    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                union(i, j)
    want = {frozenset(i for i in of if of[i] == k) for k in of}, [of[i] for i in range(len(of))]
    of = list(range(len(sets)))
    for a, b in setjoin.group_links(sets, np.zeros(len(sets), int), 80):
        union(a, b)
    same = lambda labels: {tuple(sorted(i for i, x in enumerate(labels) if x == k)) for k in labels}
    assert same(want[1]) == same(of)


def test_near_vectors_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.01]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [0.0, 1.0]), (9, []), (None, [1.0, 0.0]), (10, [1e-300, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 10: (3, 1, False), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True), 9: (0, 9, True), None: (0, None, True)}
    assert neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_near_vectors_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert neighbours.audit_recall(vectors, neighbours.near_vectors(vectors), every=5) >= 0.9


def beside(rnd, x, cosine):
    """A random unit vector of this cosine to the unit vector ``x``."""
    y = rnd.normal(size=x.shape)
    y -= (y @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def links_by_brute_force(vectors):
    """(n_links, component) of each place, by all pairs."""
    linked = vectors @ vectors.T >= 0.95
    np.fill_diagonal(linked, False)
    of = np.arange(len(vectors))
    while True:
        least = np.minimum(of, np.where(linked, of[None, :], len(of)).min(axis=1))
        if (least == of).all():
            return linked.sum(axis=1).tolist(), of.tolist()
        of = least


def test_near_vectors_join_tight_groups_of_more_copies_than_a_list_holds(spark):
    rnd = np.random.RandomState(8)
    rows = [beside(rnd, np.eye(64)[0], 0.0) for _ in range(300)]
    for i in range(3):
        for centre in (np.eye(64)[i], beside(rnd, np.eye(64)[i], 0.965)):
            rows += [beside(rnd, centre, 0.9995) for _ in range(100)]
    vectors = np.array(rows)[rnd.permutation(len(rows))]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_vectors(frame).collect())
    assert got == list(zip(range(len(rows)), *links_by_brute_force(vectors)))


@pytest.fixture(scope="module")
def planted(spark):
    """6,000 random vectors, a near copy each of 300 of them, and two groups of hundreds that have tight sub-groups; (rows, their table, its result)."""
    rnd = np.random.RandomState(9)
    rows = [beside(rnd, np.eye(64)[0], 0.0) for _ in range(6000)]
    rows += [beside(rnd, x, 0.97) for x in rows[:300]]
    for i in range(2):
        for centre in (np.eye(64)[i], beside(rnd, np.eye(64)[i], 0.965)):
            rows += [beside(rnd, centre, 0.9995) for _ in range(120)]
    vectors = np.array(rows)[rnd.permutation(len(rows))]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>").cache()
    return vectors, frame, neighbours.near_vectors(frame).cache()


def test_near_vectors_find_planted_pairs_among_thousands(planted):
    vectors, _, result = planted
    links, components = links_by_brute_force(vectors)
    got = {r.vec_id: (r.n_links, r.component_id) for r in result.collect()}
    linked = [i for i, n in enumerate(links) if n]
    assert len(linked) >= 1000 and sum(got[i] == (links[i], components[i]) for i in linked) >= 0.98 * len(linked)
    assert all(got[i][0] <= links[i] for i in got)


def test_near_vectors_in_small_blocks_count_all_links(spark):
    rnd = np.random.RandomState(12)
    rows = [beside(rnd, np.eye(32)[0], c) for c in [0.0] * 60 + [0.999] * 90 + [0.96] * 60]
    vectors = np.array(rows)[rnd.permutation(len(rows))]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    links, components = links_by_brute_force(vectors)
    for block in (16, 64):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_vectors(frame, block=block).collect())
        assert got == list(zip(range(len(rows)), links, components))


def test_audit_takes_all_defined_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0]), (100, [0.0, 0.0]), (150, None), (200, [float("nan"), 1.0]), (3, [2.0, 0.0]), (None, [1.0, 0.0]), (4, [3.0, None])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert neighbours.audit_recall(frame, neighbours.near_vectors(frame)) == 1.0


def test_audit_measures_planted_links_and_says_when_there_are_none(planted):
    _, frame, result = planted
    assert neighbours.audit_recall(frame, result) >= 0.98
    assert neighbours.audit_recall(frame, result.withColumn("n_links", result.n_links * 0)) == 0
    with pytest.warns(UserWarning, match="no links"):
        neighbours.audit_recall(frame.limit(0), result)


def test_warc_round_trip_and_damage(spark):
    rows = [(5, "http://a", "x"), (2, "http://b\r\nq%0A", "x"), (9, None, None), (7, "u", ""), (8, "v", "é" * 70_000)]
    archives = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), archive_bytes=10)
    got = {r.page_id: r for r in warc.read_warc(archives, payload=True).collect()}
    assert all(r.digest_ok for r in got.values())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {2: ("response", None), 5: ("revisit", 2), 7: ("response", None), 9: ("revisit", 7), 8: ("response", None)}
    assert got[8].payload_bytes == 140_000 and bytes(got[8].payload).decode() == "é" * 70_000 and got[2].target_uri == "http://b\r\nq%0A"
    assert got[5].payload_digest == base64.b32encode(hashlib.sha1(b"x").digest()).decode() and got[5].payload_bytes == 1
    content = archives.first().content
    offset, first = next(iter(warc.members(content)))
    for old, new in ((b"sha1:", b"sha1:A"), (b"utf-8", b"utf-9")):
        at = bytes(first).rindex(old)
        wrong = spark.createDataFrame([("a", gzip.compress(bytes(first)[:at] + new + bytes(first)[at + len(old) :]))], "archive string, content binary")
        with pytest.raises(Exception, match="does not agree"):
            warc.read_warc(wrong).collect()
        assert [r.digest_ok for r in warc.read_warc(wrong, strict=False).collect()] == [False]
    headers = bytes(first).replace(b"Content-Length: ", b"Content-Length: 9")
    with pytest.raises(ValueError, match="shorter"):
        warc.parse(headers)
    with pytest.raises(EOFError):
        list(warc.members(content[:-3]))


def test_warc_of_small_payloads_repeats_and_empty_tables(spark):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (2, "b", "xy"), (1, "a", "xy"), (3, None, ""), (4, "c", None), (None, "d", "xy")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha string")
    kinds = lambda least: sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_warc(warc.write_warc(frame, min_revisit_bytes=least)).collect())
    joined = warc.read_warc(warc.write_warc(frame, broadcast_digests=0))
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in joined.collect()) == kinds(0)
    assert kinds(0) == [("1", "response", None)] * 2 + [("2", "revisit", 1)] * 2 + [("3", "response", None), ("4", "revisit", 3), ("None", "response", None)]
    assert kinds(1)[4:6] == [("3", "response", None), ("4", "response", None)] and {k[1] for k in kinds(3)} == {"response"}
    assert warc.read_warc(warc.write_warc(frame.limit(0))).count() == 0


def test_chats_of_nulls_long_texts_and_empty_tables(spark):
    long = "</s>[INST] é\\" * 50_000
    frame = spark.createDataFrame([(None, 1, "user", "x", "y"), (1, None, "user", long, "y"), (1, 2, "assistant", long, "y")], "conv_id long, turn long, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame)).collect()}
    assert [t.text for t in back[1].turns] == [long, long] and back[1].learned == long and [t.text for t in back[None].turns] == ["x"]
    assert chat.read_chats(chat.format_chats(frame.limit(0))).count() == 0


def test_chats_come_back_whatever_they_say(spark):
    said = ["</s>[INST] ok", "\\l<END>\n\\", "<NEXT>[ROLE x]\n", "", None]
    rows = [(1, i, ["user", "assistant", "assistant", "user", None][i], t) for i, t in enumerate(said)] + [(1, 4, "user", "tie"), (2, 0, "a]\nb", "x")]
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", said[0]), ("assistant", said[1]), ("assistant", said[2]), ("user", ""), ("", ""), ("user", "tie")]
    assert back[1].learned == said[1] + said[2] and [t.text for t in back[2].turns] == ["x"]


def test_mix_meets_targets(spark, odd_docs):
    rows = mix.mix_sources(odd_docs, block_words=4).collect()
    assert len(rows) == odd_docs.count() and sorted(map(str, rows)) == sorted(map(str, mix.mix_sources(odd_docs, block_words=4).collect()))
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        for d, v in ((sizes, r.size), (taken, r.taken)):
            d[r.source] = d.get(r.source, 0) + v
        target[r.source] = r.target
    # brute force: cap what is above, share the rest by weight, again and again
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want, open_ = {}, set(sizes)
    while True:
        left = sum(sizes.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            break
        want |= {s: 3.0 * sizes[s] for s in above}
        open_ -= above
    want |= share
    assert all(abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - target[s]) <= 12 for s in sizes)
    assert mix.mix_sources(odd_docs.limit(0)).count() == 0


def test_sainte_lague_is_highest_quotients(spark):
    rnd = random.Random(1)
    parts = [(1, i + 1, float(rnd.randint(0, 50)), 37) for i in range(12)]
    got = {r._rank: r.q for r in mix.sainte_lague(spark.createDataFrame(parts, "g int, _rank long, w double, n long"), ["g"], "w", "n", "q").collect()}
    want = {p[1]: 0 for p in parts}
    for _ in range(37):
        best = max(parts, key=lambda p: (p[2] / (2 * want[p[1]] + 1), -p[1]))
        want[best[1]] += 1
    assert got == want


@pytest.mark.parametrize("sizes", [[50] * 2_000, [200_000, *range(5, 50)], [90, 70_000, 33, 1_000, 64, 65]])
def test_small_sources_come_near_their_targets(spark, sizes):
    """With the parameters as they are; documents have up to 700 words."""
    rows = []
    for k, n in enumerate(sizes):
        cuts = list(range(0, n, 700 if n > 700 else max(1, n // 3))) + [n]
        rows += [(len(rows) + j, "w " * (hi - lo), f"s{k:05d}") for j, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    got = mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert abs(sum(target.values()) - sum(sizes)) < 1e-6 * sum(sizes)
    assert all(abs(taken[k] - target[k]) <= max(1.5, 0.04 * target[k]) for k in target)
    assert abs(sum(taken.values()) - sum(sizes)) < 0.01 * sum(sizes)


def test_mix_of_many_small_sources_stays_small(spark):
    """1,500 sources whose quotas all round one way; quotas are the highest quotients'."""
    parts = [(1, i + 1, 1.0 if i else 800.0, 1200) for i in range(1500)]
    frame = spark.createDataFrame(parts, "g int, _rank long, w double, n long")
    got = {r._rank: r.q for r in mix.sainte_lague(frame, ["g"], "w", "n", "q").collect()}
    heap, want = [(-w, r, w, 0) for _, r, w, _ in parts], {p[1]: 0 for p in parts}
    heapq.heapify(heap)
    for _ in range(1200):
        _, r, w, k = heapq.heappop(heap)
        want[r] += 1
        heapq.heappush(heap, (-w / (2 * k + 3), r, w, k + 1))
    assert got == want


def test_languages_are_told_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in QUERIES["op10_language_id"](spark, DATA).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)
    model = langid.fit_languages(docs.where(~langid.held_out()))
    odd = spark.createDataFrame([(None, 1), ("", 2), ("12 !!", 3), ("x" * 5000, 4)], "text string, score long")
    assert [r.lang_pred == "und" for r in langid.identify(odd, model).collect()] == [True, True, True, False]
    assert langid.identify(odd, langid.fit_languages(docs.limit(0))).where("lang_pred = 'und'").count() == 4


def test_forward_sums_all_segmentations():
    pieces = langid.load_pieces()
    word = np.frombuffer(b" then", np.uint8)[None, :]
    probs = np.full((pieces.n + 1, 1), 0.01)
    probs[-1] = 0
    found = langid.spans(word, pieces)
    known = {(e - n, e) for n, rows in found.items() for e in range(n, 6) if rows[0, e - n] != pieces.n}
    ways = [1.0] + [0.0] * 5
    for e in range(1, 6):
        ways[e] = sum(ways[b] * 0.01 for b, x in known if x == e)
    assert np.isclose(langid.forward(found, probs, 1, 5)[0, 5, 0], ways[5])


def test_words_of_any_length_sum_all_segmentations():
    rnd = random.Random(11)
    pieces = langid.load_pieces()
    probs = np.append(np.random.RandomState(1).rand(pieces.n) ** 4 * 1e-3 + 1e-7, 0)[:, None] * np.array([[1.0, 0.5]])
    model = langid.Model(["a", "b"], pieces, probs)
    texts = ["".join(rnd.choice("theing éß語言的是中文") for _ in range(n)).replace(" ", "") for n in [*range(1, 60), 200, 1500]] + ["x" * 70_000, "的" * 70, "ünd", "ünd" * 13 + "x"]
    known = {}
    own = langid.load_pieces.__globals__["W"]
    for part in own.slices(pa.array([t + " " for t in texts])):
        logs = langid.log_likelihoods(part, model)
        for i, text in enumerate(texts):
            raw = b" " + text.encode()
            m = np.frombuffer(raw, np.uint8)[None, :]
            ways = [[0.0, 0.0]] + [[-np.inf] * 2 for _ in raw]
            for length, rows in langid.spans(m, pieces).items():
                for b in np.flatnonzero(rows[0] != pieces.n):
                    known[raw[b : b + length]] = rows[0, b]
            longest = pieces.lengths[-1]
            for e in range(1, len(raw) + 1):
                for b in range(max(0, e - longest), e):
                    at = known.get(raw[b:e])
                    if at is not None:
                        ways[e] = np.logaddexp(ways[e], np.add(ways[b], np.log(probs[at])))
            assert np.allclose(ways[-1], logs[part.lo + i], rtol=1e-9)


def test_fit_of_long_words_is_one_expectation():
    pieces = langid.load_pieces()
    word = "derundthe" * 12
    probs = langid.fit(pa.array([word]), pieces, rounds=1, extra=0.0)
    raw = b" " + word.encode()
    rows = langid.spans(np.frombuffer(raw, np.uint8)[None, :], pieces)
    n, p = len(raw), 1 / pieces.n
    to, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    pairs = [(b, b + k, int(r[0, b])) for k, r in rows.items() for b in range(r.shape[1]) if r[0, b] != pieces.n]
    grow = pieces.n  # keeps the plain sums in range
    for e in range(1, n + 1):
        to[e] = sum(to[b] * p * grow ** ((x - b) / 2) for b, x, _ in pairs if x == e)
    for b in range(n - 1, -1, -1):
        back[b] = sum(back[x] * p * grow ** ((x - b) / 2) for y, x, _ in pairs if y == b)
    want = np.zeros(pieces.n)
    for b, x, r in pairs:
        want[r] += to[b] * p * grow ** ((x - b) / 2) * back[x] / to[n]
    want = np.maximum(want / want.sum(), langid.FLOOR)
    assert np.allclose(probs[:-1], want, rtol=1e-6)


def test_languages_of_null_labels_ties_and_repeats(spark):
    rows = [(1, "uno dos tres", "es"), (1, "uno dos tres", "es"), (2, "one two three", "en"), (3, "one two", None), (4, None, "en"), (None, "one", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs)
    assert model.langs == ["en", "es"]
    got = langid.identify(docs.withColumn("lang_pred", docs.lang), model).collect()
    assert [r.lang_pred for r in got] == ["es", "es", "en", "en", "und", "en"]
    same = langid.Model(["a", "b"], model.pieces, model.probs[:, [0, 0]])
    assert {(r.lang_pred, r.score) for r in langid.identify(docs.where("text is not null"), same).collect()} == {("a", 0.5)}


def test_toxicity_finds_the_sentence(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta".split())
    rows = [(i, " ".join(word() for _ in range(9)) + (". You VILE, thing!" if i % 3 == 0 else ".") + " End here", int(i % 3 == 0)) for i in range(300)] + [(900, None, 1), (901, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs)).collect()
    assert all(r.predicted == r.toxic for r in scored if r.doc_id < 300) and scored[-2].score == 0
    assert scored[0].toxic_sentences == ["You VILE, thing"]
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs.limit(0))).where("predicted = 1").count() == 0


def test_toxicity_of_odd_rows(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta".split())
    rows = [(i, " ".join(word() for _ in range(9)) + (". You vile thing!" if i % 3 == 0 else "."), int(i % 3 == 0)) for i in range(120)]
    model = toxicity.fit_toxicity(spark.createDataFrame([*rows, *rows[:9], (None, "vile", 1)], "doc_id long, text string, toxic int"))
    odd = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (2, " .!? ", "c"), (3, "vile " * 40_000, "d"), (3, "vile " * 40_000, "d"), (None, "you vile", "e"), (4, "x. " * 50_000, "f")], "doc_id long, text string, score string")
    got = toxicity.score_toxicity(odd, model).collect()
    assert [r.predicted for r in got] == [0, 0, 0, 1, 1, 1, 0] and [r.score for r in got[:3]] == [0, 0, 0] and all(0 <= r.score <= 1 for r in got)
    assert [len(r.toxic_sentences) for r in got] == [0, 0, 0, 1, 1, 1, 0]
    assert toxicity.score_toxicity(odd.limit(0), model).count() == 0


def test_toxicity_gradients_are_those_of_the_log_loss():
    rnd = np.random.RandomState(3)
    row, labels = np.sort(rnd.randint(0, 6, 9)), rnd.randint(0, 2, 6)
    sentence, word = np.sort(np.append(np.arange(9), rnd.randint(0, 9, 11))), rnd.randint(0, 5, 20)

    def loss(weight, bias):
        z = bias + np.bincount(sentence, weight[word], 9)
        quiet = np.array([np.prod(1 - 1 / (1 + np.exp(-z[row == d]))) for d in range(6)])
        p = np.clip(1 - quiet, 1e-9, 1 - 1e-9)
        return -np.mean(np.where(labels, np.log(p), np.log(1 - p))) + 0.5 * (weight @ weight) / 6

    weight, bias = toxicity.fit(row, sentence, word, labels, 5, rounds=3000, ridge=1.0, rate=0.1)
    assert all(loss(weight, bias) <= loss(weight + d, bias) + 1e-6 for d in 0.05 * np.vstack([np.eye(5), -np.eye(5)])) and loss(weight, bias) <= loss(weight, bias + 0.05) + 1e-6


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    hit = sum(r.predicted and toxic[r.doc_id] for r in rows)
    assert hit >= 0.9 * sum(toxic[r.doc_id] for r in rows) and hit >= 0.9 * sum(r.predicted for r in rows)


def test_decontamination_finds_edited_copies_only(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    items = [[word() for _ in range(30)] for _ in range(5)]
    text = lambda n: [word() for _ in range(n)]
    edited = [w if i % 7 else word() for i, w in enumerate(items[1])]
    docs = [(1, " ".join(text(40) + items[0] + text(40))), (2, " ".join(text(20) + edited + text(5)).upper()), (3, " ".join(text(200))), (4, None), (5, ""), (None, " ".join(items[0])), (6, " ".join(items[2][:8] + text(50)))]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None), (10, " . ")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (20_000, 2):
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.decontaminate(frame, bench, block_items=block).collect()) == [(1, 0), (2, 1)]
    assert decontaminate.decontaminate(frame, bench.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    """Items cut, reordered, with words replaced, put in and left out: the hits are those of aligning every document with every item."""
    rnd = random.Random(14)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    common = vocabulary[:40]
    word = lambda: rnd.choice(common if rnd.random() < 0.4 else vocabulary)
    items = [[word() for _ in range(rnd.randint(8, 40))] for _ in range(12)]
    docs = []
    for i in range(160):
        own = list(items[i % 12])
        for _ in range(rnd.randint(0, len(own) // 3)):
            k = rnd.randrange(len(own))
            own[k : k + rnd.randint(0, 1)] = [[], [word()], [word() for _ in range(rnd.choice([1, 12]))]][rnd.randrange(3)]
        docs.append([word() for _ in range(rnd.randint(0, 60))] + own[rnd.choice([0, 0, len(own) // 2]) :] + [word() for _ in range(rnd.randint(0, 60))])
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame([(i, " ".join(t), "clash") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    number = {w: i for i, w in enumerate(vocabulary)}
    want = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            best = decontaminate.align(np.array([number[w] for w in item]), np.array([number[w] for w in text]))[0]
            if best >= len(item):
                want[d, i] = best
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.decontaminate(frame, bench).collect()}
    assert len(want) > 60 and set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.98 * len(want)
    third = spark.createDataFrame([(i, " ".join(w if k % 3 else "zz" for k, w in enumerate(t, 1))) for i, t in enumerate(items) if len(t) % 3 < 2], "doc_id long, text string")
    found = {r.doc_id for r in decontaminate.decontaminate(third, bench).where("doc_id = item_id").collect()}
    assert len(found) == third.count()
    again = {(r.doc_id, r.item_id): r.matched for r in decontaminate.decontaminate(frame.unionByName(frame), bench, block_bytes=300).collect()}
    assert again == got
    assert decontaminate.decontaminate(frame.limit(0), bench).count() == 0


def test_alignment_against_plain_smith_waterman():
    rnd = np.random.RandomState(6)
    for _ in range(30):
        a, b = rnd.randint(0, 5, rnd.randint(1, 12)), rnd.randint(0, 5, rnd.randint(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


def test_marginals_against_all_assignments(spark):
    model = html.fit_extractor(spark.read.parquet(f"{DATA}/pages.parquet"))
    page = html.parse('<div class="post"><p>Some, text. More.<a href=x>l</a></p><ul class=menu><li>x</ul></div>')
    n, total, on = len(page.tags), 0.0, np.zeros(len(page.tags))
    for y in itertools.product(html.STATES, repeat=n):
        p = 1.0
        for i in range(n):
            p *= model.edge[html.kind_of(page.tags[i])][y[page.parents[i]]][y[i]] if i else model.first[y[i]]
            for f in page.features[i]:
                p *= model.features[f][y[i]] if f in model.features else 1
        total += p
        on += p * (np.array(y) == html.CONTENT)
    assert np.allclose(html.marginals(page, model), on / total)


def test_main_text_of_page_kinds(spark):
    model = html.fit_extractor(spark.read.parquet(f"{DATA}/pages.parquet"))
    prose = "It was a long day, and nobody had slept. " * 6
    page = f'<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div id="content"><h1>A &amp; B</h1><p>{prose}<b>bo</b>ld</p><script>x("</p>")</script><div class="comments"><p>Nice, I agree. {prose}</p></div></div><div class="sidebar"><a href=/1>One</a></div><footer>&copy; us</footer></body></html>'
    assert html.main_text(page, model) == " ".join(f"A & B {prose} bold".replace(". bold", ".bold").split())
    assert html.main_text("", model) == ""
    got = html.extract_text(spark.createDataFrame([(1, None, "clash"), (2, "<p", "c")], "page_id long, html string, text string"), model).collect()
    assert [(r.text, r.n_chars) for r in got] == [("", 0), ("", 0)]


SIX = "It was a long day, and nobody had slept. " * 6
#: Pages of kinds that the tables don't have, with their main text.
LABELLED = [
    (f"<html><body><p>{SIX}</p></body></html>", SIX),
    (SIX, SIX),
    ("Short bare text", "Short bare text"),
    (f"<body>{SIX}<nav><a href=x>Home</a></nav>", SIX),
    (f'<body><article><h1>T</h1><p>{SIX}</p><p><a href="/x">A whole paragraph that is a link, really</a></p><p>{SIX}</p></article></body>', f"T {SIX} A whole paragraph that is a link, really {SIX}"),
    (f'<html><body><nav><a href=/>Home</a></nav><p>{SIX}</p><p>Short one.</p><div class="comments"><p>Nice one, {SIX}</p></div><footer>c 2020</footer></body></html>', f"{SIX} Short one."),
    (f'<body><div class=x><div class=y><p>{SIX}</p><p>{SIX}</p></div><div class="sidebar"><ul><li><a href=a>One</a></li><li><a href=a>Two</a></li></ul></div></div></body>', f"{SIX} {SIX}"),
    (f'<body><header><h1>Site</h1></header><main><h2>A</h2><p>{SIX}</p><aside>See also: {SIX}</aside><blockquote>So, it was.</blockquote></main><form><input><button>Go</button></form></body>', f"A {SIX} So, it was."),
    ('<body><nav><a href="/a">A</a><a href="/b">B</a></nav><footer>c</footer></body>', ""),
]


def test_main_text_of_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.fit_extractor(pages.where("page_id % 5 <> 0"))
    wanted = [(r.html, re.sub(r"<[^>]*>", "", re.sub(r"<(/?p|/?h1|br)>", " ", re.search(r"<article>(.*)</article>", r.html, re.S)[1]))) for r in pages.where("page_id % 5 = 0").collect() if "<article>" in r.html]
    assert len(wanted) >= 40
    hit = got = want = 0
    for source, text in [(a, unescape(b)) for a, b in wanted] + LABELLED:
        a, b = Counter(html.main_text(source, model).split()), Counter(text.split())
        hit, got, want = hit + (a & b).total(), got + a.total(), want + b.total()
    assert 2 * hit / (got + want) >= 0.99
    for source, text in LABELLED:
        assert html.main_text(source, model) == " ".join(text.split())


TOLD = "The town lies by the river, and people have lived there for long. They built a bridge in the old days. It still stands, though the water is high."
LINKS = '<a href="/a">Home</a> <a href="/b">News</a> <a href="/c">About us</a>'
#: Text that stands in containers themselves, and parts with names that the training pages don't pair in this way.
STANDING = [
    (f"<html><body><div>{TOLD}</div></body></html>", TOLD),
    (f"<html><body><div><div><div>{TOLD}</div></div></div></body></html>", TOLD),
    (f"<html><body><div id=header>{LINKS}</div><div id=col2>{TOLD}<br>{TOLD}</div><div id=footer>Copyright 2020</div></body></html>", f"{TOLD} {TOLD}"),
    (f"<html><body><header>{LINKS}</header><div id=col2>{TOLD}<br><br>{TOLD}</div><footer>All rights reserved</footer></body></html>", f"{TOLD} {TOLD}"),
    (f"<html><body><article><h1>Title</h1><p>{TOLD}</p><p>{TOLD}</p></article><section id=comments><div><p>{TOLD} I agree with it, really.</p></div></section></body></html>", f"Title {TOLD} {TOLD}"),
    (f"<html><body><div class=story><p>{TOLD}</p><p>{TOLD}</p></div><div class=discussion><p>{TOLD}</p></div></body></html>", f"{TOLD} {TOLD}"),
    (f"<html><body><div class=gdpr-bar>We use cookies to make this site work.</div><div class=entry><p>{TOLD}</p></div></body></html>", TOLD),
    (f"<html><body><article><p>{TOLD}</p><div class=sponsored-content>Buy this now</div><p>{TOLD}</p></article></body></html>", f"{TOLD} {TOLD}"),
    (f"<table><tr><td>{LINKS}</td><td>{TOLD}</td></tr></table>", TOLD),
]


@pytest.mark.parametrize("data", ["sf0.001", "sf0.1"])
def test_text_that_stands_in_containers(spark, data):
    model = html.fit_extractor(spark.read.parquet(f"/root/testdata/{data}/pages.parquet"))
    for source, text in STANDING:
        assert html.main_text(source, model) == text


def test_odd_pages_take_linear_time_and_defined_results(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    model = html.fit_extractor(pages)
    began = time.time()
    for source in ("<b>" * 20_000 + "</zz>" * 20_000, "<div>" * 20_000 + "x", "<p>" * 20_000 + "</div>" * 20_000, "<li>" * 20_000, "<" * 50_000, f"<article><p>{SIX * 5000}</p></article>"):
        html.main_text(source, model)
    assert time.time() - began < 20
    one = [(1, "u", f"<article><p>{SIX}</p></article>", "x")]
    got = html.extract_text(spark.createDataFrame(one * 2, "page_id long, url string, html string, n_chars string"), model).collect()
    assert len(got) == 2 and {(r.text, r.n_chars) for r in got} == {(SIX.strip(), len(SIX.strip()))}
    assert html.extract_text(pages.limit(0), html.fit_extractor(pages.limit(0))).count() == 0


def test_pipeline_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: r.doc_id
    before = sorted(docs.collect(), key=key)
    after = {}
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, DATA)
        rows = sorted(found.collect(), key=key)
        if name != "mixing sources to target weights":
            assert found.columns == docs.columns
        after[name], docs = rows, spark.createDataFrame(rows, found.schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", own)
    # language ID: real texts in four languages stay as they are
    kept = after["language ID"]
    assert [r for r in before if r in kept] == kept and len(kept) >= 0.98 * len(before)
    # near duplicates: the smallest of each group of all-pairs links stays, unchanged
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := split((r.text or "").translate(low))) else set() for r in kept}
    of = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and of[a] != of[b] and (n := len(sets[a] & sets[b])) and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((of[a], of[b]))
                of = {d: x if k == y else k for d, k in of.items()}
    single = after["n-gram Jaccard join"]
    assert single == [r for r in kept if of[r.doc_id] == r.doc_id]
    # repeated passages: words in windows that a smaller document starts are gone
    first, want = {}, []
    for r in single:
        w = split(r.text)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), r.doc_id)
    for r in single:
        w = split(r.text)
        gone = {i + j for i in range(len(w) - 12) for j in range(13) if first[tuple(w[i : i + 13])] < r.doc_id}
        want.append((r.doc_id, b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else r.text))
    cut = after["substring dedup"]
    assert [(r.doc_id, r.text) for r in cut] == want and all(r.n_chars == len(r.text) for r in cut)
    # benchmark: what is gone aligns with an item, and all that aligns is gone
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    number: dict = {}
    coded = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], int)
    items, clean = [coded(t) for t in items], []
    for r in cut:
        text = coded(words(r.text))
        able = [t for t in items if 2 * np.isin(t, text).sum() >= len(t)]
        if not any(decontaminate.align(t, text)[0] >= len(t) for t in able):
            clean.append(r)
    assert after["benchmark decontamination"] == clean
    # the mix: all documents with their texts, and what is taken
    mixed = after["mixing sources to target weights"]
    assert [(r.doc_id, r.text, r.source) for r in mixed] == [(r.doc_id, r.text, r.source) for r in clean]
    assert all(0 <= r.taken <= 3 * r.size and r.size == len(split(r.text)) for r in mixed) and stages


def test_pipeline_runs_and_leaves_the_session(spark):
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "text", "taken"} <= set(out.columns) and out.count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == own
