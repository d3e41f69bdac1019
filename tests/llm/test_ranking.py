"""Ranked search against scoring every document, and what the blocks' bounds save."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import ranking

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    rows = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    n_docs, n_terms = sum(1 for _, c in rows if c), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, []).extend(terms(text))
    for item, own in asked.items():
        scored = []
        for doc, c in rows:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, doc))
        out += [(item, k, doc, -score) for k, (score, doc) in enumerate(sorted(scored)[:10], 1)]
    return sorted(out)


def found(spark, docs, items, **how):
    index = ranking.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = ranking.search(index, spark.createDataFrame(items, "item_id long, text string"), **how)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block_terms", [1, 500_000])
def test_odd_rows(spark, block_terms):
    docs = [(1, None), (2, ""), (3, "The cat, the CAT; the end."), (4, "ÄÖ äö a-b_c 12é3"), (5, "the cat"), (5, "the cat"), (6, "the cat"), (None, "the cat cat"), (7, "cat " * 100_000), (8, "x" * 300_000 + " the")]
    items = [(1, "the cat"), (2, None), (3, ""), (4, "no such words"), (5, "äö Ä B C"), (6, "cat cat cat x"), (6, "end"), (None, "the")]
    assert found(spark, docs, items, block_terms=block_terms) == plain(docs, items)


def test_ties_over_many_shards(spark, monkeypatch):
    rng = np.random.RandomState(5)
    words = [f"w{int(x)}" for x in np.arange(60)]
    docs = [(int(i), " ".join(rng.choice(words, p=np.arange(60, 0, -1) / 1830, size=rng.randint(1, 12)))) for i in rng.permutation(3_000)]
    items = [(i, " ".join(rng.choice(words, size=6))) for i in range(40)]
    assert found(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = [(1, "a b", 1, "x")], [(1, "a")]
    index = ranking.build_index(spark.createDataFrame(docs, "doc_id long, text string, term long, shard string").limit(0))
    assert ranking.search(index, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    index = ranking.build_index(spark.createDataFrame(docs, "doc_id long, text string, term long, shard string"))
    assert ranking.search(index, spark.createDataFrame(items, "item_id long, text string").limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def one_shard(tf_rows, lengths):
    """A shard of (doc, term, tf) rows, as it is built and read back."""
    rows = sorted(tf_rows)
    doc, term, tf = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    stats = ranking.Stats(len(lengths), int(np.sum(lengths)))
    batches = list(ranking._shard(7, np.arange(len(lengths)), np.asarray(lengths), doc, term.astype(np.uint64), tf, stats))
    return next(ranking._shards(iter(batches))), stats


def test_blocks_are_passed_over():
    rng = np.random.RandomState(1)
    n = 40_000
    rows = [(d, 1, 1 + int(d % 97 == 0)) for d in range(n)] + [(d, 2, 1) for d in range(0, n, 2)] + [(int(d), 3, 3) for d in rng.choice(n, 30, replace=False)]
    shard, stats = one_shard(rows, np.full(n, 100))
    factors = [stats.weight(n), stats.weight(n // 2), stats.weight(30)]
    ids, scores = shard.search([1, 2, 3], factors, 0)
    every = np.zeros(n, np.int64)
    for doc, term, tf in rows:
        every[doc] += factors[term - 1] * int(ranking.impact(np.array(tf), stats.length(np.array(100))))
    want = np.lexsort((np.arange(n), -every))[:10]
    assert ids.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
    blocks, read = sum(len(x[2]) for x in shard.lists.values()), sum(map(len, shard.read.values()))
    assert blocks > 450 and read < 70  # at most a block of each frequent list for each of the 30 candidates
    # a floor that no block reaches leaves nothing to decompress
    again, _ = one_shard(rows, np.full(n, 100))
    assert not len(again.search([1, 2, 3], factors, 10**15)[0]) and not again.read


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 35) - 1), max_size=60))
def test_packed_numbers_come_back(values):
    data, size = ranking.packed(np.array(values, np.int64))
    assert ranking.unpacked(data).tolist() == values and size.sum() == len(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=30), min_size=11, max_size=400), st.lists(st.integers(0, 9), min_size=1, max_size=5, unique=True), st.integers(0, 5))
def test_search_equals_scoring_all(texts, asked, scale):
    counts = [Counter(t) for t in texts]
    shard, stats = one_shard([(d, t, n) for d, c in enumerate(counts) for t, n in c.items()], [len(t) for t in texts])
    factors = [1 + scale * t for t in asked]
    every = np.array([sum(f * int(ranking.impact(np.array(c[t]), stats.length(np.array(len(texts[d]))))) for t, f in zip(asked, factors) if c[t]) for d, c in enumerate(counts)])
    want = [d for d in np.lexsort((np.arange(len(every)), -every))[:10].tolist() if every[d]]
    assert shard.search(asked, factors, 0)[0].tolist() == want
