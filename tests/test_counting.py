"""Keyword counts in the tasks that read documents: every match is counted, and none is shuffled."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.operators import counting, postings, rank, retrieval
from tessella.sources import tables


def made(spark, n=3_000, asked=200):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    share = [1 / (i + 1) for i in range(60)]
    texts = {i * 7 - 900: rnd.choices(words, share, k=rnd.randint(0, 25)) for i in rnd.sample(range(n), n)}
    keys = {i: sorted(set(rnd.choices([*words, "nowhere"], [*share, 0.1], k=rnd.randint(0, 7)))) for i in range(asked)}
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in texts.items()], "doc_id long, text string").repartition(6)
    queries = spark.createDataFrame(list(keys.items()), "query_id long, keywords array<string>")
    want = []
    for q, ks in keys.items():
        found = sorted((-len(set(ks) & set(ws)), i) for i, ws in texts.items() if set(ks) & set(ws))[:5]
        want += [(q, i, round(-n / len(ks), 6), r) for r, (n, i) in enumerate(found, 1)]
    return docs, queries, sorted(want)


def shuffled(spark, run):
    """Records that ``run`` shuffles."""
    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))
    before = written()
    rows = run()
    return written() - before, rows


def test_matches_are_counted_where_documents_are(spark):
    docs, queries, want = made(spark)
    records, got = shuffled(spark, lambda: sorted(map(tuple, retrieval.keyword_scan(queries, docs, 5).collect())))
    assert got == want
    # the matches are some 260,000; of each task and query at most 5 lists go out
    assert records < 200 * 5 * counting.tasks(spark) + 5_000


def test_posting_search_shuffles_lists_and_no_matches(spark):
    docs, queries, want = made(spark)
    index = postings.build_posting_index(docs, tables.new_folder(spark, "postings"), width=500)
    records, got = shuffled(spark, lambda: sorted(map(tuple, postings.search_postings(queries, index, 5).collect())))
    assert got == want
    assert records < index.blocks.count() + 200 * 5 * counting.tasks(spark) + 5_000


def test_queries_in_blocks_are_all_answered(spark):
    docs, queries, want = made(spark, 400)
    assert sorted(map(tuple, retrieval.keyword_scan(queries, docs, 5, 100).collect())) == want


def test_no_text_is_ranked_across_collections(spark):
    long = "x" * 5_000
    hits = spark.createDataFrame([(1, 1, 0, 0.5, 1, long), (1, 2, 1, 0.9, 1, long), (1, 3, 1, 0.8, 2, None), (1, 4, 0, 0.7, 2, "")], "query_id long, doc_id long, collection long, score double, rank int, content string")
    for search, want in ((rank.multi_collection_search, [4, 1]), (rank.cross_workspace_search, [2, 3, 4, 1])):
        found = search(hits)
        assert [r.doc_id for r in found.orderBy("rank").collect()] == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "content" not in plan.split("Window", 1)[1].split("Project", 1)[0] and "sha2" in plan


def test_features_move_words_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "Deep deep blue SEAS " * 500), (2, "the sea"), (3, None), (4, "blue")], "doc_id long, text string")
    prepared = rank.prepare_contents(docs, F.lit("a.txt"), F.lit("text"), F.lit(True))
    assert "text" not in prepared.columns
    asked = spark.createDataFrame([(7, "blue sea", "semantic", ["blue", "sea"]), (8, "eas", "code", ["eas"]), (9, "", "semantic", [])], "query_id long, query string, kind string, asked array<string>")
    hits = spark.createDataFrame([(q, d, 0.5) for q in (7, 8, 9) for d in (1, 2, 3, 4, 5)], "query_id long, doc_id long, score double")
    found, features = rank.rerank_features(hits, asked, prepared)
    got = {(r.query_id, r.doc_id): r for r in found.select("query_id", "doc_id", "whole", "inside", features["keyword_match"].alias("m")).collect()}
    assert {k: (r.whole, r.inside, r.m) for k, r in got.items() if k[1] < 5 and k[0] < 9} == {
        (7, 1): (1, 2, 1.0), (7, 2): (1, 1, 0.75), (7, 3): (0, 0, 0.0), (7, 4): (1, 1, 0.75), (8, 1): (0, 1, 0.5), (8, 2): (0, 0, 0.0), (8, 3): (0, 0, 0.0), (8, 4): (0, 0, 0.0),
    }
    assert len(got) == 12 and all(r.m == 0 for k, r in got.items() if k[0] == 9)


def without_broadcasts(spark, run):
    """Records that ``run`` shuffles, and what it gives, where no join is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return shuffled(spark, run)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hits_meet_their_queries_by_number(spark):
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["a", "b"])], "query_id long, _set array<string>")
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "_rep long, _set array<string>")
    lists = spark.createDataFrame([(r, f, [10 * f + i for i in range(3)]) for r in (1, 2) for f in range(1, 200)], "_rep long, found int, docs array<long>")
    n = 2 * 199
    records, got = without_broadcasts(spark, lambda: retrieval.scored(asked, sets, counting.best_of(lists, 600)).count())
    # lists are shuffled once, and the 3 * n hits made of them are not
    assert got == 3 * 3 * 199 and records < 1.5 * n


def test_hits_are_shuffled_by_query_document_and_query(spark):
    n = 40
    docs = spark.createDataFrame([(d, f"def deep {d} because step") for d in range(n)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"how function {q}", ("code", "question")[q % 2], ["how", "deep", str(q)]) for q in range(n)], "query_id long, query string, kind string, asked array<string>")
    hits = spark.createDataFrame([(q, d, (q * d) % 7 / 7) for q in range(n) for d in range(n)], "query_id long, doc_id long, score double")
    prepared = rank.prepare_contents(docs, F.lit("a.txt"), F.lit("text"), F.lit(True))
    records, got = without_broadcasts(spark, lambda: rank.rerank(*rank.rerank_features(hits, asked, prepared)).count())
    assert got == 10 * n and records < 3.5 * n * n
    found, features = rank.rerank_features(hits, asked, prepared)
    rows = found.select("query_id", features["code_relevance"].alias("c"), features["answer_likelihood"].alias("a")).distinct().collect()
    assert {(r.c, r.a) for r in rows if r.query_id % 2} == {(None, 0.1 + 0.2)} and {(round(r.c, 6), r.a) for r in rows if r.query_id % 2 == 0} == {(0.4, None)}


def test_known_documents_are_not_sorted_again(monkeypatch):
    rnd = np.random.RandomState(9)
    n, docs, k = 40, 600, 50
    has = rnd.rand(docs, 12) < 0.4
    sets = [np.flatnonzero(rnd.rand(12) < 0.6) for _ in range(n)]
    asked = counting.Queries(np.arange(n), pa.array([str(i) for i in range(12)]), np.cumsum([0, *map(len, sets)]), np.concatenate(sets))
    best, sizes, lexsort = counting.Most(asked, k, 20), [], np.lexsort
    monkeypatch.setattr(counting.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or lexsort(keys))
    ids = rnd.permutation(docs) * 3 - 200
    for lo in range(0, docs, 60):
        row, token = np.nonzero(has[lo : lo + 60])
        best.add(counting.shard_of(ids[lo : lo + 60], row, token, 12))
        if lo + 60 < docs:
            continue
        for q, own in enumerate(sets):
            count = has[:, own].sum(1)
            want = sorted((-c, i) for c, i in zip(count.tolist(), ids.tolist()) if c)[:k]
            assert [(-c, i) for c, i in zip(best.found[q].tolist(), best.doc[q].tolist()) if c] == want
    # a shard has 60 documents, few of which are better than the 50 known ones; the known ones of 40 queries are 2,000
    assert max(sizes[-3:]) < 1_000
