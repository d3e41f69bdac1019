"""Searches, tenants, logs and live operators on literal rows and against brute force."""

import datetime
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import ann, lockout, retrieval, search, usage, vectors
from tessella.sources import tables
from tessella.streaming import live, state

DATA = "/root/testdata/sf0.001"


def test_topk_of_odd_vectors_in_small_blocks(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 0.0]), (7, []), (8, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0]), (3, None)], "query_id long, embedding array<double>")
    for block in (1, 1 << 20):
        got = {}
        for r in vectors.vector_topk(asked, frame, 3, block_bytes=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 6)))
        assert sorted(got[1]) == [(1, 1, 1.0), (2, 6, 1.0), (3, 2, 0.0)]
        assert sorted(got[2]) == [(1, 3, 1.0), (2, 1, 0.0), (3, 2, 0.0)]
        assert sorted(got[3]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    assert vectors.vector_topk(asked.limit(0), frame, 3).count() == 0 and vectors.vector_topk(asked, frame.limit(0), 3).count() == 0


def test_topk_against_brute_force(spark):
    rnd = np.random.RandomState(4)
    m = rnd.randint(-2, 3, (3000, 4)).astype(float)  # many ties
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>").repartition(5)
    asked = frame.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    norm = np.linalg.norm(m, axis=1)
    score = np.round(m @ m.T / np.maximum(norm[:, None] * norm[None, :], 1e-300), 9)
    got = {}
    for r in vectors.vector_topk(asked, frame, 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, round(r.score, 9)))
    for q in range(0, 3000, 50):
        assert [s for _, s in sorted(got[q])] == sorted(score[q].tolist(), reverse=True)[:7]


def test_many_queries_stay_within_the_scores_of_a_step(spark, monkeypatch):
    """20,000 queries in a few blocks: no matrix is larger than the bound."""
    rnd = np.random.RandomState(9)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rnd.randn(600, 8))], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rnd.randn(20_000, 8))], "query_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "SCORES", 1 << 17)
    got = vectors.vector_topk(asked, frame, 2, block_bytes=1 << 20).agg(F.count("*"), F.sum("vec_id"), F.countDistinct("query_id")).first()
    monkeypatch.undo()
    assert got == vectors.vector_topk(asked, frame, 2).agg(F.count("*"), F.sum("vec_id"), F.countDistinct("query_id")).first() and got[0] == 40_000


def test_approximate_search_has_the_recall_it_promises(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = frame.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    true = {(r.query_id, r.vec_id) for r in vectors.vector_topk(asked, frame, 5).collect()}
    index = ann.build_ann_index(frame, tables.new_folder(spark, "ann"))
    found = {(r.query_id, r.vec_id) for r in ann.search_ann(index, asked, 5).collect()}
    assert len(found & true) >= 0.9 * len(true) and len(found) == len(true)
    parts = {(r.query_id, r.vec_id) for r in ann.search_ann(index, asked, 5, block_bytes=20_000).collect()}
    assert parts == found
    empty = ann.build_ann_index(frame.limit(0), tables.new_folder(spark, "ann"))
    assert ann.search_ann(empty, asked, 5).count() == 0 and ann.search_ann(index, asked.limit(0), 5).count() == 0


def test_keyword_scan_is_the_same_with_and_without_broadcast(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = ["the", "of", "and", "zzz", "to", "la", "de"]
    rnd = random.Random(2)
    rows = [(i, rnd.sample(words, rnd.randint(0, 4))) for i in range(30)]
    asked = spark.createDataFrame(rows, "query_id long, keywords array<string>")
    near, far = (sorted(map(tuple, retrieval.keyword_scan(asked, docs, 4, n).collect())) for n in (1_000_000, 0))
    assert near == far and len({q for q, *_ in near}) == sum(bool(set(k) - {"zzz"}) for _, k in rows)


def test_keyword_search_needs_keywords(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.5, 0.5]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    docs = spark.createDataFrame([(1, "nothing"), (2, "Alpha"), (3, "alpha beta"), (4, "alpha beta")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], ["alpha", "beta"]), (2, [1.0, 0.0], [])], "query_id long, embedding array<double>, keywords array<string>")
    assert [(r.query_id, r.doc_id, r.score, r.rank) for r in search.keyword_search(asked, points, docs, 3).orderBy("rank").collect()] == [(1, 3, 1.0, 1), (1, 2, 0.5, 2)]
    hybrid = search.hybrid_search(asked, points, docs, 2, method="simple").where("query_id = 1").orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in hybrid] == [(1, 1), (3, 2)] or hybrid[0].doc_id in (1, 3)


def test_tenants_see_their_own_points_only(spark):
    rows = [(1, [1.0, 0.0], "public", 5), (2, [1.0, 0.0], "private", 5), (3, [1.0, 0.0], None, 6), (4, [1.0, 0.0], "internal", None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, visibility string, owner long")
    points = search.tenant_tag(frame, (F.col("vec_id") % 2).cast("long"), F.lit("My-Set"), F.col("owner"))
    assert {r.tenant_collection for r in points.collect()} == {"ws_0_my_set", "ws_1_my_set"}
    asked = spark.createDataFrame([(1, [1.0, 0.0], 0, 5), (2, [1.0, 0.0], 0, 9), (3, [1.0, 0.0], 1, 6)], "query_id long, embedding array<double>, workspace_id long, user_id long")
    seen = lambda **how: sorted((r.query_id, r.vec_id) for r in search.tenant_search(asked, points, 9, **how).collect())
    assert seen() == [(1, 2), (1, 4), (2, 4), (3, 1), (3, 3)]
    assert seen(include_private=True) == [(1, 2), (1, 4), (2, 2), (2, 4), (3, 1), (3, 3)]
    assert seen(extra={"vec_id": {"lt": 3}}) == [(1, 2), (3, 1)]
    long = spark.createDataFrame([("0123-4567-89ab-cdef-0123",)], "w string").select(search.tenant_collection(F.col("w"), F.lit("A-b"))).first()[0]
    assert long == "ws_0123456789abcdef_a_b"


def test_circles_of_dependencies(spark):
    edges = [(1, "a", "b"), (1, "b", "c"), (2, "a", "b"), (2, "b", "a"), (3, "x", "x"), (4, "a", None), (5, "a", "b"), (5, "b", "c"), (5, "c", "d"), (5, "d", "b"), (6, "p", "q"), (6, "p", "q")]
    assert sorted(r.group for r in search.circular_dependencies(spark.createDataFrame(edges, "group long, src string, dst string")).collect()) == [2, 3, 5]
    assert search.circular_dependencies(spark.createDataFrame([], "group long, src string, dst string")).count() == 0


def logins(spark, n=400):
    rnd = random.Random(6)
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, i % 5, at + datetime.timedelta(minutes=rnd.randrange(3000)), rnd.random() < 0.3) for i in range(n)], "event_id long, user_id long, ts timestamp, ok boolean")


def test_lockouts_as_they_come_are_those_of_the_replay(spark, tmp_path):
    rows = logins(spark)
    known, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        failures, until = known.get(r.user_id, (0, None))
        ignored = until is not None and until > r.ts
        if not ignored:
            failures = 0 if r.ok else failures + 1
            until = None if r.ok else r.ts + datetime.timedelta(minutes=30) if failures >= 5 else until
        known[r.user_id] = failures, until
        want[r.event_id] = failures, ignored
    assert {r.event_id: (r.failures, r.ignored) for r in lockout.lockout_replay(rows).collect()} == want
    assert sum(i for _, i in want.values()) > 5
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.lockouts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), late="0 seconds").where("kind = 'login'")
    stream.writeStream.format("memory").queryName("lockouts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.event_id: (r.failures, r.ignored) for r in spark.table("lockouts").collect()} == want


def test_new_files_are_taken_once(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("\n".join(f"l{i}" for i in range(5)))
    (tmp_path / "in" / "b.bin").write_bytes(b"x")
    go = lambda: live.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), "*.txt", 2).awaitTermination(120)
    go()
    (tmp_path / "in" / "deep" / "c.txt").write_bytes("caf\xe9".encode("latin-1"))
    go()
    go()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.start_line, r.end_line, r.content) for r in rows) == [("a.txt", 1, 2, "l0\nl1"), ("a.txt", 3, 4, "l2\nl3"), ("a.txt", 5, 5, "l4"), ("c.txt", 1, 1, "café")]


def test_files_are_scanned_by_globs_and_decoded(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, raw in {"a.py": b"x", "b_test.py": b"y", "sub/c.py": "\xe9".encode(), "sub/d.txt": b"\xe9"}.items():
        (tmp_path / name).write_bytes(raw)
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(tables.scan_files(spark, str(tmp_path), ["*.py"], ["*_test.py"])) == ["a.py", "c.py"]
    assert names(tables.scan_files(spark, str(tmp_path), ["?.py", "*.txt"], [], False)) == ["a.py"]
    texts = tables.scan_files(spark, str(tmp_path / "sub"), ["*"]).select(tables.decode_content(F.col("content")).alias("t")).collect()
    assert {r.t for r in texts} == {"é"}


def test_windows_of_requests_reach_their_limit(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, at + datetime.timedelta(seconds=i)) for i in range(3)] + [(2, at)], "api_key_id long, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.request_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), limit=3)
    stream.writeStream.format("memory").queryName("requests").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    got = spark.table("requests").collect()
    assert len(got) == 12 and sum(r.blocked for r in got) == 6 and all(r.n <= 3 for r in got)


def test_rate_limits_look_over_midnight(spark):
    at = datetime.datetime(2024, 1, 2)
    times = [at - datetime.timedelta(hours=25), at - datetime.timedelta(hours=23), at - datetime.timedelta(seconds=30), at, at + datetime.timedelta(seconds=20)]
    rows = usage.rate_limit_check(spark.createDataFrame([(7, t) for t in times], "api_key_id long, ts timestamp"), 2, None, None).orderBy("ts").collect()
    assert [(r.last_minute, r.last_hour, r.last_day, r.blocked) for r in rows] == [(0, 0, 0, False), (0, 0, 1, False), (0, 0, 1, False), (1, 1, 2, False), (2, 2, 3, True)]


def test_cache_hits_against_a_plain_loop(spark):
    rnd = random.Random(8)
    at = datetime.datetime(2024, 1, 1)
    rows = [(rnd.choice(["a", "b", "c"]), at + datetime.timedelta(seconds=rnd.randrange(5000))) for _ in range(600)]
    hits, last = 0, {}
    for key, t in sorted(rows):
        if key in last and t - last[key] <= datetime.timedelta(seconds=60):
            hits += 1
        else:
            last[key] = t
    frame = spark.createDataFrame(rows, "k string, ts timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = usage.cache_hit_report(frame, "k", 60).first()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (got.requests, got.hits) == (600, hits)
    assert usage.cache_hit_report(frame.limit(0), "k", 60).first().requests == 0


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://host"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: other)})
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        tables.settled(type("Frame", (), {"sparkSession": Session()})())


def test_the_best_are_found_without_copies_of_the_scores():
    rnd = np.random.default_rng(3)
    score = rnd.integers(0, 500, (2_048, 1_500)) / 500
    best = vectors._Best(len(score), 5)
    tracemalloc.start()
    best.add(score, np.arange(score.shape[1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < score.nbytes / 2
    want = np.argsort(-score, axis=1, kind="stable")[:, :5]
    assert (best.id.reshape(-1, 5) == want).all() and (best.score.reshape(-1, 5) == np.take_along_axis(score, want, 1)).all()
