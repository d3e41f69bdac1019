"""Vectors from text, a user's own functions, and persisted indexes, on literal rows and against brute force."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tessella.operators import ann, embedding, extensions, postings, retrieval, search

DATA = "/root/testdata/sf0.001"


def plain_vectors(docs, texts, dim=64, buckets=1 << 16, seed=7):
    """The vectors that ``embed`` has to give, by dictionaries."""
    tokens = lambda t: re.findall(r"\w+", (t or "").lower())
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    met = {}
    for text in docs:
        for t in set(tokens(text)):
            b = int(digest(t)[:8], 16) % buckets
            met[b] = met.get(b, 0) + 1
    out = []
    for text in texts:
        v = [0.0] * dim
        for t in tokens(text):
            b = int(digest(t)[:8], 16) % buckets
            w = (math.log((len(docs) + 1) / (met.get(b, 0) + 1)) + 1) * (1 if digest(t)[8] >= "8" else -1)
            for j in range(dim):
                sign = int(digest(f"{seed}:{b}:{j // 32}")[:8], 16) >> (j % 32) & 1
                v[j] += w if sign else -w
        norm = math.sqrt(sum(x * x for x in v))
        out.append([x / norm for x in v] if norm > 1e-9 else None)
    return out


@pytest.mark.parametrize("dim, buckets", [(64, 1 << 16), (40, 7)])
def test_vectors_are_those_of_a_plain_version(spark, dim, buckets):
    texts = ["a b a", "B c", None, "", "... !!", "x" * 50_000, "word " * 20_000, "a b a", "été ÄÖ 日本"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = embedding.fit_embedder(docs, dim, buckets)
    found = {r.doc_id: r.embedding for r in embedding.embed(docs, model).collect()}
    for k, want in enumerate(plain_vectors(texts, texts, dim, buckets)):
        assert found[k] is None if want is None else found[k] == pytest.approx(want, abs=2e-6)
    assert found[0] == found[7] and found[2] is None and found[4] is None


def test_model_is_kept_and_embeds_what_it_never_met(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    embedding.fit_embedder(docs).write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))
    new = spark.createDataFrame([(1, "zyxwv never seen the"), (2, None)], "q long, said string")
    got = {r.q: r.embedding for r in embedding.embed(new, model, "q", "said").collect()}
    assert got[1] == pytest.approx(plain_vectors([r.text for r in docs.collect()], ["zyxwv never seen the"])[0], abs=2e-6) and got[2] is None
    assert embedding.embed(new.limit(0), model, "q", "said").count() == 0
    empty = embedding.fit_embedder(docs.limit(0), buckets=16)
    assert empty.count() == 16 and embedding.embed(new, empty, "q", "said").where("embedding is not null").count() == 1


def test_texts_are_shuffled_as_vectors_only(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = embedding.embed(docs, embedding.fit_embedder(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan and plan.count("partial_sum") >= 1


def test_a_text_finds_its_own_chunk(spark):
    docs = spark.createDataFrame([(k, "c", f"{k}.txt", "\n".join(f"line {k} {i} w{(k * 31 + i // 50) % 977}" for i in range(120))) for k in range(30)], "doc_id long, collection string, path string, text string")
    points, model = search.index_texts(docs)
    asked = points.where("doc_id = 11 AND chunk_index = 1").select(F.lit(5).cast("long").alias("query_id"), F.col("content").alias("text"))
    best = search.search_points(asked.unionByName(spark.createDataFrame([(6, None)], "query_id long, text string")), points, model, 2).orderBy("rank").collect()
    assert [(r.query_id, r.rank) for r in best] == [(5, 1), (5, 2)] and best[0].id == "11_chunk_1" and round(best[0].score, 5) == 1


def test_a_parser_of_the_users_own(spark):
    class Ini(extensions.Extension):
        @staticmethod
        def columns(options):
            if set(options) - {"sections"}:
                raise ValueError("only sections can be asked for")
            out = StructType().add("key", StringType()).add("value", StringType())
            return out.add("section", StringType()) if options.get("sections") else out

        @staticmethod
        def rows(text, options):
            section = None
            for line in text.splitlines():
                if line.startswith("["):
                    section = line.strip("[]")
                elif "=" in line:
                    key, value = line.split("=", 1)
                    yield (key.strip(), value.strip(), section) if options.get("sections") else (key.strip(), value.strip())

    extensions.register_parser(spark, "ini_rows", Ini, ("ini", "conf"))
    docs = spark.createDataFrame([(1, "ini", "a = 1\n[s]\nb=2=3"), (2, "conf", "[t]\nc = 'x'"), (3, "other", "d=1"), (4, "ini", None), (5, "ini", "")], "doc_id long, type string, text string")
    got = sorted((r.doc_id, r.key, r.value, r.section, r.parser) for r in extensions.parse_documents(docs, {"sections": "it's"}).collect())
    assert got == [(1, "a", "1", None, "ini_rows"), (1, "b", "2=3", "s", "ini_rows"), (2, "c", "'x'", "t", "ini_rows")]
    docs.createOrReplaceTempView("ini_docs")
    rows = spark.sql("SELECT d.doc_id, count(*) AS n FROM ini_docs d, LATERAL ini_rows(d.text) p GROUP BY d.doc_id")
    assert {(r.doc_id, r.n) for r in rows.collect()} == {(1, 2), (2, 1), (3, 1)} and "ArrowEvalPythonUDTF" in rows._jdf.queryExecution().executedPlan().toString()
    for call in ("ini_rows(d.doc_id)", "ini_rows(d.text, map('sections', d.type))", "ini_rows(d.text, map('colour', 'red'))"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM ini_docs d, LATERAL {call} p").collect()
    # a later parser of a type takes its place
    extensions.register_parser(spark, "line_rows", extensions.LineRecords, ("conf",))
    latest = {r.doc_id: r.parser for r in extensions.parse_documents(docs).collect()}
    assert latest == {1: "ini_rows", 2: "line_rows"}
    assert [tuple(r) for r in extensions.parsers(spark).where("type = 'conf'").orderBy("place").select("parser").collect()] == [("ini_rows",), ("line_rows",)]
    with pytest.raises(ValueError):
        extensions.register_function(spark, "drop table", Ini)


def test_a_chunkers_options_are_checked_before_it_runs(spark):
    extensions.register_function(spark, "chunks_of_words", extensions.WordChunks)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "  ")], "doc_id long, text string")
    got = [(r.chunk_no, r.first_word, r.content) for r in extensions.apply_function(docs, "chunks_of_words", {"size": 3, "overlap": 1}).orderBy("chunk_no").collect()]
    assert got == [(0, 0, "a b c"), (1, 2, "c d e")]
    with pytest.raises(AnalysisException):
        extensions.apply_function(docs, "chunks_of_words", {"size": 3, "overlap": 3})


def test_an_embedder_of_the_users_own(spark):
    extensions.register_embedder(spark, "lengths", lambda texts: [[len(t), 1.0] for t in texts], 2)
    docs = spark.createDataFrame([(1, "c", "p", "abc"), (2, "c", "q", None)], "doc_id long, collection string, path string, text string")
    points = search.build_index(docs, extensions.embed_with("lengths"))
    assert [(r.id, r.embedding) for r in points.where("doc_id = 1").collect()] == [("1_chunk_0", [3.0, 1.0])]
    docs.createOrReplaceTempView("to_embed")
    assert [r.v for r in spark.sql("SELECT lengths(text) AS v FROM to_embed ORDER BY doc_id").collect()] == [[3.0, 1.0], None]
    extensions.register_embedder(spark, "wrong", lambda texts: [[1.0] for _ in texts], 2)
    with pytest.raises(PythonException):
        spark.sql("SELECT wrong(text) FROM to_embed").collect()


def rows_read(df):
    """Rows that the scans of a frame that was checkpointed gave out, by their metrics."""
    n, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name.startswith("Scan parquet"):
            n += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_cells_that_cannot_hold_a_neighbour_are_not_read(spark, tmp_path, monkeypatch):
    rnd = np.random.RandomState(3)
    means = rnd.randn(400, 24)
    m = np.repeat(means, 50, axis=0) + 0.12 * rnd.randn(20_000, 24)
    frame = spark.createDataFrame([(int(i), m[i].tolist()) for i in rnd.permutation(len(m))], "vec_id long, embedding array<double>").repartition(6)
    asked = frame.where("vec_id % 997 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = ann.build_ann_index(frame, f"file://{tmp_path}/index")
    assert index.cells.count() == round(20_000**0.5) and index.rows.count() == 20_000
    # opened again, as another session would
    index = ann.open_ann_index(spark, f"file://{tmp_path}/index")
    scanned = []
    settle = ann.settled
    monkeypatch.setattr(ann, "settled", lambda df: (scanned.append(df), settle(df))[1])
    found = {(r.query_id, r.vec_id) for r in ann.search_ann(index, asked, 10).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    true = {(q, int(v)) for q in range(0, 20_000, 997) for v in np.argsort(-(unit @ unit[q]), kind="stable")[:10]}
    assert len(found & true) >= 0.9 * len(true)
    # a first ranking reads codes, and the scans of one query few of them, as their own metrics tell
    assert len(scanned) == 2
    plan = scanned[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "struct<vec_id:bigint,code:binary>" in plan
    scanned.clear()
    assert len(ann.search_ann(index, asked.where("query_id = 997"), 10).collect()) == 10
    assert 0 < sum(map(rows_read, scanned)) < 0.1 * 20_000


def test_posting_search_gives_the_rows_of_the_scan(spark, tmp_path):
    rnd = np.random.RandomState(2)
    words = np.array([f"w{i}" for i in range(120)])
    share = 1 / np.arange(1, 121)
    texts = [(int(i) - 700, " ".join(rnd.choice(words, size=rnd.randint(0, 40), p=share / share.sum()))) for i in rnd.permutation(3_000)]
    docs = spark.createDataFrame([*texts, (5_000, None), (None, "w0 w1"), (6_000, "")], "doc_id long, text string")
    rows = [(i, rnd.choice(words, size=rnd.randint(0, 7), replace=False, p=share / share.sum()).tolist()) for i in range(60)] + [(60, ["w1", "nowhere"]), (61, ["nowhere"]), (62, ["w1", "nowhere"])]
    queries = spark.createDataFrame(rows, "query_id long, keywords array<string>")
    index = postings.build_posting_index(docs, f"file://{tmp_path}/index", width=50)
    index = postings.open_posting_index(spark, f"file://{tmp_path}/index")
    want = sorted(tuple(r) for r in retrieval.keyword_scan(queries, docs.where("doc_id is not null"), 5).collect())
    for how in ({"starters": 1}, {}, {"broadcast_tokens": 0}):
        counts = {}
        assert sorted(tuple(r) for r in postings.search_postings(queries, index, 5, counts=counts, **how).collect()) == want
        assert counts["read"] < counts["pairs"] and counts["brought"] < counts["postings"] / 2
    assert index.width == 50 and index.blocks.where("n > 50 OR n <> size(docs)").count() == 0
    assert postings.search_postings(queries.limit(0), index, 5).count() == 0
    empty = postings.build_posting_index(docs.limit(0), f"file://{tmp_path}/empty")
    assert postings.search_postings(queries, empty, 5).count() == 0
