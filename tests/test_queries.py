"""Every own query against its SQL on the smallest tables, and the traps of some operators on literal rows."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella import queries as Q
from tessella.functions import profile as P
from tessella.operators import access, chunks, code, quality, rank, retrieval, vectors
from tessella.sources import tables
from tessella.streaming import live

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return f"{x + 0.0:.6g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(list(x)) if isinstance(x, (list, tuple)) else str(x)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, DATA), duck.sql(Q.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    mine = sorted([plain(r[c]) for c in sorted(names)] for r in got.collect())
    assert mine == sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in want.fetchall())


def test_settings_are_resolved_over_all_events(spark):
    best = {}
    for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id").collect():
        key = r.user_id % 40
        scope = key % 4 + r.event_id % (4 - key % 4)
        best[key] = min(best.get(key, (9, 0)), (scope, r.event_id))
    got = {r.key: (["user", "workspace", "organization", "global"].index(r.scope), r.value) for r in Q.QUERIES["rel7_settings_all"](spark, DATA).collect()}
    assert got == best and len({scope for scope, _ in got.values()}) == 4


def test_question_mark_goes_before_the_type_is_told(spark):
    row = spark.createDataFrame([("How does it work?",), ("islands of the north",), ("def f(): pass?",)], "q string").select(P.clean_query(F.col("q")), P.query_type(F.col("q"))).collect()
    assert [tuple(r) for r in row] == [("How does it work", "question"), ("islands of the north", "question"), ("def f(): pass?", "question")]


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, round(1 / math.sqrt(2), 6)]


def test_registered_null_hash_counts_as_unchanged(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, hash string")
    known = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, hash string")
    assert sorted(r.doc_id for r in tables.changed_documents(now, known).collect()) == [2, 3]


def test_merge_takes_pairs_only(spark):
    rows = spark.createDataFrame([(1, 1, 2, "a"), (1, 3, 4, "b"), (1, 5, 6, "c"), (1, 7, 30, "d")], "doc_id long, start_line int, end_line int, name string")
    assert sorted((r.start_line, r.end_line) for r in chunks.rule_merge_small(rows, 5).collect()) == [(1, 4), (5, 30)]


def test_like_wraps_the_value_and_unknown_fields_are_passed_over(spark):
    rows = spark.createDataFrame([("abc",), ("xbz",), ("q",)], "s string")
    assert access.apply_filters(rows, {"s": {"like": "b"}, "none": 3}).count() == 2


def test_reciprocal_ranks_stay_below_their_limit(spark):
    rows = spark.createDataFrame([(1, 7, 1), (1, 7, 1), (1, 8, 2)], "query_id long, doc_id long, rank int")
    assert retrieval.rrf_fuse(rows).first().score == round(2 / 61, 9)


def test_stream_of_arrivals_keeps_the_first(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 3}", datetime.datetime(2024, 1, 1, 0, i)) for i in range(9)], "doc_id long, text string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.first_arrivals(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("arrived").count() == 3


def test_stream_of_metrics_has_one_row_a_window(spark, tmp_path):
    rows = spark.createDataFrame([("m", float(i), datetime.datetime(2024, 1, 1, i // 2)) for i in range(8)], "metric string, value double, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.metric_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.n for r in spark.table("windows").collect()) == [2, 2, 2, 2]


def test_pattern_chunks_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x = 1\nclass A:\n    def f(self):\n        pass"), (4, "plain")], "doc_id long, text string")
    found = sorted((r.doc_id, r.start_line, r.end_line, r.type, r.name) for r in code.chunk_by_patterns(docs).collect())
    assert found == [(3, 2, 2, "class", "A"), (3, 3, 2, "function", "f"), (3, 3, 4, "method", "f")]
    rest = sorted(r.doc_id for r in code.chunk_with_fallback(docs).where("type = 'semantic_block'").collect())
    assert rest == [2, 4]


def test_assess_without_chunks_and_with_a_circle(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    held = spark.createDataFrame([(1, 0, "class", "Abcd", "a\nb", 1, 2, 1, ["x"])], "doc_id long, chunk_no int, type string, name string, content string, start_line int, end_line int, complexity int, dependencies array<string>")
    rows = {r.doc_id: r for r in quality.assess(held, docs, cyclic=docs.where("doc_id = 1")).collect()}
    assert (rows[1].dependency, rows[1].completeness, rows[1].coherence) == (0.6, 1.0, 0.9)
    assert (rows[2].coherence, rows[2].completeness, rows[2].dependency) == (0.0, 0.0, 0.8)


def test_expansion_of_a_question(spark):
    row = spark.createDataFrame([("how to sort", "question"), ("one", "semantic"), (None, "semantic")], "q string, k string").select(rank.expand(F.col("q"), F.col("k")).alias("e")).collect()
    assert [r.e for r in row][:2] == [["how to", "to sort", "sort"], []]
