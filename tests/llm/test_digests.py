"""Exact dedup against a plain grouping, in one batch and in many, and across sessions' indexes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import digests

KIND = "doc_id long, text string, digest string, n int"
ROWS = [(1, "Same Text", "x", 1), (2, "same text", "y", 2), (9, "SAME TEXT", "z", 3), (3, None, None, 4), (4, "", None, 5), (5, "ÄÖ", None, 6), (6, "äö", None, 7), (7, "w " * 200_000, None, 8), (8, "W " * 200_000, None, 9), (None, "same text", None, 0), (None, "only here", None, 0), (10, "alone", None, 1), (10, "alone", None, 1)]


def plain(rows):
    """What stays of equal texts, by a dictionary."""
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(norm(text), []).append(doc)
    out = []
    for doc, text, *_ in rows:
        own = groups[norm(text)]
        keep = max((d for d in own if d is not None), default=None)
        out.append((doc, keep, len(own), doc == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_groups_of_odd_rows(spark, tmp_path, batches):
    found = digests.exact_groups(spark.createDataFrame(ROWS, KIND), f"file://{tmp_path}/index", batches=batches, buckets=3)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(ROWS)


def test_hot_text_and_empty_table(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"t{i % 1000}", "", 0) for i in range(9_000)]
    found = digests.exact_groups(spark.createDataFrame(rows, KIND), f"file://{tmp_path}/index", buckets=5)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)
    assert digests.exact_groups(spark.createDataFrame([], KIND), f"file://{tmp_path}/none").count() == 0


def test_the_index_outlives_its_session_and_keeps_what_it_has(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame(ROWS, KIND)
    first = digests.open_index(spark, path, 4)
    digests.add_batch(first, docs.where("doc_id <= 4"), "one")
    first.drop()
    again = digests.open_index(spark, path, 99)
    assert again.buckets == 4
    rows = digests.add_batch(again, docs.where("doc_id > 4"), "two")
    digests.add_batch(again, docs.where("doc_id > 4"), "two")  # a batch that is run again changes nothing
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in digests.resolve(again, rows).collect()}
    # 9 came after 1 and 2, so 2 stays; the batch's other texts are new
    assert found[9] == (2, 3, False) and found[5] == (5, 1, True) and found[7] == (8, 2, False) and found[8] == (8, 2, True)
    kept = digests.kept_documents(docs, again)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8, 10, 10]


def test_the_index_is_not_shuffled_in_the_anti_join(spark, tmp_path):
    index = digests.open_index(spark, f"file://{tmp_path}/index", 4)
    rows = digests.add_batch(index, spark.createDataFrame(ROWS, KIND), "one")
    texts = rows.groupBy("digest").agg(F.count("*").alias("n"))
    plan = texts.repartition(4, "digest").join(spark.table(index.entries).select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    index_side = join[join.rindex(":  ") :]
    assert "LeftAnti" in join and "Bucketed: true" in index_side and "Exchange" not in index_side.split("\n", 1)[1]
