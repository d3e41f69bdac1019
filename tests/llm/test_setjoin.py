"""What the n-gram join and joins by document ids move."""

import random

from corpus_pipeline import drop_near_duplicates
from tessella.llm import setjoin
from tessella.llm.common import match_ids


def moved(spark, run):
    """Bytes that ``run`` shuffles and writes."""
    def so_far():
        context = spark.sparkContext
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))

    before = so_far()
    rows = run()
    return so_far() - before, rows


def texts(n, words=300):
    rnd = random.Random(3)
    return [" ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(words)) for _ in range(n)]


def test_hashes_that_occur_once_are_moved_once_and_packed(spark):
    rows = texts(1_200)
    rows[5], rows[9] = rows[2], rows[3] + " more"
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    size, got = moved(spark, lambda: {r.doc_id: r.component_id for r in setjoin.jaccard_components(docs).collect()})
    assert got == {i: {5: 2, 9: 3}.get(i, i) for i in range(1_200)}
    # a set of 296 has 107 least hashes; 7 bytes of each are moved, and 8 for digests and ids
    assert size < 1_200 * (107 * 7 + 200)


def test_hashes_are_told_by_bucket_and_label(spark):
    rows = texts(40, 60)
    docs = spark.createDataFrame([(i * 1_000_003 - 7, t) for i, t in enumerate(rows)] + [(-50, rows[0]), (-60, rows[0])], "doc_id long, text string")
    found = setjoin.repeated_hashes(docs, 5, 80, 48, 7).collect()
    assert {(r.rep, r.df) for r in found} == {(-7, 3), (-50, 3), (-60, 3)}
    assert len(found) == 3 * 56 and len({r.token for r in found}) == 56


def test_ids_meet_documents_in_parts(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in [*range(50), 7]] + [(None, "none")], "doc_id long, text string")
    ids = spark.range(0, 100, 7).withColumnRenamed("id", "doc_id")
    for n in (0, 1, 4, 100):
        assert sorted(r.doc_id for r in match_ids(docs, ids, "inner", n).collect()) == [0, 7, 7, *range(14, 50, 7)]
        left = [r.text for r in match_ids(docs, ids, "left_anti", n).collect()]
        assert sorted(left) == sorted(["none", *(f"t{i}" for i in range(50) if i % 7)])


def test_the_pipeline_does_not_shuffle_texts_to_drop_copies(spark):
    rows = texts(300, 1_500)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*rows, rows[0]])], "doc_id long, text string, lang string")
    threshold, batch = (spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        size, n = moved(spark, lambda: drop_near_duplicates(spark, docs, "").selectExpr("sum(length(text))").first()[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert n == sum(map(len, rows)) and size < 0.5 * n
