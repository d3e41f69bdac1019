"""Streams with state against their batch twins, over restarts and arrivals out of order, and that their state shrinks."""

import datetime
import os
import random

from pyspark.sql import functions as F

from tessella.operators import access, lockout, search, usage
from tessella.streaming import live, state

START = datetime.datetime(2024, 1, 1)


def run(stream, checkpoint, sink, mode="append"):
    """Run a stream over what has come, from its checkpoint; gives the rows that its state holds at the end."""
    query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(sink)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]


def test_lockouts_over_restarts_and_out_of_order(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, i % 4 if i % 7 else None, START + datetime.timedelta(minutes=i * 2, seconds=rnd.randrange(60)), None if i % 11 == 0 else rnd.random() < 0.25) for i in range(300)]
    rows += [(900 + k, 9, START + datetime.timedelta(minutes=k), False) for k in range(6)]  # one who is not seen again
    rows.sort(key=lambda r: r[2] + datetime.timedelta(minutes=rnd.randrange(15)))  # up to a quarter of an hour late
    rows += [(999, 1, START + datetime.timedelta(days=5), True)]
    kind = "event_id long, user_id long, ts timestamp, ok boolean"
    held = []
    for lo in range(0, len(rows), 110):
        spark.createDataFrame(rows[lo : lo + 110], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = state.lockouts(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), most=4, minutes=25, late="20 minutes", forget_days=2)
        held.append(run(stream, f"{tmp_path}/c", f"{tmp_path}/out"))
    # what was registered for a time that had passed is done in the next batch
    spark.createDataFrame([(1000, 1, START + datetime.timedelta(days=5, hours=1), True)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    held.append(run(stream, f"{tmp_path}/c", f"{tmp_path}/out"))
    got = spark.read.parquet(f"{tmp_path}/out").where("at < unix_micros(timestamp '2024-01-06')")
    replay = lockout.lockout_replay(spark.createDataFrame([r for r in rows if r[1] is not None], kind), 4, 25, 2)
    want = {r.event_id: (r.user_id, r.failures, r.ignored) for r in replay.collect() if r.event_id != 999}
    assert {r.event_id: (r.user_id, r.failures, r.ignored) for r in got.where("kind = 'login'").collect()} == want
    assert got.where("kind = 'login'").count() == len(want) and sum(i for _, _, i in want.values()) > 20
    ends = replay.where("NOT ignored AND failures >= 4").select("user_id", F.unix_micros(F.col("locked_until").cast("timestamp")).alias("at"))
    assert sorted(map(tuple, got.where("kind = 'unlocked'").select("user_id", "at").collect())) == sorted(map(tuple, ends.collect())) and ends.count() > 5
    # logins that waited are gone, and so are those who were not seen for two days; the last user and login are there
    assert held[0] > 5 and held[-1] <= 2


def test_a_forgotten_user_starts_anew(spark):
    at = [START + datetime.timedelta(days=d) for d in (0, 1, 4, 5)]
    rows = spark.createDataFrame([(k, 1, t, False) for k, t in enumerate(at)], "event_id long, user_id long, ts timestamp, ok boolean")
    assert [r.failures for r in lockout.lockout_replay(rows, 5, 30, 2).orderBy("event_id").collect()] == [1, 2, 1, 2]
    assert [r.failures for r in lockout.lockout_replay(rows, 5, 30).orderBy("event_id").collect()] == [1, 2, 3, 4]


def test_live_history_is_that_of_the_table(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(f"m{i % 3}", float(rnd.randrange(50)), START + datetime.timedelta(hours=i)) for i in range(240)]
    rnd.shuffle(rows)
    kind = "metric string, value double, ts timestamp"
    for k in range(3):
        spark.createDataFrame([r for r in rows if k * 80 <= (r[2] - START).total_seconds() / 3600 < k * 80 + 80] + [(None, 1.0, START), ("m0", None, START)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = state.live_history(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), keep=20, retention_days=2)
        run(stream, f"{tmp_path}/c", f"{tmp_path}/out", "update")
    got = {r.metric: r for r in spark.read.parquet(f"{tmp_path}/out").orderBy("latest_at", "n").collect()}
    for want in usage.newest_points(spark.createDataFrame(rows, kind), 20, 2).collect():
        assert tuple(got[want.metric]) == tuple(want)


def test_state_of_silent_metrics_is_cleared(spark, tmp_path):
    kind = "metric string, value double, ts timestamp"
    parts = [[(m, float(i), START + datetime.timedelta(minutes=i)) for i in range(50) for m in "acd"], [("b", 1.0, START + datetime.timedelta(days=9))]]
    held = []
    for rows in parts:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = state.live_history(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), keep=30)
        held.append(run(stream, f"{tmp_path}/c", f"{tmp_path}/out", "update"))
    out = sorted((r.metric, r.n, r.latest) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == sorted([*((m, 0, None) for m in "acd"), *((m, 30, 49.0) for m in "acd"), ("b", 1, 1.0)])
    assert held == [3, 1]


def test_changed_and_repeated_files_leave_the_newest_chunks(spark, tmp_path):
    source, sink = tmp_path / "in", f"file://{tmp_path}/sink"
    source.mkdir()

    def put(name, text, at):
        (source / name).write_text(text)
        os.utime(source / name, (at, at))

    def step():
        live.replace_files(spark, f"file://{source}", sink, f"{tmp_path}/c", block=2, document=document).awaitTermination(120)

    document = F.regexp_extract("path", r"/([^/@]+)(?:@[^/]*)?$", 1)
    current = lambda: sorted((r.document, r.content) for r in live.current_chunks(spark, sink).collect())
    put("a", "1\n2\n3", 1_700_000_000)
    put("b", "x", 1_700_000_001)
    step()
    assert current() == [("a", "1\n2"), ("a", "3"), ("b", "x")]
    # a newer version under another name, a repeated one, an older one that comes late
    put("a@2", "one", 1_700_000_100)
    put("b@again", "x", 1_700_000_100)
    put("b@old", "older", 1_600_000_000)
    step()
    assert current() == [("a", "one"), ("b", "x")]
    step()
    assert current() == [("a", "one"), ("b", "x")]
    # a batch that is tried again writes what it wrote
    files = spark.read.format("binaryFile").load(f"file://{source}").where("path LIKE '%a@2'")
    live._take(files, "s9", sink, document, 2)
    live._take(files, "s9", sink, document, 2)
    assert current() == [("a", "one"), ("b", "x")]
    # changed in place
    put("b@again", "new\nb\nend", 1_700_000_900)
    step()
    assert current() == [("a", "one"), ("b", "x")]
    for _ in range(2):
        live.rescan_files(spark, f"file://{source}", sink, "1", block=2, document=document)
        assert current() == [("a", "one"), ("b", "end"), ("b", "new\nb")]
    live.compact_chunks(spark, sink, f"file://{tmp_path}/compact")
    assert spark.read.parquet(f"file://{tmp_path}/compact/chunks").count() == live.current_chunks(spark, f"file://{tmp_path}/compact").count() == len(current())


def test_requests_of_unknown_users_and_collections(spark):
    collections = spark.createDataFrame([(1, "a", 7, "private", 3), (2, "b", 7, "public", 3), (3, "c", 8, "public", 4), (4, "d", None, "public", 3)], "collection_id long, name string, workspace_id long, visibility string, owner_id long")
    members = spark.createDataFrame([(1, 5, "viewer", True), (1, 5, "viewer", True), (1, 6, "viewer", False)], "collection_id long, user_id long, role string, is_active boolean")
    users = spark.createDataFrame([(3, 7), (5, 7), (6, 7)], "user_id long, workspace_id long")
    asked = [(3, 1), (5, 1), (6, 1), (6, 2), (6, 3), (6, 4), (9, 2), (None, 2), (3, None), (5, 1)]
    got = access.check_requests(spark.createDataFrame(asked, "user_id long, collection_id long"), collections, members, users).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((*a, a in [(3, 1), (5, 1), (6, 2)])) for a in asked)


def test_deletion_reaches_what_refers_to_it(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {"u": frame([(1,), (2,), (3,)], "id long"), "c": frame([(10, 1), (11, 2), (12, None)], "cid long, owner long"), "m": frame([(10, 2), (11, 3), (12, 1)], "cid long, user long")}
    references = [access.Reference("u", "id", "c", "owner"), access.Reference("u", "id", "m", "user"), access.Reference("c", "cid", "m", "cid")]
    left = access.hard_delete(tables, references, "u", frame([(1, "x")], "id long, why string"))
    assert {n: sorted(map(str, map(tuple, t.collect()))) for n, t in left.items()} == {"u": ["(2,)", "(3,)"], "c": ["(11, 2)", "(12, None)"], "m": ["(11, 3)"]}


def test_usage_of_collections_without_queries_or_quality(spark):
    docs = spark.createDataFrame([("a", "t", 5, 0.05), ("a", "t", 7, 1.0), ("a", None, None, None), ("b", "u", 1, 0.95)], "collection string, type string, bytes long, quality double")
    points = spark.createDataFrame([("a", [1.0]), ("a", None)], "collection string, embedding array<double>")
    queries = spark.createDataFrame([("a", q, START) for q in ("x", "y", "y", None)], "collection string, query string, ts timestamp")
    got = {r.collection: r.asDict() for r in search.collection_usage(docs, points, queries, popular=1).collect()}
    assert got["a"] == {"collection": "a", "storage": 12, "storage_by_type": "t=12", "quality_histogram": "0.00=1,0.90=1", "vectors": 1, "daily_queries": "2024-01-01=4", "popular_queries": "2 y"}
    assert got["b"] == {"collection": "b", "storage": 1, "storage_by_type": "u=1", "quality_histogram": "0.90=1", "vectors": 0, "daily_queries": None, "popular_queries": None}
