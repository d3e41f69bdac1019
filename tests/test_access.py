"""Access of all users of a workspace: the pairs are not shuffled, and odd rows are told alike."""

from tessella.operators import access


def tables(spark):
    users = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "c", 8), (4, "d", None)], "user_id long, user_name string, workspace_id int")
    collections = spark.createDataFrame([(10, 7, 1, "private"), (11, 7, 3, "public"), (12, 7, None, None), (13, 8, 2, "private"), (14, 8, 9, "internal")], "collection_id long, workspace_id int, owner_id long, visibility string")
    members = spark.createDataFrame([(10, 1, "owner", True), (10, 2, "viewer", True), (12, 2, "editor", True), (12, 1, "editor", False), (13, 3, "editor", True), (13, 1, "admin", True)], "collection_id long, user_id long, role string, is_active boolean")
    return collections, members, users


def test_accessible_collections(spark):
    got = access.accessible_collections(*tables(spark))
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (2, 10), (2, 11), (2, 12), (3, 13), (3, 14)]


def test_check_workspace_is_check_permission_of_all_pairs(spark):
    collections, members, users = tables(spark)
    pairs = collections.join(users, "workspace_id").select("collection_id", "user_id")
    want = sorted(map(tuple, access.check_permission(pairs, members, "write").collect()))
    got = access.check_workspace(collections, users, members, "write")
    assert sorted(map(tuple, got.collect())) == want and sum(w[2] for w in want) == 3


def test_workspace_collections(spark):
    collections, members, users = tables(spark)
    got = access.workspace_collections(collections, users, members)
    assert sorted(map(tuple, got.select("user_id", "collection_id", "is_owner", "has_access").collect())) == [
        (1, 10, True, True), (1, 11, False, True), (1, 12, False, False), (2, 10, False, True), (2, 11, False, True), (2, 12, False, True), (3, 13, False, True), (3, 14, False, True),
    ]


def test_a_task_gives_out_a_bounded_number_of_pairs(spark, monkeypatch):
    collections, members, users = tables(spark)
    monkeypatch.setattr(access, "TASK_ROWS", 1)
    assert access.check_workspace(collections, users, members, "write").rdd.getNumPartitions() == 8


def test_pairs_are_not_shuffled(spark):
    users = spark.range(600).selectExpr("id AS user_id", "'u' AS user_name", "0 AS workspace_id")
    collections = spark.range(100).selectExpr("id AS collection_id", "0 AS workspace_id", "id AS owner_id", "if(id % 2 = 0, 'public', 'private') AS visibility")
    members = spark.range(1_000).selectExpr("id % 100 AS collection_id", "id % 599 AS user_id", "'editor' AS role", "true AS is_active")

    def written():
        context = spark.sparkContext
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for run in (lambda: access.accessible_collections(collections, members, users), lambda: access.check_workspace(collections, users, members, "write"), lambda: access.workspace_collections(collections, users, members)):
            before = written()
            rows = run().collect()
            assert len(rows) > 30_000 and written() - before < 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_what_is_written_of_the_pairs_takes_little_room(spark, tmp_path):
    users = spark.range(4_000).selectExpr("id * 977 AS user_id", "'u' || id AS user_name", "id % 5 AS workspace_id")
    collections = spark.range(1_000).selectExpr("id * 983 AS collection_id", "id % 5 AS workspace_id", "id * 977 AS owner_id", "if(id % 3 > 0, 'public', 'private') AS visibility")
    members = spark.range(1_000).selectExpr("id * 983 AS collection_id", "id * 977 AS user_id", "'editor' AS role", "true AS is_active")
    for name, rows in (("one", access.accessible_collections(collections, members, users)), ("three", access.check_workspace(collections, users, members, "write")), ("five", access.workspace_collections(collections, users, members))):
        rows.coalesce(2).write.parquet(str(tmp_path / name))
        n = spark.read.parquet(str(tmp_path / name)).count()
        assert n > 500_000 and sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet")) < 0.4 * n
