"""Tenancy and permissions (ACL), and generic relational reads (REL)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each role may do.
PERMISSIONS = {"viewer": ("read",), "editor": ("read", "write"), "admin": ("read", "write", "admin"), "owner": ("read", "write", "admin")}


#: (user, collection) rows that a task gives out, about, collections that are broadcast at most, and users that go together.
TASK_ROWS, HELD_COLLECTIONS, CHUNK_USERS = 4_000_000, 1_000_000, 256


def accessible_collections(collections: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """ACL1: for each (user_id, workspace_id) the workspace's collections that are public or internal, own, or joined as an active member.

    What is open to all comes of the join by workspace, which streams; own and joined ones of the others are found from owners and
    members, so no pair of a user and a collection is shuffled.
    """
    is_open = F.coalesce(F.col("visibility").isin("public", "internal"), F.lit(False))
    everyone = _spread_pairs(users.select("user_id", "workspace_id"), collections.where(is_open).select("collection_id", "workspace_id"))
    rest = collections.where(~is_open)
    own = rest.select("collection_id", "workspace_id", F.col("owner_id").alias("user_id")).join(users, ["user_id", "workspace_id"])
    active = members.where("is_active").select("collection_id", "user_id")
    joined = active.join(rest.select("collection_id", "workspace_id", "owner_id"), "collection_id").where(~F.col("owner_id").eqNullSafe(F.col("user_id")))
    joined = joined.join(users, ["user_id", "workspace_id"]).dropDuplicates(["user_id", "collection_id"])
    return everyone.select("user_id", "collection_id").unionByName(own.select("user_id", "collection_id")).unionByName(joined.select("user_id", "collection_id"))


def _spread_pairs(users: DataFrame, collections: DataFrame) -> DataFrame:
    """``users`` and ``collections`` joined by workspace_id, in so many tasks by user that one gives out about TASK_ROWS rows.

    Users go by CHUNK_USERS at most; a chunk's rows come collection by collection, each with the chunk's users in the same order. So what is written of
    them has long runs of one collection and repeats of few users, and takes a small part of the room that rows by user take.
    """
    sizes = users.groupBy("workspace_id").agg(F.count("*").alias("n")).join(collections.groupBy("workspace_id").agg(F.count("*").alias("m")), "workspace_id")
    rows, widest, places = sizes.agg(F.sum(F.col("n") * F.col("m")), F.max("m"), F.count("*")).first()
    chunks = sizes.select("workspace_id", F.greatest(F.ceil(F.col("n") * F.col("m") / TASK_ROWS), F.ceil(F.col("n") / CHUNK_USERS)).alias("_chunks"))
    held, cut = (F.broadcast(x) if (n or 0) <= HELD_COLLECTIONS else x for x, n in ((collections, rows and widest * places), (chunks, places)))
    dealt = users.join(cut, "workspace_id").withColumn("_chunk", F.pmod(F.xxhash64("user_id"), F.col("_chunks")))
    dealt = dealt.repartition(max(1, -(-int(rows or 0) // TASK_ROWS)), "workspace_id", "_chunk").groupBy("workspace_id", "_chunk")
    pairs = dealt.agg(F.collect_list(F.struct(*[c for c in users.columns if c != "workspace_id"])).alias("_users")).join(held, "workspace_id")
    return pairs.withColumn("_user", F.explode("_users")).select("_user.*", *collections.columns)


def _with_joined(users: DataFrame, collections: DataFrame, members: DataFrame) -> DataFrame:
    """``users`` with _joined, the ids of those collections of the own workspace that the user's rows of ``members`` name."""
    here = members.select("collection_id", "user_id").join(collections.select("collection_id", "workspace_id"), "collection_id").join(users.select("user_id", "workspace_id"), ["user_id", "workspace_id"])
    return users.join(here.groupBy("user_id", "workspace_id").agg(F.collect_set("collection_id").alias("_joined")), ["user_id", "workspace_id"], "left")


def _is_joined() -> Column:
    return F.coalesce(F.array_contains("_joined", F.col("collection_id")), F.lit(False))


def check_requests(requests: DataFrame, collections: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """ACL1, ACL5: ``requests`` (user_id, collection_id, ...) with ``allowed``: by the rule of ``accessible_collections``, for what was asked alone.

    A collection of another workspace, and users and collections that are not there, are not allowed. Each join is on the request's
    own keys, so the result has the requests' rows, however many users and collections a workspace has.
    """
    own = collections.select("collection_id", F.col("workspace_id").alias("_place"), "visibility", "owner_id")
    active = members.where("is_active").select("collection_id", "user_id").distinct().withColumn("_member", F.lit(True))
    known = requests.join(own, "collection_id", "left").join(users.select("user_id", F.col("workspace_id").alias("_home")), "user_id", "left").join(active, ["collection_id", "user_id"], "left")
    may = F.col("visibility").isin("public", "internal") | (F.col("owner_id") == F.col("user_id")) | F.coalesce("_member", F.lit(False))
    return known.select(*requests.columns, F.coalesce((F.col("_place") == F.col("_home")) & may, F.lit(False)).alias("allowed"))


def role_permissions(members: DataFrame) -> DataFrame:
    """ACL2: can_read, can_write and can_admin of each member's role."""
    can = lambda p: F.col("role").isin(*[r for r, ps in PERMISSIONS.items() if p in ps])
    return members.select("collection_id", "user_id", "role", can("read").alias("can_read"), can("write").alias("can_write"), can("admin").alias("can_admin"))


def check_permission(requests: DataFrame, members: DataFrame, permission: str) -> DataFrame:
    """ACL3: whether each request's user holds the permission; an inactive or absent member doesn't."""
    can = F.col("role").isin(*[r for r, ps in PERMISSIONS.items() if permission in ps]) & F.col("is_active")
    return requests.join(members, ["collection_id", "user_id"], "left").select("collection_id", "user_id", F.coalesce(can, F.lit(False)).alias("allowed"))


def check_workspace(collections: DataFrame, users: DataFrame, members: DataFrame, permission: str) -> DataFrame:
    """ACL3 for every user and collection of the own workspace: the rows of ``check_permission``, without a shuffle of the pairs.

    Memberships, which are fewer, go to their user as a set of ids; pairs are only told by it.
    """
    able = members.where(F.col("role").isin(*[r for r, ps in PERMISSIONS.items() if permission in ps]) & F.col("is_active"))
    pairs = _spread_pairs(_with_joined(users.select("user_id", "workspace_id"), collections, able), collections.select("collection_id", "workspace_id"))
    return pairs.select("collection_id", "user_id", _is_joined().alias("allowed"))


def audit_rollup(audit: DataFrame) -> DataFrame:
    """ACL12: actions of each user and day."""
    return audit.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("action").alias("actions"))


def audit_log(audit: DataFrame, users: DataFrame, action: str, n: int) -> DataFrame:
    """ACL11: the newest rows of an action with the user's name, if any."""
    newest = audit.where(F.col("action") == action).orderBy(F.desc("ts"), F.desc("audit_id")).limit(n)
    return newest.join(users, "user_id", "left").select("audit_id", "user_id", "user_name", "ts")


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """REL1: eq ne gt gte lt lte in not_in like ilike; a bare list is in, a bare value equality; unknown fields are passed over. Like wraps the value in % as it is."""
    tests: list[Column] = []
    for key, spec in filters.items():
        if key not in df.columns:
            continue
        c = F.col(key)
        for op, x in (spec if isinstance(spec, dict) else {"in": spec} if isinstance(spec, list) else {"eq": spec}).items():
            tests.append({"eq": lambda: c == x, "ne": lambda: c != x, "gt": lambda: c > x, "gte": lambda: c >= x, "lt": lambda: c < x, "lte": lambda: c <= x, "in": lambda: c.isin(*x), "not_in": lambda: ~c.isin(*x), "like": lambda: c.like(f"%{x}%"), "ilike": lambda: c.ilike(f"%{x}%")}[op]())
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """REL2"""
    return df.orderBy(*order).offset(offset).limit(limit)


def settings_resolve(settings: DataFrame) -> DataFrame:
    """REL7: of each key's values the one of the narrowest scope: user, workspace, organization, global."""
    scope = F.when(F.col("scope") == "user", 1).when(F.col("scope") == "workspace", 2).when(F.col("scope") == "organization", 3).otherwise(4)
    return settings.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(scope, "value"))).where("_n = 1").select("key", "scope", "value")


def workspace_collections(collections: DataFrame, users: DataFrame, members: DataFrame) -> DataFrame:
    """ACL5: for each user the collections of the own workspace with the owner's name, if any, and whether the user owns or may see each."""
    owners = users.select(F.col("user_id").alias("owner_id"), F.col("user_name").alias("owner_name"))
    is_open = F.coalesce(F.col("visibility").isin("public", "internal"), F.lit(False)).alias("_open")
    named = collections.select("collection_id", "workspace_id", "owner_id", is_open).join(owners, "owner_id", "left")
    rows = _spread_pairs(_with_joined(users.select("user_id", "workspace_id"), collections, members.where("is_active")), named)
    own = F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False))
    return rows.select("user_id", "collection_id", "owner_name", own.alias("is_owner"), (F.col("_open") | own | _is_joined()).alias("has_access"))


def count_rows(df: DataFrame, filters: dict) -> DataFrame:
    """REL3: how many rows pass the filters of ``apply_filters``; 0 on an empty table."""
    return apply_filters(df, filters).agg(F.count("*").alias("total"))


def exclude_deleted(df: DataFrame) -> DataFrame:
    """REL4: rows not marked as deleted; a null mark counts as not deleted."""
    return df.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def soft_delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """REL4: all rows, those named in ``ids`` marked as deleted; rows marked before stay so."""
    gone = ids.select(F.col(key).alias("_key")).distinct().withColumn("_gone", F.lit(True))
    joined = df.join(gone, F.col(key) == F.col("_key"), "left")
    mark = F.col("_gone").isNotNull() | (F.coalesce(F.col("is_deleted"), F.lit(False)) if "is_deleted" in df.columns else F.lit(False))
    return joined.withColumn("is_deleted", mark).drop("_key", "_gone")


def page_info(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """REL5: total rows, the 1-based number of the page at ``offset``, pages in all, and whether others follow or go before."""
    total = F.count("*")
    return df.agg(total.alias("total"), F.lit(offset // limit + 1).cast("long").alias("page"), F.ceil(total / limit).alias("pages"), (total > offset + limit).alias("has_next"), F.lit(offset > 0).alias("has_previous"))


class Reference(NamedTuple):
    """A foreign key: rows of ``child`` go with the row of ``parent`` whose ``key`` is their ``column``."""

    parent: str
    key: str
    child: str
    column: str


def hard_delete(tables: dict[str, DataFrame], references: list[Reference], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """REL4: ``tables`` without the rows of ``root`` whose keys are in ``gone`` (of the columns that it shares with ``root``), and without what refers to them.

    ``references`` come from parents to children; what goes of a child is told by what went of all its parents, with one semi-join
    and one anti-join a reference. Rows whose column is null refer to nothing and stay.
    """
    shared = [c for c in gone.columns if c in tables[root].columns]
    went = {root: tables[root].join(gone.select(*shared), shared, "left_semi")}
    left = dict(tables) | {root: tables[root].join(gone.select(*shared), shared, "left_anti")}
    for ref in references:
        if ref.parent not in went:
            continue
        keys = went[ref.parent].select(F.col(ref.key).alias(ref.column)).distinct()
        more = left[ref.child].join(keys, ref.column, "left_semi")
        went[ref.child] = went[ref.child].unionByName(more) if ref.child in went else more
        left[ref.child] = left[ref.child].join(keys, ref.column, "left_anti").select(*left[ref.child].columns)
    return left
