"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent a local master, as in tests, gets a folder of its own; a cluster, whose machines
    would each write to a folder that the others can't see, gets an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        own = getattr(shared_dir, "own", None)
        if own is None:
            own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def materialize(df: DataFrame, *, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and it is computed once.

    ``instead_of`` is an earlier result of this function that nothing reads any more; its files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if instead_of is not None:
        discard(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a result of ``materialize``; of any other frame, nothing."""
    path = df.__dict__.get("written_to")
    if path:
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


#: Passes over documents at most for ids that are broadcast part by part.
ID_PARTS = 16


def match_ids(docs: DataFrame, ids: DataFrame, how: str, broadcast_ids: int = 2_000_000, n: int | None = None) -> DataFrame:
    """``docs`` joined with ``ids`` by doc_id, without a shuffle of ``docs``: ``ids`` are broadcast, about ``broadcast_ids`` at a time.

    Each part of the ids meets the documents of the same part, which are read once for each. ``n`` is what ``ids`` count for, if not their
    rows. Only ids of more than ID_PARTS parts are joined by a shuffle.
    """
    n = ids.count() if n is None else n
    parts = -(-n // broadcast_ids) if broadcast_ids else ID_PARTS + 1
    if parts > ID_PARTS:
        return docs.join(ids, "doc_id", how)
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(max(1, parts)))
    own = [(docs, ids)] if parts <= 1 else [(docs.where(part == i), ids.where(part == i)) for i in range(parts)]
    return reduce(DataFrame.unionByName, [d.join(F.broadcast(x), "doc_id", how) for d, x in own])


def extended(schema: StructType, *more: tuple[str, str]) -> StructType:
    """A copy of ``schema`` with further columns."""
    out = StructType(list(schema.fields))
    for name, kind in more:
        out = out.add(name, kind)
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) long pairs -> (node, component): the smallest node reachable.

    Alternating large-star and small-star rounds: each is a group-by with a join on
    the grouped minimum, so no node's neighbour list is ever collected. The edges are
    written to the shared folder after each round, in place of the round's before, and the loop ends when a round
    changes none (a checksum over all edges tells).
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    pairs = materialize(pairs.distinct())
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: neighbours greater than u are linked to the least of u and its neighbours
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: neighbours smaller than u, and u itself, are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.where("u <> v").distinct(), instead_of=pairs)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
