"""Loading, change detection and sinks (SRC)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which all machines share, set as the session's checkpoint folder.

    It is the one that the session names in spark.checkpoint.dir; where the setting is absent a local master gets a folder of its own,
    and a cluster an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if folder or not context.getCheckpointDir():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in reliable storage: computed once, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC10: a named Parquet table of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_files(spark: SparkSession, path: str, include: list[str], exclude: list[str] = (), recursive: bool = True) -> DataFrame:
    """SRC1: files below ``path`` whose name matches one of the globs and none of the excluded ones, as binaryFile rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    like = lambda globs: [name.like(g.replace("_", r"\_").replace("*", "%").replace("?", "_")) for g in globs]
    keep = F.lit(False)
    for hit in like(include):
        keep = keep | hit
    for hit in like(exclude):
        keep = keep & ~hit
    return files.where(keep)


def decode_content(content: Column) -> Column:
    """SRC2: text of bytes, UTF-8 if valid and else Latin-1 (which never fails, so a third try is never made)."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def changed_documents(current: DataFrame, registry: DataFrame, key: str = "doc_id") -> DataFrame:
    """SRC3: rows that are new or whose hash differs from the registered one; a null registered hash counts as unchanged."""
    known = registry.select(F.col(key).alias("_key"), F.col("hash").alias("_hash"), F.lit(True).alias("_known"))
    joined = current.join(known, F.col(key) == F.col("_key"), "left")
    return joined.where(F.col("_known").isNull() | (F.col("_hash") != F.col("hash"))).select(*current.columns)


def size_guard(df: DataFrame, max_bytes: int, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """SRC4: (accepted, rejected) by UTF-8 size; a null text is accepted."""
    small = F.coalesce(F.octet_length(text_col) <= max_bytes, F.lit(True))
    return df.where(small), df.where(~small)


def upsert_vectors(base: DataFrame, delta: DataFrame, key: str = "vec_id") -> DataFrame:
    """SRC5: insert or replace by id; ``delta`` carries ``batch`` and its latest one wins."""
    both = base.withColumn("batch", F.lit(-1)).unionByName(delta.select(*base.columns, "batch"))
    newest = Window.partitionBy(key).orderBy(F.desc("batch"))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch")


def delete_vectors(base: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """SRC6: without the rows named in ``ids``."""
    return base.join(ids.select(key), key, "left_anti")


def document_registry(points: DataFrame) -> DataFrame:
    """SRC8: per document its collection, chunk count, hash and newest chunk."""
    return points.groupBy("doc_id").agg(F.max("collection").alias("collection"), F.count("*").alias("chunk_count"), F.max("hash").alias("hash"), F.max("indexed_at").alias("indexed_at"))


def indexing_summary(results: DataFrame) -> DataFrame:
    """SRC9: totals of an indexing run from (status, chunks, embeddings) rows."""
    total, failed = F.count("*"), F.count_if(F.col("status") == "failed")
    return results.agg(
        total.alias("processed"), F.count_if(F.col("status") == "completed").alias("succeeded"), failed.alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("embeddings"), F.lit(0)).alias("embeddings"),
        (failed == 0).alias("success"), F.round(100.0 * (total - failed) / F.greatest(total, F.lit(1)), 6).alias("success_rate"),
    )
