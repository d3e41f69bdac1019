"""Exact de-duplication and reference counting (DED)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_contents(docs: DataFrame) -> DataFrame:
    """DED1: one row per content hash: size, language of the first document, reference count. Combined before the shuffle."""
    rows = docs.select("doc_id", "lang", F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("bytes"))
    return rows.groupBy("hash").agg(F.max("bytes").alias("size"), F.min_by("lang", "doc_id").alias("lang"), F.count("*").alias("reference_count"))


def attach_shared_content(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """DED2: documents with their shared row's hash and count."""
    return docs.withColumn("hash", F.sha2("text", 256)).join(shared.select("hash", "reference_count"), "hash").select("doc_id", "hash", "reference_count")


def release_references(shared: DataFrame, gone: DataFrame) -> DataFrame:
    """DED3: counts less the documents that are gone, not below 0; rows at 0 are dropped."""
    released = gone.select(F.sha2("text", 256).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    left = F.greatest(F.col("reference_count") - F.coalesce("n", F.lit(0)), F.lit(0))
    return shared.join(released, "hash", "left").withColumn("reference_count", left).where("reference_count > 0").drop("n")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """DED4, DED5: keys that occur more than once, and how often."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
