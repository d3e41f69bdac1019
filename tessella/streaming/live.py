"""Live operators on Structured Streaming (STR); watermarks bound their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunks import chunk_by_lines
from ..sources.tables import decode_content


def metric_windows(points: DataFrame, period: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """STR2: summary of each metric in tumbling windows."""
    return points.withWatermark("ts", late).groupBy("metric", F.window("ts", period)).agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"))


def request_windows(usage: DataFrame, limit: int = 60, late: str = "10 minutes") -> DataFrame:
    """STR3: requests of each key in sliding minutes, and whether they reach the limit."""
    counts = usage.withWatermark("ts", late).groupBy("api_key_id", F.window("ts", "1 minute", "10 seconds")).agg(F.count("*").alias("n"))
    return counts.withColumn("blocked", F.col("n") >= limit)


def first_arrivals(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """STR4: documents whose content didn't arrive before, within the watermark."""
    return docs.withColumn("hash", F.sha2("text", 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])


def ingest_files(spark: SparkSession, path: str, sink: str, checkpoint: str, glob: str = "*", block: int = 50) -> StreamingQuery:
    """STR1: files that are new below ``path`` become chunks of ``block`` lines, appended to a Parquet table; each file is taken once.

    It takes what is there and stops; run it again for what has come since: the checkpoint knows which files are done.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    docs = files.select("path", F.sha2("content", 256).alias("hash"), decode_content(F.col("content")).alias("text"))
    chunks = chunk_by_lines(docs, block)
    return chunks.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: A row for each file that was taken, and one for each of its chunks, in folders by batch.
FILES = "document string, path string, modified timestamp, hash string, batch string"


def _take(files: DataFrame, batch: str, sink: str, document: Column, block: int) -> None:
    """Write a batch's files and chunks in place of what an earlier try of the same batch has written."""
    docs = files.select(document.alias("document"), "path", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), decode_content(F.col("content")).alias("text"))
    chunk_by_lines(docs, block).write.mode("overwrite").parquet(f"{sink}/chunks/batch={batch}")
    docs.drop("text").write.mode("overwrite").parquet(f"{sink}/files/batch={batch}")


def _binary(reader, path: str, glob: str) -> DataFrame:
    return reader.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)


def replace_files(spark: SparkSession, path: str, sink: str, checkpoint: str, glob: str = "*", block: int = 50, document: Column | None = None) -> StreamingQuery:
    """STR1: new files below ``path`` become chunks of ``block`` lines; of each document only the newest file's are current.

    ``document`` tells a file's document, its path unless given, so that files of several names may be versions of one. A batch writes
    its own folders, in place of what a try that failed has left there, so nothing is taken twice; ``current_chunks`` reads
    what is current, and ``compact_chunks`` takes away the rest. It takes what is there and stops. The stream knows a file by its path: for
    files that were changed where they are run ``rescan_files``.
    """
    by = F.col("path") if document is None else document
    return _binary(spark.readStream, path, glob).writeStream.foreachBatch(lambda df, n: _take(df, f"s{n}", sink, by, block)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def taken_files(spark: SparkSession, sink: str) -> DataFrame:
    """All files that were taken: (document, path, modified, hash, batch)."""
    return spark.read.schema(FILES).parquet(f"{sink}/files")


def rescan_files(spark: SparkSession, path: str, sink: str, batch: str, glob: str = "*", block: int = 50, document: Column | None = None) -> None:
    """STR1: take files that were changed in place since they were taken, as the batch named ``batch``.

    Only files that are not older than the newest one taken are read, by their modification time; of these, what was taken with
    the same time and content is left out. A batch that is run again under its name takes the same.
    """
    known = taken_files(spark, sink).where(F.col("batch") != f"r{batch}")
    newest = known.agg(F.max("modified").cast("string")).first()[0]
    if newest is None:
        return
    since = _binary(spark.read.option("timeZone", spark.conf.get("spark.sql.session.timeZone")).option("modifiedAfter", newest.split(".")[0].replace(" ", "T")), path, glob)
    held = known.select(F.col("path").alias("_p"), F.col("modified").alias("_m"), F.col("hash").alias("_h"))
    same = (F.col("path") == F.col("_p")) & (F.col("modificationTime") == F.col("_m")) & (F.sha2("content", 256) == F.col("_h"))
    _take(since.join(held, same, "left_anti"), f"r{batch}", sink, F.col("path") if document is None else document, block)


def current_chunks(spark: SparkSession, sink: str) -> DataFrame:
    """The chunks of each document's newest file; of files of one time the one taken last, then by path. A file without chunks leaves its document none."""
    newest = taken_files(spark, sink).groupBy("document").agg(F.max(F.struct("modified", F.length("batch").alias("_n"), "batch", "path")).alias("x"))
    named = newest.select("document", "x.batch", "x.path", "x.modified")
    return spark.read.parquet(f"{sink}/chunks").join(named, ["document", "batch", "path", "modified"], "left_semi")


def compact_chunks(spark: SparkSession, sink: str, into: str) -> None:
    """Write what is current below ``sink`` to ``into``, in the same layout, as one batch; the old folders may then go."""
    chunks = current_chunks(spark, sink)
    files = taken_files(spark, sink).join(chunks.select("document", "batch", "path", "modified").distinct(), ["document", "batch", "path", "modified"], "left_semi")
    chunks.drop("batch").write.mode("overwrite").parquet(f"{into}/chunks/batch=c0")
    files.drop("batch").select("document", "path", "modified", "hash").write.mode("overwrite").parquet(f"{into}/files/batch=c0")
