"""Exact dedup: a persistent index of text digests, bucketed and sorted; a sort-merge anti-join finds what is new, and that is appended."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: The only letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A digest with more than one of so many rows of the whole index is joined by broadcast: there are fewer than this many.
HOT_SHARE = 2_000


def text_digest(text: Column) -> Column:
    """SHA-256, as bytes, of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256))


class DigestIndex(NamedTuple):
    """Two Parquet tables of the same buckets: ``entries`` has a row (digest, keep_id) for each text, ``counts`` one (digest, batch, n) for each text and batch."""

    spark: SparkSession
    entries: str
    counts: str
    buckets: int

    def known(self) -> DataFrame:
        """(digest, keep_id, n): each text with the id that stays and its rows in all batches; read bucket by bucket, without a shuffle."""
        once = self.spark.table(self.counts).groupBy("digest", "batch").agg(F.max("n").alias("n"))
        sizes = once.groupBy("digest").agg(F.sum("n").alias("n"))
        return self.spark.table(self.entries).join(sizes.hint("merge"), "digest")

    def drop(self) -> None:
        """Take the tables out of the session's catalogue; their files stay."""
        for name in (self.entries, self.counts):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
    """The index kept below ``path``, which all machines share; a new one of ``buckets`` buckets where there is none.

    The number of buckets is that of the session's shuffle partitions unless given: a bucket is what one task reads, and what a task of the
    session's shuffles writes. It is kept beside the tables, so an index opened in a later session has the one that it was made with.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path.rstrip("/")
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/made")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        buckets = spark.read.schema("buckets int").json(f"{path}/made").first()[0]
    else:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/made")
    tag = uuid.uuid4().hex
    index = DigestIndex(spark, f"digest_entries_{tag}", f"digest_counts_{tag}", buckets)
    for name, columns, part in ((index.entries, "digest BINARY, keep_id BIGINT", "entries"), (index.counts, "digest BINARY, batch STRING, n BIGINT", "counts")):
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")
    return index


def _append(rows: DataFrame, name: str, buckets: int) -> None:
    rows.repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(name)


def add_batch(index: DigestIndex, docs: DataFrame, batch: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append what is new in ``docs`` to the index; gives the batch's (doc_id, digest) rows, written once.

    Equal texts of the batch become one row, the one of the largest id, before they are shuffled any further (counts are combined where
    rows are read, so a text that a third of all rows share is no hot spot). The anti-join meets the index bucket by
    bucket: the index itself is not shuffled. A batch that failed halfway may be added again under its name: its ids are
    found in the index, and its counts are taken once.
    """
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")))
    texts = materialize(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")))
    new = texts.repartition(index.buckets, "digest").join(index.spark.table(index.entries).select("digest").hint("merge"), "digest", "left_anti")
    _append(new.select("digest", "keep_id"), index.entries, index.buckets)
    _append(texts.select("digest", F.lit(batch).alias("batch"), "n"), index.counts, index.buckets)
    return rows


def resolve(index: DigestIndex, rows: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of rows that ``add_batch`` gave: which row of each text stays, over all batches.

    Digests with more than 1 / HOT_SHARE of all rows, fewer than HOT_SHARE of them however large the index is, are broadcast; the
    rest is a sort-merge join with the index's buckets, none of whose keys is large.
    """
    known = index.known()
    total = index.spark.table(index.counts).agg(F.sum("n")).first()[0] or 0
    hot = materialize(known.where(F.col("n") * HOT_SHARE > total))
    often = rows.join(F.broadcast(hot), "digest")
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").repartition(index.buckets, "digest").join(known.hint("merge"), "digest")
    both = often.select("doc_id", "digest", "keep_id", "n").unionByName(rest.select("doc_id", "digest", "keep_id", "n"))
    return both.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_groups(docs: DataFrame, path: str, *, batches: int = 2, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact dedup of a whole table by the index below ``path``, fed by ranges of ids, the largest first: of equal texts the row with the largest id stays.

    What an earlier batch (or an earlier run on the same path) has put into the index stays there: later rows of the same text
    are dropped, whatever their ids. Rows: doc_id, keep_id, group_size (of all batches), kept, text_sha256. Texts are equal
    when identical after lower-casing A-Z; a null text counts as empty. Rows that repeat an id and its text count one each and are
    marked alike; rows without an id come last and stay only where no row of their text has one (keep_id is then null). Other columns
    of ``docs``, whatever their names, are not read; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = open_index(docs.sparkSession, path, buckets)
    share = [1 - k / batches for k in range(1, batches)]
    cuts = own.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), 1_000)).first()[0] if share else []
    cuts = list(dict.fromkeys(cuts or []))
    found, above = [], None
    for cut in [*cuts, None]:
        part = own if cut is None else own.where(F.col("doc_id") > cut)
        if above is not None:
            part = part.where(F.col("doc_id").isNull() | (F.col("doc_id") <= above))
        found.append(add_batch(index, part, f"ids above {cut}"))
        above = cut
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    return resolve(index, rows)


def kept_documents(docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id the index holds for their text, with all their columns: a semi-join against its buckets."""
    digest = f"digest_{uuid.uuid4().hex}"
    own = docs.withColumn(digest, text_digest(F.col(text_col))).repartition(index.buckets, digest)
    held = index.spark.table(index.entries).hint("merge")
    joined = own.join(held, (own[digest] == held["digest"]) & own[id_col].cast("long").eqNullSafe(held["keep_id"]), "left_semi")
    return joined.drop(digest)
