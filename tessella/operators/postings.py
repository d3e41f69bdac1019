"""A persisted inverted index in blocks of documents, and a keyword search that passes over blocks and frequent tokens (RET3).

A block is a range of document ids. The documents of a query's rarest tokens give it a k-th best. What it can find in a block
at most is how many of its tokens the block has, so a block that can't hold a better document is not read; in the others only
the rarer tokens bring up candidates, as a document that has none of them can't have enough. All of a block's lists are in one
task, where its documents are counted.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import settled
from .counting import best_of, block_shards, most_keywords, tasks
from .retrieval import postings, scored

BLOCKS = "token string, block long, n int, docs array<long>"


class PostingIndex(NamedTuple):
    """``blocks``: (token, block, n, docs): the ids, in order, of the documents of a block that have the token; ``width``: ids in a block."""

    blocks: DataFrame
    width: int


def build_posting_index(docs: DataFrame, path: str, width: int | None = None, key: str = "doc_id", text_col: str = "text") -> PostingIndex:
    """Write the index of all distinct tokens of all documents below ``path`` and open it.

    ``width`` is the square root of the documents, and 1,024 at least, unless told; it bounds a row, so a token that every
    document has is many rows. One shuffle of (token, id) pairs, by token and block. Null texts have no tokens.
    """
    spark = docs.sparkSession
    width = width or max(1_024, round(docs.count() ** 0.5))
    spark.createDataFrame([(width,)], "width int").coalesce(1).write.mode("overwrite").json(f"{path}/made")
    pairs = postings(docs.where(F.col(key).isNotNull()), key, text_col).select("token", F.col("doc").cast("long").alias("doc"))
    ids = F.sort_array(F.collect_set("doc"))
    blocks = pairs.groupBy("token", F.floor(F.col("doc") / width).alias("block")).agg(ids.alias("docs"))
    blocks.select("token", "block", F.size("docs").alias("n"), "docs").sortWithinPartitions("token", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    return open_posting_index(spark, path)


def open_posting_index(spark: SparkSession, path: str) -> PostingIndex:
    """The index that ``build_posting_index`` wrote below ``path``."""
    return PostingIndex(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), spark.read.schema("width int").json(f"{path}/made").first()[0])


def search_postings(queries: DataFrame, index: PostingIndex, k: int, starters: int = 20, broadcast_tokens: int = 1_000_000, counts: dict | None = None) -> DataFrame:
    """RET3: (query_id, doc_id, score, rank) of (query_id, keywords): the best ``k`` documents by the share of keywords they have, ties by id; the rows of ``keyword_scan``.

    Queries of the same keywords are searched once, in blocks of ``broadcast_tokens`` keywords. A task takes a range of the index's blocks and
    holds its k-th best of each query, which others have to reach; a query starts with its rarest tokens, of the rarest at least and of
    more while they have ``starters`` times ``k`` documents together. A block is read for a query if it has more of its
    tokens than that, or as many and smaller ids. With c tokens to reach of the m that a block has, a candidate has one of
    the m - c + 1 rarest: the lists of the others are only met with candidates. What is shuffled is the index's lists of the queries' tokens,
    and the tasks' best. ``counts``, if given, gets how many (query, block) pairs there are and how many were read, and how many
    postings the queries' tokens have and how many candidates were brought up.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.array_sort("keywords").alias("_set")).where(F.size("_set") > 0)
    sets = settled(asked.groupBy("_set").agg(F.min("query_id").alias("_rep")))
    tokens = settled(sets.select(F.explode("_set").alias("token")).distinct())
    small = tokens.count() <= broadcast_tokens
    held = index.blocks.join(F.broadcast(tokens) if small else tokens, "token", "left_semi").select("block", "token", "docs")
    held = held.repartitionByRange(tasks(spark), "block").sortWithinPartitions("block")
    lists = most_keywords(sets, held, block_shards, k, broadcast_tokens, starters)
    if counts is not None:
        lists = settled(lists)
        made = dict(lists.where("found < 0").select("found", F.explode("docs").alias("n")).groupBy("found").agg(F.sum("n")).collect())
        counts |= {name: made.get(-1 - i, 0) for i, name in enumerate(("pairs", "read", "postings", "brought"))}
    return scored(asked, sets, best_of(lists, k))
