"""Keyword scores, candidate search by an inverted index, rank fusion and result rows (RET)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import WORD
from ..sources.tables import new_folder, settled
from .counting import best_of, most_keywords, tasks, text_shards


def keyword_score(words: Column, content: Column) -> Column:
    """RET1: the share of the keywords that the content holds, whatever their case; 0 without keywords."""
    hit = F.filter(words, lambda w: F.contains(F.lower(content), w))
    return F.when(F.size(words) > 0, F.size(hit) / F.size(words)).otherwise(F.lit(0.0))


def distinct_tokens(text_col: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(f"({WORD})"), 1))


def postings(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, doc): each document's distinct tokens."""
    return docs.select(F.col(key).alias("doc"), F.explode(distinct_tokens(text_col)).alias("token"))


def keyword_scan(queries: DataFrame, docs: DataFrame, k: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """RET3: (query_id, keywords) against all documents: the best ``k`` by matched keywords over all, ties by id.

    Queries of the same keywords are scored once. They are broadcast in blocks of ``broadcast_rows`` keywords; matches are counted in
    the task that reads a document, which gives out its best ``k`` of each query and no matches. Where there are several
    blocks the documents' tokens are written once.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.array_sort("keywords").alias("_set")).where(F.size("_set") > 0)
    sets = settled(asked.groupBy("_set").agg(F.min("query_id").alias("_rep")))
    tokens = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), distinct_tokens("text").alias("tokens"))
    if (sets.agg(F.sum(F.size("_set"))).first()[0] or 0) > broadcast_rows:
        path = new_folder(spark, "tokens")
        tokens.write.parquet(path)
        tokens = spark.read.parquet(path)
    lists = most_keywords(sets, tokens.coalesce(tasks(spark)), text_shards, k, broadcast_rows)
    return scored(asked, sets, best_of(lists, k))


def scored(asked: DataFrame, sets: DataFrame, top: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank) of all queries by what was found for their sets, which is met by number: keywords are not copied to hits."""
    named = asked.join(sets, "_set").select("query_id", "_rep", F.size("_set").alias("_n"))
    return top.join(named, "_rep").select("query_id", F.col("doc").alias("doc_id"), F.round(F.col("found") / F.col("_n"), 6).alias("score"), "rank")


def rrf_fuse(lists: DataFrame, constant: int = 60) -> DataFrame:
    """RET4: reciprocal rank fusion of (list, query_id, doc_id, rank) rows: the sum of 1 / (60 + rank), ties by id."""
    fused = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def weighted_fuse(vector: DataFrame, keyword: DataFrame, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """RET5: weighted sum of both scores, a missing one counts 0."""
    both = vector.select("query_id", "doc_id", F.col("score").alias("v")).join(keyword.select("query_id", "doc_id", F.col("score").alias("w")), ["query_id", "doc_id"], "full")
    return both.select("query_id", "doc_id", F.round(weights[0] * F.coalesce("v", F.lit(0.0)) + weights[1] * F.coalesce("w", F.lit(0.0)), 8).alias("score"))


def simple_fuse(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """RET6: both lists; of a document in both the vector copy stays."""
    both = vector.select("query_id", "doc_id", "score").withColumn("_p", F.lit(0)).unionByName(keyword.select("query_id", "doc_id", "score").withColumn("_p", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("_p"))).where("_n = 1").select("query_id", "doc_id", "score")


def retrieval_stats(log: DataFrame) -> DataFrame:
    """RET12"""
    return log.agg(F.count("*").alias("total"), F.round(100.0 * F.count_if(F.col("status") == "completed") / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"), F.round(F.avg("processing_time"), 6).alias("avg_time"), F.round(F.avg("result_count"), 6).alias("avg_results"))


def document_search(docs: DataFrame, text: str, fields: list[str], order: list[Column], offset: int, limit: int) -> DataFrame:
    """RET14: rows one of whose fields holds the text, whatever its case, in pages."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.col(f).ilike(f"%{text}%")
    return docs.where(hit).orderBy(*order).offset(offset).limit(limit)


def result_rows(hits: DataFrame, docs: DataFrame, preview: int = 500) -> DataFrame:
    """RET15: rank, score and the first 500 characters of each hit."""
    return hits.join(docs.select("doc_id", F.left("text", F.lit(preview)).alias("preview")), "doc_id").select("query_id", "rank", "doc_id", "score", "preview")


def retrieval_counts(results: DataFrame) -> DataFrame:
    """RET16: how often each document was retrieved, and its best rank."""
    return results.groupBy("doc_id").agg(F.count("*").alias("retrieved"), F.min("rank").alias("best_rank"))


def final_filters(hits: DataFrame, min_score: float, languages: list[str] | None = None, limit: int = 10) -> DataFrame:
    """RET8: of each query's hits the best ``limit`` that reach the score and are in one of the languages; ties by id."""
    kept = hits.where(F.col("score") >= min_score)
    if languages is not None:
        kept = kept.where(F.col("lang").isin(*languages))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


#: What a token counts in a title, a text and among keywords.
TERM_WEIGHTS = {"title": 1.0, "content": 0.4, "keywords": 0.2}


def weighted_terms(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """RET13: (doc, token, n, weight) over the columns named in TERM_WEIGHTS; words are not stemmed. Null texts have none."""
    parts = F.array(*[F.struct(F.lit(w).alias("weight"), F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1).alias("tokens")) for c, w in TERM_WEIGHTS.items()])
    tokens = docs.select(key, F.explode(parts).alias("p")).select(key, "p.weight", F.explode("p.tokens").alias("token"))
    return tokens.groupBy(key, "token").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))
