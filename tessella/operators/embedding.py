"""Vectors from text without a remote model (VEC9): signed feature hashing, inverse document frequency, a seeded random projection.

A token is hashed to one of a fixed number of buckets and to a sign; a text is the sparse vector of its tokens' signs, each times its
bucket's inverse document frequency; a matrix of random signs, drawn for each bucket from the seed, takes that to the fixed
dimension. The model is a table with a row for each bucket, so its size depends on its parameters alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import WORD

#: Vectors are rounded to so many digits, so the order in which a sum was taken can't be seen in them.
DIGITS = 6
#: Signs of the projection that one number of the model holds.
BITS = 32


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def _number(digest: Column, at: int, n: int) -> Column:
    """``n`` hexadecimal digits of a digest as a number."""
    return F.conv(F.substr(digest, F.lit(at), F.lit(n)), 16, 10).cast("long")


def bucket(token: Column, buckets: int) -> Column:
    return (_number(F.md5(token), 1, 8) % buckets).cast("int")


def plus(token: Column) -> Column:
    return _number(F.md5(token), 9, 1) >= 8


def fit_embedder(docs: DataFrame, dim: int = 64, buckets: int = 1 << 16, seed: int = 7, text_col: str = "text") -> DataFrame:
    """The model: (bucket, idf, signs, dim, buckets), a row for each bucket whether it was met or not; write it as Parquet to use it later.

    idf is ln((documents + 1) / (n + 1)) + 1, where n counts each of a document's distinct tokens in the bucket. Counts are of all
    documents and combined before the shuffle, which carries at most ``buckets`` rows a task. ``signs`` has the bucket's row of
    the projection, BITS to a number.
    """
    met = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token")).groupBy(bucket(F.col("token"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("docs"))
    words = [_number(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("bucket").cast("string"), F.lit(str(k)))), 1, BITS // 4) for k in range(-(-dim // BITS))]
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(met, "bucket", "left")
    rows = every.select("bucket", F.log((total.scalar() + 1.0) / (F.coalesce("n", F.lit(0)) + 1.0)).alias("log"), F.array(*words).alias("signs"))
    return rows.select("bucket", (F.col("log") + 1.0).alias("idf"), "signs", F.lit(dim).alias("dim"), F.lit(buckets).alias("buckets"))


def embed(texts: DataFrame, model: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """VEC9: (key, embedding): each text's vector of length 1, as doubles; null for a text without tokens, or whose tokens cancel out.

    ``key`` names the rows: texts of one key are embedded as one. The model is broadcast (its size is that of its buckets), sums
    are taken where texts are read, and the one shuffle has a row of ``dim`` numbers for each key.
    """
    dim, buckets, n_words = model.select("dim", "buckets", F.size("signs")).first()
    held = F.broadcast(model.select(F.col("bucket").alias("_b"), F.col("idf").alias("_idf"), *[F.col("signs")[k].alias(f"_s{k}") for k in range(n_words)]))
    each = texts.select(F.col(key).alias("_key"), F.explode_outer(tokens(F.col(text_col))).alias("_t"))
    each = each.select("_key", bucket(F.col("_t"), buckets).alias("_b"), plus(F.col("_t")).alias("_plus"))
    weighed = each.join(held, "_b", "left").select("_key", F.when(F.col("_plus"), F.col("_idf")).otherwise(-F.col("_idf")).alias("_w"), *[f"_s{k}" for k in range(n_words)])
    up = lambda j: F.getbit(F.col(f"_s{j // BITS}"), F.lit(j % BITS)) == 1
    sums = weighed.groupBy("_key").agg(*[F.sum(F.when(up(j), F.col("_w")).otherwise(-F.col("_w"))).alias(f"_v{j}") for j in range(dim)])
    size = F.sqrt(sum((F.col(f"_v{j}") * F.col(f"_v{j}") for j in range(dim)), F.lit(0.0)))
    vector = F.array(*[F.round(F.col(f"_v{j}") / F.col("_size"), DIGITS) for j in range(dim)])
    return sums.withColumn("_size", size).select(F.col("_key").alias(key), F.when(F.col("_size") > 1e-9, vector).alias("embedding"))
