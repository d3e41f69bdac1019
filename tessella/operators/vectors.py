"""Vector metrics, exact top-k for many queries, filters and checks (VEC)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """VEC2"""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    """VEC2"""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """VEC1: 0 on unequal lengths or a zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def metadata_filter(spec: dict) -> Column:
    """VEC4, VEC5: {field: value | [any of] | {"$eq", "$in", "gte", "lte", "gt", "lt"}}, all of them; {"$or": [specs]}."""
    tests = []
    for key, value in spec.items():
        if key == "$or":
            tests.append(reduce(lambda a, b: a | b, [metadata_filter(s) for s in value]))
        elif isinstance(value, list):
            tests.append(F.col(key).isin(*value))
        elif isinstance(value, dict):
            for op, x in value.items():
                c = F.col(key)
                tests.append({"$eq": lambda: c == x, "$in": lambda: c.isin(*x), "gte": lambda: c >= x, "lte": lambda: c <= x, "gt": lambda: c > x, "lt": lambda: c < x}[op]())
        else:
            tests.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


class Match(NamedTuple):
    """Which vectors a query may see: ``test`` gets the query columns as (queries, 1) and the vector columns as (1, vectors) arrays."""

    query: tuple[str, ...]
    vector: tuple[str, ...]
    test: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


#: Scores that a task works out at a time, queries times vectors, and those of which it finds the best at a time.
SCORES, SOME = 4 << 20, 1 << 18


class _Best:
    """The best ``k`` of each query so far, as flat arrays; ties by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.floor = k, np.full(n, -np.inf)
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        n = score.shape[1]
        least = self.floor
        if n > self.k:  # by some queries at a time, as a partition is a copy that a view of it keeps
            rows = max(1, SOME // n)
            least = np.maximum(least, np.concatenate([np.partition(score[lo : lo + rows], n - self.k, axis=1)[:, n - self.k].copy() for lo in range(0, len(score), rows)]))
        among = score >= least[:, None]
        among &= score > -np.inf
        q, at = np.nonzero(among)
        if not len(q):
            return
        q, own, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids[at]]), np.concatenate([self.score, score[q, at]])
        order = np.lexsort((own, -score, q))
        q, own, score = q[order], own[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = place < self.k
        self.q, self.id, self.score = q[keep], own[keep], score[keep]
        full = place == self.k - 1
        self.floor[q[full]] = score[full]


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, where: Column | None = None, match: Match | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """VEC3: (query_id, vec_id, score, rank), the ``k`` best by cosine for each (query_id, embedding) query; ties by id.

    Queries are taken in blocks of ``block_bytes``, the only thing broadcast; each task holds its best k of every query of the
    block and gives them out at its end, so what is shuffled is bounded by tasks times k, and never the vectors. The cosine of unequal
    lengths or a zero vector is 0; a null vector is no hit.
    """
    spark = queries.sparkSession
    base = vectors if where is None else vectors.where(where)
    asked, told = (match.query, match.vector) if match else ((), ())
    out = "query_id long, vec_id long, score double"

    def search(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        sizes = np.array([len(r[1] or ()) for r in rows])
        unit = {}
        for d in set(sizes.tolist()) - {0}:
            m = np.array([rows[i][1] for i in np.flatnonzero(sizes == d)], np.float64)
            unit[d] = np.flatnonzero(sizes == d), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        held = spark.sparkContext.broadcast((ids, unit, [np.array([r[2 + i] for r in rows], object)[:, None] for i in range(len(asked))]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit, own = held.value
            best = _Best(len(ids), k)
            # the matrix of scores has SCORES numbers at most
            step = max(1, min(2_048, SCORES // len(ids)))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    column, score = part.column(1), None
                    size = pc.list_value_length(column).to_numpy()
                    for d, (places, m) in unit.items():
                        at = np.flatnonzero(size == d)
                        if len(at):
                            v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
                            norm = np.linalg.norm(v, axis=1, keepdims=True)
                            made = m @ np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).T
                            if made.shape == (len(ids), part.num_rows):  # all have one length: no second matrix
                                score = made
                            else:
                                score = np.zeros((len(ids), part.num_rows)) if score is None else score
                                score[np.ix_(places, at)] = made
                    score = np.zeros((len(ids), part.num_rows)) if score is None else score
                    # matrix products may differ in the last bits for equal vectors, which are ties
                    np.round(np.nan_to_num(score, copy=False, nan=0.0), 12, out=score)
                    if match:
                        others = [part.column(2 + i).to_numpy(zero_copy_only=False).astype(object)[None, :] for i in range(len(told))]
                        score = np.where(match.test(own, others).astype(bool), score, -np.inf)
                    best.add(score, part.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.q], pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.score, pa.float64())], names=["query_id", "vec_id", "score"])

        return base.where(F.col("embedding").isNotNull()).select("vec_id", "embedding", *told).mapInArrow(run, out)

    found, rows, size = [], [], 0
    for row in queries.select("query_id", "embedding", *asked).toLocalIterator():
        rows.append(row)
        size += 8 * len(row[1] or ()) + 64
        if size >= block_bytes:
            found.append(search(rows))
            rows, size = [], 0
    if rows:
        found.append(search(rows))
    hits = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], out)
    if threshold is not None:
        hits = hits.where(F.col("score") >= threshold)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def collection_info(vectors: DataFrame, by: str) -> DataFrame:
    """VEC7: count and dimension of each collection."""
    return vectors.groupBy(by).agg(F.count("*").alias("points"), F.max(F.size("embedding")).alias("dimension"))


def validate_vectors(vectors: DataFrame, by: str | None = None, most: int = 65536) -> DataFrame:
    """VEC8: (vec_id, dimension, error) of rows whose vector is null, empty or too long, or not of its collection's usual dimension.

    The usual dimension is the most frequent one of the column ``by``, the smallest of equals; without ``by`` it isn't asked.
    """
    n = F.coalesce(F.size("embedding"), F.lit(-1))
    rows = vectors.select("vec_id", n.alias("dimension"), *([F.col(by).alias("_by")] if by else []))
    bad = F.when(F.col("dimension") < 1, "empty vector").when(F.col("dimension") > most, "too many dimensions")
    if not by:
        return rows.withColumn("error", bad).where("error is not null")
    counts = rows.where("dimension > 0").groupBy("_by", "dimension").agg(F.count("*").alias("n"))
    usual = counts.groupBy("_by").agg(F.max_by("dimension", F.struct("n", -F.col("dimension"))).alias("_usual"))
    joined = rows.join(usual, rows["_by"].eqNullSafe(usual["_by"]), "left").select("vec_id", "dimension", "_usual")
    return joined.select("vec_id", "dimension", F.coalesce(bad, F.when(F.col("dimension") != F.col("_usual"), "other dimension")).alias("error")).where("error is not null")


def valid_name(name: Column) -> Column:
    """VEC8: whether a collection's name has letters, digits, underscores and hyphens only, and not none."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_-]+$"), F.lit(False))
