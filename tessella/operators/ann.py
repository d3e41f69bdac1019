"""Approximate search by a persisted inverted file (VEC6): cells in folders of their own, residual codes for a first ranking.

The table is partitioned by cell, so a search reads the folders of its cells alone. Of these it first reads ids and codes (four
bits a component), then the vectors of the cells where candidates are. The nearest cells of a query tell how near its neighbours are; a
further cell is left out when nothing within its radius can be as near. On vectors that lie in clusters few cells are left,
on vectors without any structure all are, and the codes do the pruning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import settled

LEVELS = 16
ROWS = "vec_id long, angle float, code binary, v array<float>, cell int"


class AnnIndex(NamedTuple):
    """``rows``: (vec_id, angle, code, v, cell), partitioned by cell; ``cells``: (cell, centre, radius, n); ``scale``: where each component's codes begin, and their step."""

    rows: DataFrame
    cells: DataFrame
    scale: DataFrame


def unit_vectors(df: DataFrame, key: str) -> DataFrame:
    """(key, v): vectors of length 1; null and zero ones, and those with a component that is null or no number, are left out."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    fine = df.where(F.col("embedding").isNotNull()).withColumn("_norm", norm).where("_norm > 0 AND _norm < double('infinity')")
    return fine.select(key, F.transform("embedding", lambda x: x.cast("double") / F.col("_norm")).alias("v"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def build_ann_index(vectors: DataFrame, path: str, cells: int | None = None, sample_rows: int = 100_000, radius: float = 0.95, seed: int = 7) -> AnnIndex:
    """Write the index of (vec_id, embedding) below ``path`` and open it. All vectors have one length.

    There are as many cells as the square root of the rows, unless told, and at most a tenth of ``sample_rows``. Their centres and
    the codes' scale are learnt from about ``sample_rows`` vectors drawn by hash, the bound of the training sample;
    every vector is indexed. A cell's radius holds the share ``radius`` of its vectors. Rows are dealt by cell with a rebalance, which
    splits a large cell into several files and puts small ones together. The sample's statistics come to the driver, nothing else.
    """
    spark = vectors.sparkSession
    points = unit_vectors(vectors, "vec_id")
    n = points.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit("cells")), F.lit(1 << 30)) / float(1 << 30)
    sample = points.where(draw <= min(1.0, sample_rows / max(1, n)))
    k = max(1, min(cells or round(n**0.5), sample_rows // 10))
    if n:
        model = KMeans(k=min(k, n), seed=seed, maxIter=10).fit(sample.select(array_to_vector("v").alias("features")))
        centres = np.array(model.clusterCenters())
    else:
        centres = np.zeros((0, 0))

    def nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(axis=1)[None, :] - 2 * m @ centres.T).argmin(axis=1)

    held = spark.sparkContext.broadcast(centres)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0), batch.num_rows)
                left = m - held.value[nearest(m, held.value)]
                rows = pa.array([left.min(axis=0), left.max(axis=0)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(["low", "high"]), rows], names=["side", "v"])

    ends = sample.select("v").mapInArrow(spans, "side string, v array<double>").select("side", F.posexplode("v").alias("j", "x"))
    scale = ends.groupBy("j").agg(F.min("x").alias("low"), ((F.max("x") - F.min("x")) / LEVELS).alias("step"))
    scale.coalesce(1).write.mode("overwrite").parquet(f"{path}/scale")
    learnt = spark.read.parquet(f"{path}/scale").orderBy("j").collect()  # a row for each component
    low, step = np.array([r.low for r in learnt]), np.maximum(np.array([r.step for r in learnt]), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1), batch.num_rows)
                cell = nearest(m, centres)
                own = centres[cell]
                level = np.clip((m - own - low) / step, 0, LEVELS - 1).astype(np.uint8)
                if level.shape[1] % 2:
                    level = np.column_stack([level, np.zeros(len(level), np.uint8)])
                code = level[:, ::2] << 4 | level[:, 1::2]
                cosine = (m * own).sum(axis=1) / np.maximum(np.linalg.norm(own, axis=1), 1e-12)
                codes = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * code.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(code.tobytes())])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)), codes, lists, pa.array(cell.astype(np.int32))], names=["vec_id", "angle", "code", "v", "cell"])

    points.mapInArrow(run, ROWS).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    placed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes = rows.groupBy("cell").agg(F.percentile_approx("angle", radius).cast("double").alias("radius"), F.count("*").alias("n"))
    placed.join(sizes, "cell").write.mode("overwrite").parquet(f"{path}/cells")
    return open_ann_index(spark, path)


def open_ann_index(spark: SparkSession, path: str) -> AnnIndex:
    """The index that ``build_ann_index`` wrote below ``path``."""
    cells = spark.read.schema("cell int, centre array<double>, radius double, n long").parquet(f"{path}/cells")
    return AnnIndex(spark.read.schema(ROWS).parquet(f"{path}/rows"), cells, spark.read.schema("j int, low double, step double").parquet(f"{path}/scale"))


def angles(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(queries @ (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).T, -1, 1))


class _Candidates:
    """The ``most`` candidates of each query with the highest estimates so far: query, vector, cell, estimate."""

    def __init__(self, n: int, most: int) -> None:
        self.most, self.floor = most, np.full(n, -np.inf)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def add(self, who: np.ndarray, ids: np.ndarray, cell: int, score: np.ndarray) -> None:
        q, at = np.nonzero(score > self.floor[who][:, None])
        new = who[q], ids[at], np.full(len(q), cell), score[q, at]
        q, own, cells, score = (np.concatenate([x, y]) for x, y in zip(self.rows, new))
        order = np.lexsort((own, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = place < self.most
        self.rows = [x[order][keep] for x in (own, cells, score)]
        self.rows.insert(0, q[keep])
        full = place == self.most - 1
        self.floor[q[full]] = score[order][full]


def search_ann(index: AnnIndex, queries: DataFrame, k: int, refine: int = 8, nearest: int = 2, slack: float = 0.02, block_bytes: int = 32 << 20) -> DataFrame:
    """VEC6: (query_id, vec_id, score, rank): about the ``k`` best by cosine for each (query_id, embedding), ties by id; null and zero queries have none.

    Queries are taken in blocks of ``block_bytes``, which are broadcast. A block reads ids and codes of each query's ``nearest`` cells, then
    those of the cells that may hold something nearer than the k-th best so far. It keeps ``refine`` times ``k`` candidates
    of each query, in each task and then overall, and scores these by the vectors, in single precision, of the cells that have any.
    The cells' centres, as many as the square root of the rows, come to the driver.
    """
    spark = index.rows.sparkSession
    known = index.cells.orderBy("cell").collect()
    out = "query_id long, vec_id long, score double"
    if not known:
        return spark.createDataFrame([], f"{out}, rank int")
    cells = np.array([r.cell for r in known])
    centres, radius = np.array([r.centre for r in known]), np.array([r.radius for r in known])
    learnt = index.scale.orderBy("j").collect()
    low, step = np.array([r.low for r in learnt]), np.array([r.step for r in learnt])
    place = {int(c): j for j, c in enumerate(cells)}
    most, by_score = refine * k, Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    def search(rows: list) -> DataFrame:
        ids, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        held = spark.sparkContext.broadcast((ids, q, q @ centres.T))
        far = angles(q, centres)
        asked = np.zeros(far.shape, bool)
        np.put_along_axis(asked, np.argpartition(far, min(nearest, len(cells)) - 1, axis=1)[:, :nearest], True, axis=1)
        near = settled(best(held, asked))
        kth = near.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") == k).select("q", "score").collect()
        bound = np.full(len(q), np.pi)
        for r in kth:  # a row for each query of the block
            bound[r.q] = np.arccos(np.clip(r.score - slack, -1, 1))
        more = (far - radius <= bound[:, None]) & ~asked
        both = near.unionByName(best(held, more)) if more.any() else near
        chosen = settled(both.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= most).select("q", "vec_id", F.col("cell").cast("int").alias("cell")))
        holding = [r.cell for r in chosen.select("cell").distinct().collect()]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, _ = held.value
            for batch in batches:
                if batch.num_rows:
                    who, v = batch.column(0).to_numpy(), _matrix(batch.column(2), batch.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who]), batch.column(1), pa.array(np.round((q[who] * v).sum(axis=1) / np.linalg.norm(v, axis=1), 12))], names=["query_id", "vec_id", "score"])

        vectors = index.rows.where(F.col("cell").isin(holding)).select("cell", "vec_id", "v")
        return chosen.join(vectors, ["cell", "vec_id"]).select("q", "vec_id", "v").mapInArrow(score, out)

    def best(held, asked: np.ndarray) -> DataFrame:
        """(q, vec_id, cell, score): each task's candidates by their codes, from the cells that each query asks for."""
        told = spark.sparkContext.broadcast(asked)

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (_, q, base), asked = held.value, told.value
            best, scaled, begin = _Candidates(len(q), most), q * step, q @ (low + step / 2)
            for batch in batches:
                vec, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(vec), -1)
                level = np.empty((len(vec), 2 * code.shape[1]))
                level[:, ::2], level[:, 1::2] = code >> 4, code & 15
                for c in np.unique(cell).tolist():
                    own, who = np.flatnonzero(cell == c), np.flatnonzero(asked[:, place[c]])
                    for lo in range(0, len(who), 1_024):
                        for at in range(0, len(own), 1_024):
                            some, part = who[lo : lo + 1_024], own[at : at + 1_024]
                            best.add(some, vec[part], c, scaled[some] @ level[part, : len(step)].T + (base[some, place[c]] + begin[some])[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows], names=["q", "vec_id", "cell", "score"])

        wanted = cells[asked.any(axis=0)].tolist()
        return index.rows.where(F.col("cell").isin(wanted)).select("vec_id", "code", "cell").mapInArrow(estimate, "q long, vec_id long, cell long, score double")

    found, rows, size = [], [], 0
    for row in unit_vectors(queries, "query_id").toLocalIterator():
        rows.append(row)
        size += 16 * len(row[1]) + 8 * len(cells)
        if size >= block_bytes:
            found.append(search(rows))
            rows, size = [], 0
    if rows:
        found.append(search(rows))
    hits = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
