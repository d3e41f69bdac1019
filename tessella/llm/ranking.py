"""Ranked lexical search: an index of shards in compressed blocks with their greatest impacts, searched by Block-Max MaxScore.

A document's impact for a term doesn't depend on the term's weight, so lists and blocks keep their greatest impact, and a query
multiplies it by the weight. For each item and shard the sum of the smallest lists' bounds that stays under the tenth best score so far
names the lists that alone make no hit; only documents of the other, essential lists are candidates. A candidate whose
score so far and the greatest impacts of the blocks that could hold it don't reach that score goes before those blocks are decompressed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import materialize

BLOCK = 128
#: A shard is closed when it has so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 50_000
#: Lists of a shard, one a row; the row without a term has the shard's documents and what their lengths add to a score's divisor.
LISTS = "shard long, term long, df int, peak long, tenth long, last array<int>, peaks array<long>, at array<int>, data binary, ids array<long>, lengths array<long>"
TOP = 10


def _terms(part: W.Slice) -> W.Words:
    return W.words(part.data, part.bounds, W.symbol_separators(), W.letters(lower=True))


def _each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, W.Words]]:
    """(ids, terms) of slices of the (id, text) rows."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for part in W.slices(batch.column(1)):
            yield ids[part.lo : part.hi], _terms(part)


def _counted(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, how often) of each distinct term of each row, by row."""
    terms, number = np.unique(w.hash, return_inverse=True)
    key, times = np.unique(w.doc * max(1, len(terms)) + number, return_counts=True)
    row, number = np.divmod(key, max(1, len(terms)))
    return row, terms[number], times


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 in seven bits a byte, the low ones first and the top bit set on all but the last; and the bytes of each."""
    size = 1 + sum((values >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[begin[own] + k] = (values[own] >> (7 * k) & 0x7F) | np.where(size[own] > k + 1, 0x80, 0)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    stop = np.flatnonzero(data < 0x80)
    begin = np.append(0, stop[:-1] + 1) if len(stop) else stop
    size, out = stop - begin + 1, np.zeros(len(stop), np.int64)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[own] |= (data[begin[own] + k] & 0x7F).astype(np.int64) << (7 * k)
    return out


def impact(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 8 * length)


class Stats(NamedTuple):
    """Of the whole table: documents with a term, and all their terms."""

    docs: int
    terms: int

    def length(self, n: np.ndarray) -> np.ndarray:
        return 25 + 75 * n * self.docs // max(1, self.terms)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def corpus_stats(docs: DataFrame) -> Stats:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = every = 0
        for _, w in _each_slice(batches):
            n = np.diff(w.first)
            some, every = some + int((n > 0).sum()), every + int(n.sum())
        yield pa.RecordBatch.from_pydict({"docs": [some], "terms": [every]})

    found = docs.mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return Stats(found[0] or 0, found[1] or 0)


def _shard(name: int, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, stats: Stats) -> Iterator[pa.RecordBatch]:
    """The rows of one shard from its postings in the order of documents."""
    order = np.argsort(term, kind="stable")
    doc, term, tf, length = doc[order], term[order], tf[order], stats.length(n)
    score = impact(tf, length[doc])
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    df = np.diff(np.append(begin, len(term)))
    # blocks: where a list begins, and every BLOCK postings after
    blocks = -(-df // BLOCK)
    first = np.repeat(begin, blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    final = np.append(first[1:], len(term)) - 1
    gap = doc.copy()
    gap[1:] -= doc[:-1]
    gap[begin] = doc[begin]  # from one block to the next of a list, gaps go on
    data, size = packed(np.column_stack([gap, tf]).ravel())
    byte = np.append(0, np.cumsum(size))[::2]  # where each posting's bytes begin; the last is the end of all
    tenth = np.zeros(len(begin), np.int64)
    long = np.flatnonzero(df >= TOP)
    if len(long):
        best = np.lexsort((-score, np.repeat(np.arange(len(begin)), df)))
        tenth[long] = score[best[begin[long] + TOP - 1]]
    # each list's blocks, and one offset more than blocks, from where the list's bytes begin
    stops = byte[final + 1] - np.repeat(byte[begin], blocks)
    at = np.zeros(len(first) + len(begin), np.int64)
    at[np.arange(len(first)) + np.repeat(np.arange(len(begin)), blocks) + 1] = stops
    sums, kinds, raw = np.append(0, np.cumsum(blocks)), (pa.int32(), pa.int64()), data.tobytes()
    peaks = np.maximum.reduceat(score, first) if len(first) else first
    peak = np.maximum.reduceat(score, begin) if len(begin) else begin
    names = ["shard", "term", "df", "peak", "tenth", "last", "peaks", "at", "data", "ids", "lengths"]
    none = pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), none[0], none[1], none[0], pa.nulls(1, pa.binary()), W.lists(ids, np.array([len(ids)]), pa.int64()), W.lists(length, np.array([len(ids)]), pa.int64())], names=names)
    for lo in range(0, len(begin), 20_000):
        hi = min(lo + 20_000, len(begin))
        a, b = sums[lo], sums[hi]
        edge = np.append(byte[begin[lo:hi]], byte[begin[hi]] if hi < len(begin) else byte[-1])
        blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((edge - edge[0]).astype(np.int32).tobytes()), pa.py_buffer(raw[edge[0] : edge[-1]])])
        own = blocks[lo:hi]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(hi - lo, name)), pa.array(W.longs(term[begin[lo:hi]])), pa.array(df[lo:hi].astype(np.int32)), pa.array(peak[lo:hi]), pa.array(tenth[lo:hi]),
            W.lists(doc[final[a:b]].astype(np.int32), own, kinds[0]), W.lists(peaks[a:b], own, kinds[1]), W.lists(at[a + lo : b + hi].astype(np.int32), own + 1, kinds[0]), blob,
            pa.nulls(hi - lo, pa.list_(pa.int64())), pa.nulls(hi - lo, pa.list_(pa.int64())),
        ], names=names)


class SearchIndex(NamedTuple):
    lists: DataFrame
    stats: Stats


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> SearchIndex:
    """The search index of whole texts, written to the shared folder: every term of every document, shard by shard where the documents are read, without a shuffle.

    Terms are runs of anything but ASCII other than letters and digits, A-Z lower-cased, known by 64 bits of hash. A null text has none; rows
    without an id are left out; a repeated row is one more document. Other columns are not read.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stats = corpus_stats(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        docs = postings = shards = 0

        def close() -> Iterator[pa.RecordBatch]:
            name = TaskContext.get().partitionId() << 32 | shards
            yield from _shard(name, *(np.concatenate(x) for x in zip(*held)), stats)

        for ids, w in _each_slice(batches):
            if held and (postings + len(w.hash) > SHARD_POSTINGS or docs + len(ids) > SHARD_DOCS):
                yield from close()
                held, docs, postings, shards = [], 0, 0, shards + 1
            row, term, tf = _counted(w)
            held.append((ids, np.diff(w.first), docs + row, term, tf))
            docs, postings = docs + len(ids), postings + len(row)
        if held:
            yield from close()

    return SearchIndex(materialize(own.mapInArrow(run, LISTS)), stats)


class Shard:
    """One shard's lists of the wanted terms, and how many blocks were there and were decompressed."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, lists: dict[int, tuple]) -> None:
        self.ids, self.lengths, self.lists = ids, lengths, lists
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.read: dict[int, set[int]] = {}

    def blocks(self, term: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a list, or of those of its blocks that are wanted."""
        if term in self.whole:
            return self.whole[term]
        _, _, last, _, at, data = self.lists[term]
        places = np.arange(len(last)) if wanted is None else wanted
        self.read.setdefault(term, set()).update(places.tolist())
        if wanted is None:
            values = unpacked(np.frombuffer(data, np.uint8))
            doc, tf = np.cumsum(values[::2]), values[1::2]
        else:
            parts = [unpacked(np.frombuffer(data[at[p] : at[p + 1]], np.uint8)) for p in places.tolist()]
            doc = np.concatenate([np.cumsum(x[::2]) + (last[p - 1] if p else 0) for p, x in zip(places.tolist(), parts)])
            tf = np.concatenate([x[1::2] for x in parts])
        found = doc, impact(tf, self.lengths[doc])
        if wanted is None:
            self.whole[term] = found
        return found

    def search(self, terms: list[int], factors: list[int], floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at most TOP documents with scores above 0 and not under ``floor``; equal scores by id."""
        own = [(f * self.lists[t][0], t, f) for t, f in zip(terms, factors) if t in self.lists and f > 0]
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not own:
            return none
        own.sort()
        floor = max(floor, 1, max(f * self.lists[t][1] for _, t, f in own))
        sums = np.cumsum([bound for bound, _, _ in own])
        rest = int(np.searchsorted(sums, floor, "left"))  # these lists' bounds together stay under the floor
        if rest == len(own):
            return none
        score = np.zeros(len(self.ids), np.int64)
        for _, t, f in own[rest:]:
            doc, value = self.blocks(t)
            score[doc] += f * value
        left = np.flatnonzero(score)
        now = score[left]
        under = int(sums[rest - 1]) if rest else 0
        left, now, floor = self._reach(left, now, now + under, floor)
        # what the blocks that could hold a candidate add to its score at most
        most, place = np.zeros((rest, len(left)), np.int64), np.zeros((rest, len(left)), np.int64)
        for k, (_, t, f) in enumerate(own[:rest]):
            last, peaks = self.lists[t][2], self.lists[t][3]
            place[k] = np.searchsorted(last, left)
            most[k] = f * np.append(peaks, 0)[place[k]]
        for k in range(rest - 1, -1, -1):
            keep = now + most[: k + 1].sum(axis=0) >= floor
            left, now, most, place = left[keep], now[keep], most[:, keep], place[:, keep]
            _, t, f = own[k]
            at = np.flatnonzero(place[k] < len(self.lists[t][2]))
            if len(at):
                doc, value = self.blocks(t, np.unique(place[k][at]))
                found = np.minimum(np.searchsorted(doc, left[at]), len(doc) - 1)
                now[at] += np.where(doc[found] == left[at], f * value[found], 0)
            if len(now) > TOP:
                floor = max(floor, int(np.partition(now, len(now) - TOP)[len(now) - TOP]))
        left, now, _ = self._reach(left, now, now, floor)
        order = np.lexsort((self.ids[left], -now))[:TOP]
        return self.ids[left[order]], now[order]

    @staticmethod
    def _reach(left: np.ndarray, now: np.ndarray, bound: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Candidates whose bound reaches the floor, which the tenth best score so far may raise."""
        if len(now) > TOP:
            floor = max(floor, int(np.partition(now, len(now) - TOP)[len(now) - TOP]))
        keep = bound >= floor
        return left[keep], now[keep], floor


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards from rows sorted by shard."""
    name, lists, ids, lengths = None, {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for shard, term, peak, tenth, last, peaks, at, data, own, length in zip(*(batch.column(c) for c in ("shard", "term", "peak", "tenth", "last", "peaks", "at", "data", "ids", "lengths"))):
            if shard.as_py() != name:
                if lists:
                    yield Shard(ids, lengths, lists)
                name, lists = shard.as_py(), {}
            if term.is_valid:
                lists[term.as_py()] = peak.as_py(), tenth.as_py(), last.values.to_numpy(), peaks.values.to_numpy(), at.values.to_numpy(), data.as_buffer()
            else:
                ids, lengths = own.values.to_numpy(), length.values.to_numpy()
    if lists:
        yield Shard(ids, lengths, lists)


def _search_block(index: SearchIndex, items: dict[int, dict[int, int]]) -> DataFrame:
    """(item_id, doc_id, score): the best of each task's shards for the items of one block."""
    spark = index.lists.sparkSession
    terms = {t for own in items.values() for t in own}
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term long"))
    counts = index.lists.select("term", "df").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weights = {r.term: index.stats.weight(r.df) for r in counts.toLocalIterator()}
    asked = {i: (list(own), [weights.get(t, 0) * n for t, n in own.items()]) for i, own in items.items()}
    held = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for shard in _shards(batches):
            for item, (terms, factors) in held.value.items():
                ids, scores = best.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                new, own = shard.search(terms, factors, int(scores[-1]) if len(scores) == TOP else 0)
                if len(new):
                    ids, scores = np.concatenate([ids, new]), np.concatenate([scores, own])
                    order = np.lexsort((ids, -scores))[:TOP]
                    best[item] = ids[order], scores[order]
        for item, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], names=["item_id", "doc_id", "score"])

    rows = index.lists.where("term is null").unionByName(index.lists.where("term is not null").join(wanted, "term", "left_semi"))
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: SearchIndex, items: DataFrame, *, block_terms: int = 500_000, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the TOP documents with the highest scores above 0, equal ones by ascending doc_id.

    Items are taken in blocks of about ``block_terms`` terms, which is what is broadcast at a time; each block reads the
    lists of its terms once and a task keeps the best of all its shards, so what is merged is bounded by tasks times TOP. Rows of one
    item_id are one item; items without an id are left out; those without terms, or none that a document has, give no rows.
    """
    own = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in _each_slice(batches):
            row, term, times = _counted(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(W.longs(term)), pa.array(times)], names=["id", "term", "n"])

    asked = own.mapInArrow(run, "id long, term long, n long").groupBy("id", "term").agg(F.sum("n").alias("n"))
    asked = asked.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("terms"))
    found, block, size = [], {}, 0
    for row in asked.toLocalIterator():
        block[row.id] = row.terms
        size += len(row.terms)
        if size >= block_terms:
            found.append(_search_block(index, block))
            block, size = {}, 0
    if block:
        found.append(_search_block(index, block))
    hits = reduce(DataFrame.unionByName, found) if found else items.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")
