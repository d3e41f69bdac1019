"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

HITS = "doc_id long, item_id long, score double, start_word long, end_word long, matched long"


class Seeds(NamedTuple):
    items: list[tuple[int, np.ndarray]]  # item id, word hashes
    hash: np.ndarray  # sorted; of the n-gram
    item: np.ndarray  # place in items
    offset: np.ndarray  # of the seed in the item
    sizes: list[int]  # the n that occur


def token_hashes(texts: list[str]) -> list[np.ndarray]:
    column = pc.utf8_lower(pa.array(texts, pa.large_string()))
    out = []
    for part in W.slices(column):
        w = W.words(part.data, part.bounds, W.symbol_separators(), W.LETTERS)
        out += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    return out


def align(a: np.ndarray, b: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score of ``a`` in ``b``, and the words of ``b`` from and to which it reaches."""
    n = len(b)
    steps = np.arange(n + 1) * gap
    above, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, first, last = 0, 0, 0
    for word in a:
        diagonal = above[:-1] + np.where(b == word, match, miss)
        down = above[1:] + gap
        cell, came = np.zeros(n + 1, np.int64), np.arange(n + 1)
        cell[1:] = np.maximum(np.maximum(diagonal, down), 0)
        came[1:] = np.where(cell[1:] == 0, came[1:], np.where(diagonal >= down, origin[:-1], origin[1:]))
        # a run of gaps along b: the best cell to the left, less what the way costs
        lifted = cell - steps
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, np.arange(n + 1), 0))
        cell, came = run + steps, came[source]
        k = int(cell.argmax())
        if cell[k] > best:
            best, first, last = int(cell[k]), int(came[k]), k
        above, origin = cell, came
    return best, first, last


def word_rates(docs: DataFrame, wanted: np.ndarray, text_col: str) -> np.ndarray:
    """Share of all words of the corpus, of each of the benchmark's ``wanted`` words (sorted); counted over every document."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(len(held.value), np.int64)
        for batch in batches:
            for part in W.slices(pc.utf8_lower(batch.column(0))):
                h = W.words(part.data, part.bounds, W.symbol_separators(), W.LETTERS).hash
                at = np.minimum(np.searchsorted(held.value, h), len(held.value) - 1)
                seen += np.bincount(at[held.value[at] == h], minlength=len(held.value))
                total += len(h)
        keep = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"place": np.append(keep, -1), "n": np.append(seen[keep], total)})

    rows = docs.select(text_col).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n")).collect()
    counts = {r[0]: r[1] for r in rows}
    total = max(1, counts.get(-1, 0))
    return np.array([counts.get(i, 0) / total for i in range(len(wanted))])


def benchmark_words(items: DataFrame) -> np.ndarray:
    """Sorted hashes of the distinct words of (item_id, text), a few bytes for each word of the benchmark's vocabulary."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(h) for h in token_hashes(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_pydict({"h": W.longs(np.unique(np.concatenate([np.zeros(0, np.uint64), *found])))})

    return np.sort(items.select("text").mapInArrow(distinct, "h long").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def seeds(items: list[tuple[int, np.ndarray]], wanted: np.ndarray, rates: np.ndarray, n: int, rare: float, rare_pair: float, least: int) -> Seeds:
    """The items' n-grams (whole items, if shorter) whose words together are expected at a rate below ``rare``.

    The rarer half of an item's n-grams, and ``least`` of them, are seeds in any case, so that none is out of reach. So are
    pairs of words below ``rare_pair`` and the rarer third of them, which closer edits leave.
    """
    found = []
    for k, (_, h) in enumerate(items):
        if not len(h):
            continue
        size = min(n, len(h))
        # a word that no document has is in no seed
        rate = rates[np.searchsorted(wanted, h)]
        log = np.where(rate > 0, np.log(np.maximum(rate, 1e-300)), np.inf)
        for n_words, below, part in ((size, rare, 2), (2, rare_pair, 3))[: 1 + (size > 2)]:
            chance = np.sum([log[i : len(log) - n_words + 1 + i] for i in range(n_words)], axis=0)
            able = np.argsort(chance, kind="stable")[: np.isfinite(chance).sum()]
            own = able[: max(least, len(able) // part, int((chance < np.log(below)).sum()))]
            g = W.grams(h, n_words)
            found += [(int(g[i]), k, int(i), n_words) for i in own]
    found.sort()
    columns = list(zip(*found)) or [(), (), (), ()]
    return Seeds(items, np.array(columns[0], np.uint64), np.array(columns[1], np.int64), np.array(columns[2], np.int64), sorted(set(columns[3])))


def hits(part: W.Slice, own: Seeds, min_score: float, memory: dict) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item, score, first and last word, matched score) of each passage of the slice that aligns with an item."""
    w = W.words(part.data, part.bounds, W.symbol_separators(), W.LETTERS)
    at, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in own.sizes:
        g = W.grams(w.hash, n)
        low, high = np.searchsorted(own.hash, g, "left"), np.searchsorted(own.hash, g, "right")
        low, high = np.where(W.within(w.doc, n), low, 0), np.where(W.within(w.doc, n), high, 0)
        each = high - low
        at.append(np.repeat(np.arange(len(g)), each))
        seed.append(np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum()))
    at, seed = np.concatenate(at), np.concatenate(seed)
    if not len(at):
        return
    row, item = w.doc[at], own.item[seed]
    begin = at - own.offset[seed]
    size = np.array([len(h) for _, h in own.items])[item]
    order = np.lexsort((begin, item, row))
    row, item, begin, size = row[order], item[order], begin[order], size[order]
    # an alignment of this score has at most so many gaps, so none reaches further
    margin = np.ceil(2 * size * (1 - min_score)).astype(np.int64)
    # seeds of one item whose passages overlap are one passage
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:] + 2 * margin[1:])
    cuts = np.append(np.flatnonzero(new), len(row))
    for a, b in zip(cuts[:-1], cuts[1:]):
        k, d = int(item[a]), int(row[a])
        lo = max(int(w.first[d]), int(begin[a] - margin[a]))
        hi = min(int(w.first[d + 1]), int(begin[b - 1] + size[a] + margin[a]))
        passage, words_of_item = w.hash[lo:hi], own.items[k][1]
        key = (k, passage.tobytes())
        if key not in memory:
            if len(memory) > 20_000:
                memory.clear()
            memory[key] = align(words_of_item, passage)
        best, first, last = memory[key]
        score = best / (2 * len(words_of_item))
        if score >= min_score:
            yield d, own.items[k][0], score, lo + first - int(w.first[d]), lo + last - int(w.first[d]), best


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, rare: float = 1e-8, rare_pair: float = 1e-7, least_seeds: int = 8, min_score: float = 0.5, block_items: int = 20_000, block_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word, matched): each document and benchmark item that align.

    Words are runs of letters and digits in lower case. Seeds are the items' n-grams that chance makes rarely, by the rates of
    their words over the whole corpus, counted once; a passage around a seed, as wide as any alignment of ``min_score`` can be, is aligned word by word (match 2, other word or gap -1), and
    the score is what the best local alignment has of an item's full score. One row per document and item, its best
    passage, the first of equals.

    The benchmark is read in blocks of about ``block_items`` items and ``block_bytes`` bytes, the query set; only one block's seeds are broadcast at once.
    Documents are read as they lie: nothing of theirs is shuffled but hits. Null or wordless texts and items align
    with nothing; rows with a null id are passed over; repeated rows give their hits once; of columns only those named are
    read, whatever else they are called. A copy that keeps
    no seed of its item is missed: recall against aligning everything is measured in the tests.
    """
    spark = docs.sparkSession
    numbered = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    n_items, n_bytes = numbered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n_items // block_items), -(-n_bytes // block_bytes))
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = benchmark_words(numbered)
    if not len(wanted):
        return spark.createDataFrame([], HITS)
    rates, found = word_rates(texts, wanted, "text"), []
    for block in range(blocks):
        rows = sorted((r[0], r[1]) for r in numbered.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect())
        items = list(zip([r[0] for r in rows], token_hashes([r[1] for r in rows])))
        own = spark.sparkContext.broadcast(seeds(items, wanted, rates, n, rare, rare_pair, least_seeds))

        def scan(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            memory: dict = {}
            for batch in batches:
                ids = batch.column(0).to_numpy()
                out = [(int(ids[part.lo + d]), *rest) for part in W.slices(pc.utf8_lower(batch.column(1))) for d, *rest in hits(part, own.value, min_score, memory)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[c.split()[0] for c in HITS.split(", ")])

        found.append(texts.mapInArrow(scan, HITS))
    rows = reduce(DataFrame.unionByName, found)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("start"), "end_word", "matched")).alias("b")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", (-F.col("b.start")).alias("start_word"), "b.end_word", "b.matched")
