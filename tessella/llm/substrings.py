"""Substring dedup: suffix automata of reference shards give matching statistics; long enough matches are removed.

Every run of ``min_words`` words has an anchor, the least hash of its inner n-grams, which is the same wherever the run
stands, so a run meets the one shard of the reference that can hold it. Passages that very many documents share
are few: they make shards of bounded size, whose automata are broadcast, and the documents stream past
them. The rest of the reference, every document with a smaller id, grows with the corpus, and no broadcast of it is bounded: its
shards are dealt by anchor, and each one's automaton is built where the shard is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import extended, materialize

UID, MARKS, OF = "__uid", "__marks", "__of"
CONTEXTS = "key long, doc_id long, uid int, start int, text binary"
REMOVED = "doc_id long, uid int, start int, n int"
EXACT = "k1 long, k2 long, doc_id long, uid int, start int"


class SuffixAutomaton:
    """Of several word sequences; ``match`` gives the longest suffix at each place that one of them holds, ``holders`` the least of those that hold one of a given length."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.least: dict[int, int] = {}  # by state, the least name of a sequence that ends there

    def add(self, sequence: list[bytes], name: int = 0) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in sequence:
            known = nxt[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
            elif known is None:
                new = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
                last = new
            else:
                last = self._clone(last, known, word)
            self.least[last] = min(name, self.least.get(last, name))

    def settle(self) -> SuffixAutomaton:
        """Names go from longer matches to the shorter ones that end where they do; call it when all sequences are in."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            up, name = self.link[state], self.least.get(state)
            if up > 0 and name is not None:
                self.least[up] = min(name, self.least.get(up, name))
        return self

    def _clone(self, p: int, q: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def match(self, sequence: list[bytes]) -> list[int]:
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for word in sequence:
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                size += 1
            out.append(size)
        return out

    def holders(self, sequence: list[bytes], size: int) -> list[int | None]:
        """At each place the least name of a sequence that holds the ``size`` words up to it."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for word in sequence:
            while state and word not in nxt[state]:
                state = link[state]
                n = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                n += 1
            at = state if n >= size else None
            while at is not None and length[link[at]] >= size:
                at = link[at]
            out.append(None if at is None else self.least[at])
        return out


def anchors(part: W.Slice, min_words: int, gram: int) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """The words, the anchor of each window of ``min_words`` words, and whether the window lies in one row."""
    w = W.words(part.data, part.bounds, W.space_separators(), W.LETTERS)
    g = W.grams(w.hash, gram)
    size = max(0, len(w.hash) - min_words + 1)
    least = g[:size].copy()
    for k in range(1, min_words - gram + 1):
        np.minimum(least, g[k : k + size], out=least)
    return w, least, W.within(w.doc, min_words)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named)], names=[n for n, _ in named])


def _fingerprints(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """(v, doc_id, n): the distinct anchors of each document, and in how many stretches of it each is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in W.slices(batch.column(1)):
                w, v, ok = anchors(part, min_words, gram)
                doc = w.doc[: len(v)]
                keep = ok.copy()
                keep[1:] &= (v[1:] != v[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
                v, doc = v[keep], doc[keep]
                order = np.lexsort((v, doc))
                v, doc = v[order], doc[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])
                n = np.diff(np.append(np.flatnonzero(new), len(v)))
                yield _batch("v long, doc_id long, n int", [W.longs(v[new]), ids[part.lo + doc[new]], n.astype(np.int32)])

    return docs.select("doc_id", "text").mapInArrow(run, "v long, doc_id long, n int")


def _marked(part: W.Slice, marks: list[np.ndarray], min_words: int, gram: int) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """Words, anchors, and which windows have an anchor that is marked for their row."""
    w, v, ok = anchors(part, min_words, gram)
    hit = np.zeros(len(v), bool)
    for row, mark in enumerate(marks):
        lo, hi = w.first[row], min(w.first[row + 1], len(v))
        if hi > lo and len(mark):
            mark = np.sort(mark.view(np.uint64))
            own = v[lo:hi]
            hit[lo:hi] = mark[np.minimum(np.searchsorted(mark, own), len(mark) - 1)] == own
    return w, v, hit & ok


def _stretches(batch: pa.RecordBatch, id_col: str, text_col: str, min_words: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(anchor, doc_id, uid, start word, words) of each stretch of windows with one marked anchor."""
    ids, uids, marks = batch.column(id_col).to_numpy(), batch.column(UID).to_numpy(), batch.column(MARKS)
    for part in W.slices(batch.column(text_col)):
        own = [marks[i].values.to_numpy() for i in range(part.lo, part.hi)]
        w, v, hit = _marked(part, own, min_words, gram)
        new, doc = hit.copy(), w.doc[: len(v)]
        new[1:] &= ~hit[:-1] | (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        if not len(begin):
            continue
        stop = hit.copy()
        stop[:-1] &= ~hit[1:] | new[1:]
        end = np.flatnonzero(stop)
        lo, hi, row = w.start[begin], w.end[end + min_words - 1], doc[begin]
        raw = part.data.tobytes()
        text = [b" ".join(raw[a:b].split()) for a, b in zip(lo.tolist(), hi.tolist())]
        yield v[begin], ids[part.lo + row], uids[part.lo + row], (begin - w.first[row]).astype(np.int32), text


def _contexts(rows: DataFrame, id_col: str, text_col: str, min_words: int, gram: int) -> DataFrame:
    """Each stretch as a row: key (the anchor), doc_id, uid, start word and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, doc, uid, start, text in _stretches(batch, id_col, text_col, min_words, gram):
                yield _batch(CONTEXTS, [W.longs(v), doc, uid, start, text])

    return rows.mapInArrow(run, CONTEXTS)


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """(first, number) of the runs of consecutive places."""
    out: list[tuple[int, int]] = []
    for place in places:
        if out and out[-1][0] + out[-1][1] == place:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((place, 1))
    return out


def _stream(rows: DataFrame, automaton: SuffixAutomaton, id_col: str, text_col: str, min_words: int, gram: int) -> DataFrame:
    """Windows that the broadcast automaton of a reference shard holds from a smaller document; the rows stream past it as they lie."""
    held = rows.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for _, docs, uids, starts, texts in _stretches(batch, id_col, text_col, min_words, gram):
                for doc, uid, start, text in zip(docs.tolist(), uids.tolist(), starts.tolist(), texts):
                    found = held.value.holders(text.split(b" "), min_words)
                    for place, n in _runs([end + 1 - min_words for end, name in enumerate(found) if name is not None and name < doc]):
                        for column, value in zip(out, (doc, uid, start + place, n)):
                            column.append(value)
            yield _batch(REMOVED, list(out))

    return rows.mapInArrow(run, REMOVED)


def _reference(known: DataFrame, windows: DataFrame, first: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc_id, text): the runs of the repeated windows in ``first`` where the document that has each first has them."""
    at = windows.join(first, ["k1", "k2"]).where("doc_id = first").groupBy(F.col("doc_id").alias(OF)).agg(F.collect_list("uid").alias("__uids"), F.collect_list("start").alias(MARKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for doc, uid, text, uids, starts in zip(*(batch.column(c).to_pylist() for c in (id_col, UID, text_col, "__uids", MARKS))):
                words = text.encode().split()
                for place, n in _runs(sorted({s for u, s in zip(uids, starts) if u == uid})):
                    ids.append(doc)
                    texts.append(b" ".join(words[place : place + n + min_words - 1]))
            yield _batch("doc_id long, text binary", [ids, texts])

    return known.join(F.broadcast(at), F.col(id_col) == F.col(OF)).mapInArrow(run, "doc_id long, text binary")


def _exact(rows: DataFrame, id_col: str, text_col: str, min_words: int, gram: int) -> DataFrame:
    """Windows themselves, by a 128-bit hash, for anchors that very many documents share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uids, marks = batch.column(id_col).to_numpy(), batch.column(UID).to_numpy(), batch.column(MARKS)
            for part in W.slices(batch.column(text_col)):
                own = [marks[i].values.to_numpy() for i in range(part.lo, part.hi)]
                w, _, hit = _marked(part, own, min_words, gram)
                at = np.flatnonzero(hit)
                row = w.doc[at]
                one, two = W.grams(w.hash, min_words)[at], W.grams(W.mix(w.hash + W.GRAM), min_words)[at]
                yield _batch(EXACT, [W.longs(one), W.longs(two), ids[part.lo + row], uids[part.lo + row], (at - w.first[row]).astype(np.int32)])

    return rows.mapInArrow(run, EXACT)


def _match(contexts: DataFrame, min_words: int) -> DataFrame:
    """Windows that a smaller document has. A shard's contexts come by document, so the automaton holds smaller ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = now = None
        automaton: SuffixAutomaton | None = None
        seen: set[bytes] = set()  # of smaller documents
        own: list[bytes] = []  # of this document
        waiting: list[bytes] = []  # seen, but not in the automaton yet
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, doc, uid, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    key, now, automaton, seen, own, waiting = k, doc, None, set(), [], []
                elif doc != now:
                    fresh = [t for t in dict.fromkeys(own) if t not in seen]
                    seen.update(fresh)
                    waiting += fresh
                    own, now = [], doc
                if text in seen:
                    runs = [(0, text.count(b" ") + 2 - min_words)]
                else:
                    own.append(text)
                    runs = []
                    if seen:
                        automaton = automaton or SuffixAutomaton()
                        for t in waiting:
                            automaton.add(t.split(b" "))
                        waiting = []
                        for end, size in enumerate(automaton.match(text.split(b" "))):
                            if size >= min_words:
                                place = end + 1 - min_words
                                if runs and runs[-1][0] + runs[-1][1] == place:
                                    runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                                else:
                                    runs.append((place, 1))
                for place, n in runs:
                    for column, value in zip(out, (doc, uid, start + place, n)):
                        column.append(value)
            yield _batch(REMOVED, list(out))

    parted = contexts.repartition("key").sortWithinPartitions("key", "doc_id")
    return parted.mapInArrow(run, REMOVED)


def repeated_windows(known: DataFrame, *, min_words: int = 13, hot_stretches: int = 5_000, broadcast_windows: int = 500_000, shard_words: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, uid, start, n): runs of windows that documents with smaller ids hold too.

    ``known`` has a row tag named UID, and neither ids nor texts that are null. Anchors that two documents share are found by
    count, combined before the shuffle. An anchor of more than ``hot_stretches`` stretches would make a large shard: its
    windows are taken one by one and counted with their smallest document, an exact way of the same outcome that
    has no large group. Their repeated windows, up to ``broadcast_windows`` of them, are the reference whose shards of
    ``shard_words`` words are broadcast as automata, one after the other; beyond that they are joined by hash. Whole rows go into the join with their marks, as they do in ``remove_repeats``: Spark shuffles them once for all.
    """
    gram = max(1, min_words // 3)
    marks = _fingerprints(known.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_words, gram)
    shared = materialize(marks.groupBy("v").agg(F.count("*").alias("n"), (F.sum("n") > hot_stretches).alias("hot")).where("n > 1").drop("n"))
    pairs = materialize(marks.select("doc_id", "v").join(shared, "v").select("doc_id", "v", "hot"))

    def rows(hot: bool) -> DataFrame:
        own = pairs.where(F.col("hot") == hot).groupBy(F.col("doc_id").alias(OF)).agg(F.collect_list("v").alias(MARKS))
        return known.join(own, F.col(id_col) == F.col(OF))

    found = _match(_contexts(rows(False), id_col, text_col, min_words, gram), min_words)
    if pairs.where("hot").isEmpty():
        return found
    windows = _exact(rows(True), id_col, text_col, min_words, gram)
    first = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").drop("last")
    first = materialize(first)
    if first.count() > broadcast_windows:
        settled = windows.join(first, ["k1", "k2"]).where("doc_id > first").select("doc_id", "uid", "start", F.lit(1).alias("n"))
        return found.unionByName(settled)
    texts = materialize(_reference(known, windows, F.broadcast(first), id_col, text_col, min_words)).toLocalIterator()
    while shard := _shard(texts, shard_words):
        found = found.unionByName(_stream(rows(True), shard, id_col, text_col, min_words, gram))
    return found


def _shard(texts: Iterator, most: int) -> SuffixAutomaton | None:
    """The automaton of the next texts, of about ``most`` words together; none when there are no more."""
    automaton, words = SuffixAutomaton(), 0
    for doc, text in texts:
        sequence = bytes(text).split(b" ")
        automaton.add(sequence, doc)
        words += len(sequence)
        if words >= most:
            break
    return automaton.settle() if words else None


def remove_repeats(docs: DataFrame, *, min_words: int = 13, hot_stretches: int = 5_000, broadcast_windows: int = 500_000, shard_words: int = 100_000, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` without words covered by ``min_words`` consecutive ones that a document with a smaller id holds too.

    Words are runs of anything but ASCII white space, unchanged; windows are judged on the input. Adds n_words,
    n_removed and kept_sha256 (of the kept words joined by one blank); with ``keep_text`` also kept_text. Input columns
    of these names are replaced. A null text has no words; rows with a null id are neither shortened nor a reference; rows with
    one id don't shorten each other; an empty table gives no rows.
    """
    names = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    docs = docs.drop(*names)
    fields = docs.schema
    rows = docs.withColumn(UID, F.hash(id_col, text_col))
    fine = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    gone = repeated_windows(rows.where(fine), min_words=min_words, hot_stretches=hot_stretches, broadcast_windows=broadcast_windows, shard_words=shard_words, id_col=id_col, text_col=text_col)
    lists = [F.collect_list(c).alias(f"__{c}s") for c in ("uid", "start", "n")]
    gone = gone.groupBy(F.col("doc_id").alias(OF)).agg(*lists)
    joined = rows.where(fine).join(gone, F.col(id_col) == F.col(OF), "left").drop(OF)
    joined = joined.unionByName(rows.where(~fine), allowMissingColumns=True)
    schema = extended(fields, *list(zip(names, ("long", "long", "string", "string")))[: 3 + keep_text])
    width = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(n) for n in (UID, "__uids", "__starts", "__ns")}
            texts = batch.column(text_col)
            n_words, n_removed, shas, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                tokens = text.split()
                n_words.append(len(tokens))
                if get["__uids"][i].is_valid:
                    mine = get["__uids"][i].values.to_numpy() == get[UID][i].as_py()
                    starts, ns = get["__starts"][i].values.to_numpy()[mine], get["__ns"][i].values.to_numpy()[mine]
                    edge = np.zeros(len(tokens) + 1, np.int32)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + ns + min_words - 1, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    tokens = [t for t, c in zip(tokens, covered.tolist()) if not c]
                n_removed.append(n_words[-1] - len(tokens))
                out = b" ".join(tokens)
                shas.append(hashlib.sha256(out).hexdigest())
                if keep_text:
                    # a text that loses nothing stays as it is
                    kept.append(out.decode() if n_removed[-1] else texts[i].as_py())
            more = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())] + ([pa.array(kept, pa.string())] if keep_text else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], names=[*batch.schema.names[:width], *names[: len(more)]])

    return joined.mapInArrow(run, schema)
