"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import words as W
from .common import discard, extended, materialize

#: Bytes that end a sentence: new line, full stop, exclamation and question mark.
STOPS = (0x0A, 0x2E, 0x21, 0x3F)


class Model(NamedTuple):
    hash: np.ndarray  # of the words, sorted
    weight: np.ndarray
    bias: float


def sentence_words(part: W.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash and sentence of each word; of each sentence its row, first and last byte. Sentences without a word don't count."""
    w = W.words(part.data, part.bounds, W.symbol_separators(), W.letters(lower=True))
    stop = np.zeros(256, bool)
    stop[list(STOPS)] = True
    at = np.cumsum(stop[part.data])
    key = (at[w.start] if len(w.start) else np.zeros(0, np.int64)) + w.doc * (len(part.data) + 1)
    _, first, sentence = np.unique(key, return_index=True, return_inverse=True)
    last = np.append(first[1:], len(w.start)) - 1
    return w.hash, sentence.ravel(), w.doc[first], w.start[first], w.end[last] if len(first) else first


def logits(h: np.ndarray, sentence: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Of each sentence; one without a word of the model shows nothing and can't be toxic, however many of them a text has."""
    z = np.full(n, -np.inf)
    if len(model.hash) and len(h):
        at = np.minimum(np.searchsorted(model.hash, h), len(model.hash) - 1)
        hit = model.hash[at] == h
        shown = np.bincount(sentence[hit], minlength=n) > 0
        z[shown] = model.bias + np.bincount(sentence[hit], model.weight[at[hit]], n)[shown]
    return z


def noisy_or(z: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) of each row's sentences; 0 for a row of none."""
    quiet = -np.logaddexp(0, z)
    return -np.expm1(np.bincount(row, quiet, n))


def fit(row: np.ndarray, sentence: np.ndarray, word: np.ndarray, labels: np.ndarray, size: int, rounds: int = 400, ridge: float = 1e-3, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """(weights, bias) of ``size`` words by adaptive gradient steps on the documents' log loss.

    ``row`` is the document of each sentence that has such words, ``sentence`` and ``word`` are its words.
    """
    n, n_s, y = len(labels), len(row), labels.astype(float)
    weight, bias = np.zeros(size), -4.0
    slope, slope_bias = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(sentence, weight[word], n_s)
        p = np.exp(-np.logaddexp(0, -z))
        whole = np.clip(noisy_or(z, row, n), 1e-9, 1 - 1e-9)
        back = p * (1 - y / whole)[row] / n
        grad = np.bincount(word, back[sentence], size) + ridge * weight / n
        slope += grad**2
        weight -= rate * grad / np.sqrt(slope)
        step = back.sum()
        slope_bias += step**2
        bias -= rate * step / np.sqrt(slope_bias)
    return weight, float(bias)


def _vocabulary(sample: DataFrame, n: int, share: float, least_docs: int, least_z: float) -> np.ndarray:
    """Sorted hashes of the words that ``least_docs`` rows hold and whose share among toxic ones is off by ``least_z`` standard deviations."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for part in W.slices(batch.column(0)):
                h, sentence, row, _, _ = sentence_words(part)
                pairs = np.unique(np.stack([row[sentence].astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(W.longs(pairs[1])), pa.array(labels[part.lo + pairs[0].astype(np.int64)], pa.int64())], names=["h", "label"])

    counts = sample.select("text", "label").mapInArrow(distinct, "h long, label long").groupBy("h").agg(F.count("*").alias("df"), F.sum("label").alias("toxic")).where(F.col("df") >= least_docs)
    off = F.abs(F.col("toxic") - F.col("df") * share) >= least_z * F.sqrt(F.col("df") * share * (1 - share))
    return np.sort(np.array([r[0] for r in counts.where(off).select("h").collect()], np.int64).view(np.uint64))


def fit_toxicity(labelled: DataFrame, *, fit_docs: int = 20_000, least_docs: int = 5, least_z: float = 4.0, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> Model:
    """From about ``fit_docs`` labelled rows drawn by a hash of the id: the bound of the training sample, and of the vocabulary learned.

    Words count that ``least_docs`` rows hold and whose share among toxic ones is off by ``least_z`` standard deviations: with
    so few labels the rest would only be learned by heart. They are chosen by counts over the sample; then only the places of
    such words, no texts, come to the task that fits their weights. Rows without text or label teach
    nothing; without rows of both labels every score is about 0. A row that is repeated teaches as often.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = materialize(rows.where(draw <= min(1.0, fit_docs / max(1, rows.count()))))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        return nothing
    vocab = _vocabulary(sample, n, toxic / n, least_docs, least_z)
    held = labelled.sparkSession.sparkContext.broadcast(vocab)
    places = "id long, label int, sentence array<int>, word array<int>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column(2)):
                h, sentence, row, _, _ = sentence_words(part)
                at = np.minimum(np.searchsorted(held.value, h), max(0, len(held.value) - 1))
                hit = held.value[at] == h if len(held.value) else np.zeros(len(h), bool)
                word, of = at[hit], sentence[hit]
                order = np.argsort(of, kind="stable")
                word, of = word[order], of[order]
                size = part.hi - part.lo
                each = np.bincount(row[of], minlength=size)
                own = [batch.column(i).slice(part.lo, size) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, W.lists(of, each, pa.int32()), W.lists(word, each, pa.int32())], names=[c.split()[0] for c in places.split(", ")])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "label"], kind="stable")
        row = np.repeat(np.arange(len(frame)), frame["word"].map(len))
        sentence, word = (np.concatenate([np.zeros(0, int), *frame[c]]).astype(int) for c in ("sentence", "word"))
        # a sentence is one of its row's
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1])
        weight, bias = fit(row[new], np.cumsum(new) - 1, word, frame["label"].to_numpy(), len(vocab))
        return pd.DataFrame({"weight": [weight.tolist()], "bias": [bias]})

    found = sample.select(F.col("id").cast("long").alias("id"), "label", "text").mapInArrow(find, places).withColumn("one", F.lit(1))
    weight, bias = found.groupBy("one").applyInPandas(one, "weight array<double>, bias double").first()
    discard(sample)
    return Model(vocab, np.array(weight, float), bias)


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", sentences: bool = True) -> DataFrame:
    """``docs`` with score (noisy-or of all sentences), predicted (score >= 0.5) and, with ``sentences``, toxic_sentences.

    toxic_sentences are the sentences whose own probability is at least 0.5, in order. A null, empty or wordless text has
    score 0 and none. Whole texts are scored; nothing is shuffled. Input columns of these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted", "toxic_sentences")
    more = [("score", "double"), ("predicted", "integer"), ("toxic_sentences", ArrayType(StringType()))]
    schema = extended(docs.schema, *more[: 2 + sentences])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            texts = batch.column(text_col)
            score, found = np.zeros(len(texts)), [[] for _ in range(len(texts) * sentences)]
            for part in W.slices(texts, 2 << 20):
                h, sentence, row, start, end = sentence_words(part)
                z = logits(h, sentence, len(row), own)
                score[part.lo : part.hi] = noisy_or(z, row, part.hi - part.lo)
                for k in np.flatnonzero(z >= 0) if sentences else ():
                    found[part.lo + row[k]].append(part.data[start[k] : end[k]].tobytes().decode())
            score = np.clip(score, 0, 1)
            more = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))] + ([pa.array(found, pa.list_(pa.string()))] if sentences else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "score", "predicted", "toxic_sentences"][: len(batch.columns) + len(more)])

    return docs.mapInArrow(run, schema)
