"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import extended

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The least probability of a piece. With it the sums over a word of SHORT bytes stay in a double's range; those over a longer one are scaled as they go.
FLOOR = 1e-7
SHORT = 40
#: Longer words are scored together in matrices of at most so many bytes, a yet longer one in blocks of columns.
LONG = 1 << 18


class Pieces(NamedTuple):
    """The vocabulary as byte strings, hashed; a word begins with a blank. Every byte is a piece too."""

    hash: np.ndarray  # sorted
    row: np.ndarray  # of the model's table
    seen: np.ndarray  # by the hash's top bits: worth looking up
    lengths: list[int]
    n: int


class Model(NamedTuple):
    langs: list[str]
    pieces: Pieces
    probs: np.ndarray  # piece x language; the last row, of no piece, is zero


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """From a sentencepiece model; nothing is trained there, and the ids it gives are not used."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(own.get_piece_size()):
        if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i)):
            piece = own.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                found.add(piece)
    ordered = sorted(found)
    data = np.frombuffer(b"".join(ordered), np.uint8)
    ends = np.cumsum([len(p) for p in ordered])
    starts = ends - [len(p) for p in ordered]
    up, down = W.powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.LETTERS[data] * up, dtype=np.uint64)])
    h = (total[ends] - total[starts]) * down[starts]
    order = np.argsort(h)
    seen = np.zeros(1 << 20, bool)
    seen[h >> np.uint64(44)] = True
    return Pieces(h[order], order, seen, sorted({len(p) for p in ordered}), len(ordered))


def spans(batch: np.ndarray, pieces: Pieces) -> dict[int, np.ndarray]:
    """For words of one length (a byte matrix): by piece length, the piece rows ending at each place; n where none does."""
    n, size = batch.shape
    up, down = W.powers(size + 1)
    total = np.zeros((n, size + 1), np.uint64)
    np.cumsum(W.LETTERS[batch] * up[:size], axis=1, out=total[:, 1:])
    out = {}
    for length in pieces.lengths:
        if length > size:
            break
        h = (total[:, length:] - total[:, :-length]) * down[: size - length + 1]
        rows = np.full(h.shape, pieces.n, np.int32)
        maybe = pieces.seen[h >> np.uint64(44)]
        at = np.minimum(np.searchsorted(pieces.hash, h[maybe]), pieces.n - 1)
        rows[maybe] = np.where(pieces.hash[at] == h[maybe], pieces.row[at], pieces.n)
        if (rows != pieces.n).any():
            out[length] = rows
    return out


def forward(found: dict[int, np.ndarray], probs: np.ndarray, n: int, size: int) -> np.ndarray:
    """alpha[word, place, language]: the sum over all segmentations of the first bytes."""
    alpha = np.zeros((size + 1, n, probs.shape[1]))
    alpha[0] = 1
    steps = []
    for length, rows in found.items():
        # most places end no piece of most lengths
        place, word = np.nonzero(rows.T != len(probs) - 1)
        steps.append((length, np.searchsorted(place, np.arange(size - length + 2)), word, probs[rows[word, place]]))
    for end in range(1, size + 1):
        for length, cuts, word, p in steps:
            if length <= end:
                a, b = cuts[end - length], cuts[end - length + 1]
                if b - a == n:
                    alpha[end] += alpha[end - length] * p[a:b]
                elif b > a:
                    own = word[a:b]
                    alpha[end, own] += alpha[end - length, own] * p[a:b]
    return alpha.transpose(1, 0, 2)


def by_length(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word indices, byte matrix, sizes): words of one length together, and long ones with some up to an eighth longer, filled up with zeros. The matrix has the leading blank, as the sizes do."""
    sizes = end - start
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    lo = 0
    while lo < len(order):
        size = int(ordered[lo])
        hi = int(np.searchsorted(ordered, size if size < SHORT else size + size // 8, "right"))
        if size >= SHORT:
            hi = max(lo + 1, min(hi, lo + LONG // (size + size // 8 + 1)))
        own, most = order[lo:hi], int(ordered[hi - 1])
        matrix = np.zeros((len(own), most + 1), np.uint8)
        matrix[:, 0] = 32
        at = np.arange(most)
        inside = at < sizes[own][:, None]
        matrix[:, 1:][inside] = data[(start[own][:, None] + at)[inside]]
        yield own, matrix, sizes[own] + 1
        lo = hi


def log_forward(matrix: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """word x language: the logarithm of the sum over all segmentations of words of any length, by scaled sums over blocks of columns."""
    n, width = matrix.shape
    most = model.pieces.lengths[-1]
    out, scale = np.zeros((n, len(model.langs))), np.zeros((n, len(model.langs)))
    before = np.zeros((n, most, len(model.langs)))  # the last sums of the block before
    before[:, -1] = 1
    ends = {int(x): np.flatnonzero(sizes == x) for x in np.unique(sizes)}
    step = max(64, LONG // n)
    for lo in range(0, width, step):
        hi, back = min(width, lo + step), min(lo, most)
        found = spans(matrix[:, lo - back : hi], model.pieces)
        alpha = np.zeros((n, most + hi - lo, len(model.langs)))
        alpha[:, :most] = before
        for end in range(lo + 1, hi + 1):
            at = most - 1 + end - lo
            for length, rows in found.items():
                if length <= end - lo + back:
                    alpha[:, at] += alpha[:, at - length] * model.probs[rows[:, end - lo + back - length]]
            if end % 32 == 0:
                # a word that has ended may have no way on
                by = np.where(alpha[:, at] > 0, alpha[:, at], 1)
                alpha[:, max(0, at - most + 1) : at + 1] /= by[:, None]
                scale += np.log(by)
            if end in ends:
                own = ends[end]
                out[own] = np.log(alpha[own, at]) + scale[own]
        before = alpha[:, -most:]
    return out


def sweep(found: dict[int, np.ndarray], probs: np.ndarray, n: int, width: int, most: int, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, logarithms of their scales) at each place of each word under one language; backward from the places ``begin``, if given."""
    sums, scale = np.zeros((n, width + 1)), np.zeros((n, width + 1))
    if begin is None:
        sums[:, 0] = 1
    else:
        sums[np.arange(n), begin] = 1
    for place in range(1, width + 1) if begin is None else range(width - 1, -1, -1):
        for length, rows in found.items():
            if begin is None and length <= place:
                sums[:, place] += sums[:, place - length] * probs[rows[:, place - length]]
            elif begin is not None and place + length <= width:
                sums[:, place] += sums[:, place + length] * probs[rows[:, place]]
        if place % 32 == 0:
            by = np.where(sums[:, place] > 0, sums[:, place], 1)
            window = slice(max(0, place - most + 1), place + 1) if begin is None else slice(place, place + most)
            sums[:, window] /= by[:, None]
            beyond = slice(window.start, None) if begin is None else slice(0, window.stop)
            scale[:, beyond] = scale[:, place][:, None] + np.log(by)[:, None]
    return sums, scale


def word_hashes(part: W.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, hash and row of each word."""
    w = W.words(part.data, part.bounds, W.space_separators(), W.LETTERS)
    return w.start, w.end, w.hash, w.doc


def fit(texts: pa.Array, pieces: Pieces, rounds: int = 4, extra: float = 0.1) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over all segmentations."""
    seen, hashes, counts = np.zeros(0, np.uint64), [], []
    groups: list[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]] = []
    for part in W.slices(texts):
        start, end, h, _ = word_hashes(part)
        own, first, count = np.unique(h, return_index=True, return_counts=True)
        hashes.append(own)
        counts.append(count)
        fresh = ~np.isin(own, seen)
        for at, matrix, sizes in by_length(part.data, start[first[fresh]], end[first[fresh]]):
            groups.append((own[fresh][at], sizes, spans(matrix, pieces)))
        seen = np.union1d(seen, own)
    total = np.bincount(np.searchsorted(seen, np.concatenate(hashes)), np.concatenate(counts), len(seen)) if len(seen) else seen
    probs = np.append(np.full(pieces.n, 1 / pieces.n), 0)
    most = pieces.lengths[-1]
    for _ in range(rounds):
        expected = np.full(pieces.n + 1, extra)
        for h, sizes, found in groups:
            n, width = len(sizes), int(sizes.max())
            alpha, up = sweep(found, probs, n, width, most)
            beta, down = sweep(found, probs, n, width, most, sizes)
            ends = np.arange(n), sizes
            whole = np.log(np.maximum(alpha[ends], 1e-300)) + up[ends]
            count = total[np.searchsorted(seen, h)]
            for length, rows in found.items():
                share = alpha[:, : width - length + 1] * probs[rows] * beta[:, length:]
                if width <= SHORT:
                    share *= np.exp(-whole)[:, None]
                else:
                    share *= np.exp(np.minimum(up[:, : width - length + 1] + down[:, length:] - whole[:, None], 700))
                share *= count[:, None]
                expected += np.bincount(rows.ravel(), share.ravel(), pieces.n + 1)
        probs = np.append(np.maximum(expected[:-1] / expected[:-1].sum(), FLOOR), 0)
    return probs


def fit_languages(docs: DataFrame, *, fit_docs: int = 400, vocabulary: str = VOCABULARY, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """One unigram model per language, from about ``fit_docs`` rows of each, drawn by a hash of the id.

    That bound is on the training sample alone. Rows without text or language teach nothing; each language is
    fitted in a task of its own, over its bounded sample; the languages found are the model's classes, so their number is that of
    labels. A table without labelled rows gives a model of no languages.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    pieces = load_pieces(vocabulary)
    if not counts:
        return Model([], pieces, np.zeros((pieces.n + 1, 0)))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    share = docs.sparkSession.createDataFrame([(k, min(1.0, fit_docs / n)) for k, n in counts.items()], "_lang string, _share double")
    sample = rows.join(F.broadcast(share), F.col(lang_col) == F.col("_lang")).where(draw <= F.col("_share")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        probs = fit(pa.array(frame["text"].tolist(), pa.large_string()), pieces)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "probs": [probs.tolist()]})

    learned = sorted((r[0], r[1]) for r in sample.groupBy("lang").applyInPandas(one, "lang string, probs array<double>").collect())
    if not learned:
        return Model([], pieces, np.zeros((pieces.n + 1, 0)))
    return Model([k for k, _ in learned], pieces, np.array([p for _, p in learned]).T)


def log_likelihoods(part: W.Slice, model: Model) -> np.ndarray:
    """row x language: the logarithm of the sum over all segmentations of each row's words."""
    start, end, h, doc = word_hashes(part)
    out = np.zeros((len(part.bounds) - 1, len(model.langs)))
    if len(h):
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        table = np.empty((len(first), len(model.langs)))
        for own, matrix, sizes in by_length(part.data, start[first], end[first]):
            if matrix.shape[1] <= SHORT:
                table[own] = np.log(forward(spans(matrix, model.pieces), model.probs, len(own), matrix.shape[1])[:, -1])
            else:
                table[own] = log_forward(matrix, sizes, model)
        rows, at = np.unique(doc, return_index=True)
        out[rows] = np.add.reduceat(table[back.ravel()], at, axis=0)
    return out


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the posterior of that language among those learned, each as likely at first.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if no language was learned. Ties go to the
    language that comes first by name. Whole texts are scored; nothing is shuffled. Columns named lang_pred or score
    in the input are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    docs = docs.select(*[f.name for f in fields])
    schema = extended(docs.schema, ("lang_pred", "string"), ("score", "double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            texts = batch.column(text_col)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if own.langs:
                for part in W.slices(texts):
                    logs = log_likelihoods(part, own)
                    logs -= logs.max(axis=1, keepdims=True)
                    post = np.exp(logs) / np.exp(logs).sum(axis=1, keepdims=True)
                    best = post.argmax(axis=1)
                    ok = lettered[part.lo : part.hi]
                    pred[part.lo : part.hi] = np.where(ok, np.array(own.langs, object)[best], "und")
                    score[part.lo : part.hi] = np.where(ok, post[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", modulus: int = 4, rest: int = 2):
    """Whether crc32(id as text) leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == rest, F.lit(False))
