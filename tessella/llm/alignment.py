"""Cross-tokenizer alignment: shared ends before space-marked tokens cut documents into windows of token ids, whose alignments are memoised.

A document is tokenised in full by both tokenizers. Where tokens of both end at one byte and the next token of both begins with a
space, a window ends; natural text repeats its windows, so their groups and links are looked up by the ids in them. How often
the corpus links two ids is counted over all documents, and each link is then scored by that count.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import materialize

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"

#: Places where a text may be cut: before a blank that follows something other than white space. No token of either kind crosses them.
CUT = re.compile(r"(?<=\S)(?= )")
#: Texts in which a blank follows white space, or comes first, are cut by CUT; the others at each blank. For ASCII the pairs are looked for.
UNEVEN = re.compile(r"\A |\s ")
UNEVEN_PAIRS = [f"{chr(c)} " for c in (*range(0x09, 0x0E), *range(0x1C, 0x21))]
#: A longer stretch goes to the library made for the file; the faster one is quadratic in a stretch.
LONG = 256
#: Entries in a worker's memory of stretches and of windows; a full one is emptied.
REMEMBERED = 200_000
#: Fixed value: how byte-level BPE parts a text before it merges.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pair of ids with more than one of so many links of the corpus is joined by broadcast: there are fewer than this many.
HEAVY_SHARE = 200_000


def recalled(known: dict, keys: list, learn) -> np.ndarray:
    """What a memory knows of each key; new ones are learnt first, each once."""
    codes = list(map(known.get, keys))
    missing = [i for i, c in enumerate(codes) if c is None]
    if missing:
        learn(list(dict.fromkeys([keys[i] for i in missing])))
        for i in missing:
            codes[i] = known[keys[i]]
    return np.array(codes, np.int64)


class Ragged:
    """Rows of numbers of different lengths, end to end, to which rows are added."""

    def __init__(self, kind: type) -> None:
        self.flat, self.at, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        end, more = int(self.at[self.n]), self.n + len(sizes) + 1
        need = end + len(flat)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[:end], np.zeros(2 * need - end, self.flat.dtype)])
        if more > len(self.at):
            self.at = np.concatenate([self.at[: self.n + 1], np.zeros(2 * more, np.int64)])
        self.flat[end:need] = flat
        self.at[self.n + 1 : more] = end + np.cumsum(sizes)
        self.n += len(sizes)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows named by ``codes``, end to end, and their lengths."""
        sizes = self.at[codes + 1] - self.at[codes]
        begin = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.at[codes] - begin, sizes) + np.arange(int(sizes.sum()))], sizes


def byte_alphabet() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 as it is, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and a memory of the stretches that they have tokenised."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(a_path)
        self.slow.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            told = json.load(f)
        special, letters = {t["content"] for t in told.get("added_tokens", ())}, byte_alphabet()
        entries = {bytes(letters[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
        # ids follow the order of merges, so the vocabulary itself ranks them
        self.quick = tiktoken.Encoding("a", pat_str=PARTS, mergeable_ranks=entries, special_tokens={})
        self.a_bytes = {i: t for t, i in entries.items()}
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        named = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        self.blank = self.pieces.piece_to_id("▁")
        # where a piece goes on after a space mark, stretches would not be independent
        self.cuttable = not any(re.search("[^▁]▁", p) for p in named)
        self.a_size, self.a_space = self._sizes(self.a_bytes.items())
        self.b_size, self.b_space = self._sizes(enumerate(self.b_bytes))
        self.forget()

    @staticmethod
    def _sizes(entries) -> tuple[np.ndarray, np.ndarray]:
        entries = dict(entries)
        size, space = np.zeros(max(entries) + 1, np.int64), np.zeros(max(entries) + 1, bool)
        for i, t in entries.items():
            size[i], space[i] = len(t), t[:1] == b" "
        return size, space

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.a, self.b, self.fine = Ragged(np.int64), Ragged(np.int64), Ragged(bool)

    def stretches(self, text: str) -> list[str]:
        """What blank + text is made of, each stretch without the blank that begins it."""
        if not self.cuttable:
            return [text]
        if text[0] == " " or any(p in text for p in UNEVEN_PAIRS) if text.isascii() else UNEVEN.search(text):
            return [s[1:] for s in CUT.split(" " + text)]
        return text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Tokenise stretches and remember them; one whose tokens don't give its bytes back is not fine."""
        # those that end in white space, or are long, would not part from the next one where they should, or in time
        alone = np.array([not s or s[-1].isspace() or len(s) > LONG for s in new])
        new = [new[k] for k in np.argsort(alone, kind="stable")]
        many = len(new) - int(alone.sum())
        joined = "".join([f" {s}" for s in new[:many]])
        want = [b" " + s.encode() for s in new]
        size = np.fromiter(map(len, want), np.int64, len(want))
        a = np.asarray(self.quick.encode_ordinary(joined), np.int64)
        a_sizes = np.diff(np.searchsorted(np.cumsum(self.a_size[a]), np.cumsum(size[:many])), prepend=-1)
        rest = [self.slow.encode(" " + s, add_special_tokens=False).ids for s in new[many:]]
        a, a_sizes = np.concatenate([a, *rest]).astype(np.int64), np.append(a_sizes, [len(r) for r in rest]).astype(np.int64)
        pieces = self.pieces.encode(new, num_threads=1)
        for k in range(many, len(new)):
            if not new[k]:
                pieces[k] = [self.blank]
        b_sizes = np.fromiter(map(len, pieces), np.int64, len(new))
        b = np.fromiter(chain.from_iterable(pieces), np.int64, int(b_sizes.sum()))
        fine = self._same(self.a_bytes, a, a_sizes, want) & self._same(self.b_bytes, b, b_sizes, want)
        first = self.a.n
        self.a.add(a, a_sizes)
        self.b.add(b, b_sizes)
        self.fine.add(fine, np.ones(len(new), np.int64))
        self.known.update(zip(new, range(first, first + len(new))))

    @staticmethod
    def _same(entries, ids: np.ndarray, sizes: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Which stretches' tokens, joined, have the stretch's bytes."""
        told = [entries[i] for i in ids.tolist()]
        length = np.fromiter(map(len, told), np.int64, len(told))
        bytes_of = np.add.reduceat(np.append(length, 0), np.cumsum(sizes) - sizes) * (sizes > 0)
        if (bytes_of == np.fromiter(map(len, want), np.int64, len(want))).all() and b"".join(told) == b"".join(want):
            return np.ones(len(want), bool)
        at = [0, *np.cumsum(sizes).tolist()]
        return np.array([b"".join(told[lo:hi]) == w for lo, hi, w in zip(at, at[1:], want)], bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both, end to end, and how many each text has; none for a text that is empty or whose bytes a tokenizer changes."""
        cut = [self.stretches(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        codes = recalled(self.known, list(chain.from_iterable(cut)), self.learn)
        doc = np.repeat(np.arange(len(cut)), [len(own) for own in cut])
        bad = np.zeros(len(cut), bool)
        bad[doc[~self.fine.flat[self.fine.at[codes]]]] = True
        codes, doc = codes[~bad[doc]], doc[~bad[doc]]
        (a, a_sizes), (b, b_sizes) = self.a.take(codes), self.b.take(codes)
        return a, b, np.bincount(doc, a_sizes, len(cut)).astype(np.int64), np.bincount(doc, b_sizes, len(cut)).astype(np.int64)


class Windows:
    """A memory of window alignments by their ids: groups as text, how many, and the linked pairs.

    A window's key is its ids of a, then those of b (above all of a), as 32-bit numbers.
    """

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.tokenizers = tokenizers
        self.signs = [f"{i}{x}" for i in range(len(tokenizers.a_size)) for x in ",|"] + [f"{i}{x}" for i in range(len(tokenizers.b_size)) for x in ",;"]
        self.widths = np.array([len(x) for x in self.signs])
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text: list[str] = []
        self.groups, self.pairs = Ragged(np.int64), Ragged(np.int64)

    def learn(self, new: list[bytes]) -> None:
        """Align windows, all at once: each one's bytes are the same for both, so they are laid end to end."""
        t, n_ids = self.tokenizers, len(self.tokenizers.a_size)
        ids = np.frombuffer(b"".join(new), np.int32).astype(np.int64)
        tokens = np.fromiter(map(len, new), np.int64, len(new)) >> 2
        of_a = ids < n_ids
        a, b = ids[of_a], ids[~of_a] - n_ids
        n_a = np.add.reduceat(of_a.astype(np.int64), np.cumsum(tokens) - tokens)
        a_end, b_end, last = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]), np.cumsum(n_a)
        at = np.searchsorted(b_end, a_end)
        a_shared = b_end[at] == a_end
        i = np.flatnonzero(a_shared)
        k = at[i]
        b_shared = np.zeros(len(b), bool)
        b_shared[k] = True
        # two tokens overlap where the bytes between two neighbouring ends lie in both
        ends = np.concatenate([a_end, b_end[~b_shared]])
        ends.sort()
        first = np.searchsorted(a_end, ends)
        self.pairs.add(a[first] << 32 | b[np.searchsorted(b_end, ends)], np.bincount(np.searchsorted(last, first, "right"), minlength=len(new)))
        self.groups.add(np.bincount(np.searchsorted(last, i, "right"), minlength=len(new)), np.ones(len(new), np.int64))
        # the text has each group's tokens of a, then those of b, each with the sign that follows it
        a_group, b_group = np.cumsum(a_shared) - a_shared, np.cumsum(b_shared) - b_shared
        signs = np.zeros(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + np.append(0, k + 1)[a_group]] = 2 * a + a_shared
        signs[np.arange(len(b)) + (i + 1)[b_group]] = 2 * (b + len(t.a_size)) + b_shared
        text = "".join([self.signs[x] for x in signs.tolist()])
        stop = np.cumsum(self.widths[signs])[np.cumsum(tokens) - 1].tolist()
        self.known.update(zip(new, range(len(self.text), len(self.text) + len(new))))
        self.text += [text[x : y - 1] for x, y in zip([0, *stop[:-1]], stop)]

    def align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents end to end: their groups as text, numbers of groups, and their distinct pairs: which, how often, how many."""
        t = self.tokenizers
        a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        at = np.searchsorted(b_end, a_end)
        shared = b_end[np.minimum(at, max(0, len(b_end) - 1))] == a_end if len(b) else np.zeros(len(a), bool)
        i = np.flatnonzero(shared)
        k = at[i]
        opens = np.ones(len(i), bool)  # the last of all has no next token
        opens[:-1] = t.a_space[a[i[:-1] + 1]] & t.b_space[b[k[:-1] + 1]]
        last = np.zeros(len(a), bool)
        last[np.cumsum(n_a)[n_a > 0] - 1] = True
        opens |= last[i]
        i, k = i[opens] + 1, k[opens] + 1
        if len(self.known) > REMEMBERED:
            self.forget()
        # windows' ids end to end: those of a lie behind those of b of the windows before, and those of b behind those of a
        ids = np.zeros(len(a) + len(b), np.int32)
        own_a, own_b = np.diff(i, prepend=0), np.diff(k, prepend=0)
        ids[np.arange(len(a)) + np.repeat(k - own_b, own_a)] = a
        ids[np.arange(len(b)) + np.repeat(i, own_b)] = b + len(t.a_size)
        raw, stop = ids.tobytes(), (4 * (i + k)).tolist()
        codes = recalled(self.known, [raw[p:q] for p, q in zip([0, *stop[:-1]], stop)], self.learn)
        doc = np.searchsorted(np.cumsum(n_a), i - 1, "right")
        per_doc = np.bincount(doc, minlength=len(n_a))
        texts, own, lo = self.text, codes.tolist(), 0
        groups = []
        for n in per_doc.tolist():
            groups.append(";".join([texts[c] for c in own[lo : lo + n]]))
            lo += n
        n_groups = np.bincount(doc, self.groups.flat[self.groups.at[codes]], len(n_a)).astype(np.int64)
        pairs, sizes = self.pairs.take(codes)
        of = np.repeat(doc, sizes)
        n_b, n_pairs = len(t.b_size), len(t.a_size) * len(t.b_size)
        key = np.sort(of * n_pairs + (pairs >> 32) * n_b + (pairs & 0xFFFFFFFF))
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(fresh)
        of, pair = np.divmod(key[begin], n_pairs)
        return groups, n_groups, (pair // n_b) << 32 | pair % n_b, np.diff(np.append(begin, len(key))), np.bincount(of, minlength=len(n_a))


@lru_cache(maxsize=2)
def windows_of(a_path: str, b_path: str) -> Windows:
    return Windows(Tokenizers(a_path, b_path))


def align_tokens(docs: DataFrame, *, a_path: str = A_PATH, b_path: str = B_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How two tokenizers' tokens of each whole text lie over each other.

    ``a_path`` is a byte-level BPE file, which gets blank + text; ``b_path`` a piece model that adds the blank itself. Rows: doc_id,
    n_a and n_b (tokens), n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``: the ids between bytes where both have an end), and the
    linked pairs of ids, ``a << 32 | b``, each once with how many times it is linked. Texts that are null, empty, or that a
    tokenizer changes (its tokens' bytes, joined, are others) have no tokens: zeros, '' and empty lists. Strings of special tokens are
    plain text. Each row stands for itself, so repeated rows give repeated rows; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = windows_of(a_path, b_path)
        for batch in batches:
            for part in W.slices(batch.column(1)):
                texts = batch.column(1).slice(part.lo, part.hi - part.lo).to_pylist()
                a, b, n_a, n_b = held.tokenizers.encode(texts)
                groups, n_groups, pairs, times, sizes = held.align(a, b, n_a)
                columns = [batch.column(0).slice(part.lo, part.hi - part.lo), n_a, n_b, n_groups, n_a + n_b - n_groups, groups, W.lists(pairs, sizes, pa.int64()), W.lists(times.astype(np.int32), sizes, pa.int32())]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ALIGNED)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of all documents hold each pair of ids, and whether no pair of the same second id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = materialize(each.groupBy("pair").agg(F.sum("times").alias("n")))
    most = counts.groupBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, counts["pair"].bitwiseAND(F.lit(0xFFFFFFFF)) == most["b"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame) -> DataFrame:
    """``aligned`` without pairs and times, with n_best (links whose pair is its second id's most frequent, ties included) and count_sum (the links' counts, summed).

    Counts are of all rows of ``aligned``, which is written once. Pairs with more than 1 / HEAVY_SHARE of all links, fewer than
    HEAVY_SHARE of them however large the corpus is, are broadcast; the others, none of which is a large key, are joined by pair.
    """
    rows = materialize(aligned.withColumn("row", F.monotonically_increasing_id()))
    counts = materialize(link_counts(rows))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(counts.where(F.col("n") * HEAVY_SHARE > total))
    light = counts.where(F.col("n") * HEAVY_SHARE <= total)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    often = links.join(heavy, "pair").groupBy("row").agg(*sums)
    seldom = links.join(heavy.select("pair"), "pair", "left_anti").join(light, "pair").groupBy("row").agg(*sums)
    both = often.unionByName(seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = rows.drop("pairs", "times").join(both, "row", "left").drop("row")
    return kept.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
