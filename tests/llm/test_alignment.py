"""Token alignment against whole-text tokenisation by the libraries and a plain two-pointer walk."""

import hashlib
from collections import Counter

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import alignment
from tessella.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SLOW = Tokenizer.from_file(alignment.A_PATH)
SLOW.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)
LETTERS = alignment.byte_alphabet()
ODD = [None, "", " ", "x ", "  two  blanks  ", "a\n\n b\tc \r\n d", "<|endoftext|> <s> </s> [INST]", "▁marks ▁", "ﬁne ½ é é", "a  \n\nb", "!\x1c a \x1cb", "日本語のテキスト 。。。", "don't they'll I'VE", "a" * 700 + " b", "word " * 30_000, "0 1 22 333 4444 55555", "\U0001f600 \U0001f468‍\U0001f469", "the the the"]


def plain(text):
    """(a ids, b ids, groups, links) of one text, whole."""
    if not text:
        return [], [], [], []
    a, b = SLOW.encode(" " + text, add_special_tokens=False).ids, PIECES.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in SLOW.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], [], []
    groups, links, i, j, p, q, own = [], [], 0, 0, 0, 0, ([], [])
    own[0].append(a[0]), own[1].append(b[0])
    while True:
        links.append((a[i], b[j]))
        p_end, q_end = p + len(a_bytes[i]), q + len(b_bytes[j])
        if p_end <= q_end:
            i, p = i + 1, p_end
        if q_end <= p_end:
            j, q = j + 1, q_end
        if p == q:
            groups.append(own)
            own = ([], [])
        if i == len(a):
            return a, b, groups, links
        if p_end <= q_end:
            own[0].append(a[i])
        if q_end <= p_end:
            own[1].append(b[j])


def expected(texts):
    rows = [plain(t) for t in texts]
    counts = Counter(link for r in rows for link in r[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for a, b, groups, links in rows:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), hashlib.sha256(said.encode()).hexdigest() if said else "", sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links)))
    return out


def test_query_against_the_libraries(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip([d for d, _ in texts], expected([t for _, t in texts])))
    names = "n_a n_b n_groups n_links groups_sha256 n_best count_sum".split()
    got = {r.doc_id: tuple(r[c] for c in names) for r in QUERIES["op12_tokenizer_alignment"](spark, DATA).collect()}
    assert got == want


def test_odd_texts_repeated_rows_and_clashing_columns(spark):
    texts = ODD + ["the the the"]
    rows = [(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, row long")
    found = alignment.score_links(alignment.align_tokens(docs))
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "", r.n_best, r.count_sum) for r in found.collect()), key=str)
    assert got == sorted(((r[0], *e) for r, e in zip(rows, expected(texts))), key=str)
    assert alignment.score_links(alignment.align_tokens(docs.limit(0))).count() == 0


def test_light_pairs_are_joined(spark, monkeypatch):
    """With few pairs broadcast, most go through the join by pair; the outcome is the same."""
    monkeypatch.setattr(alignment, "HEAVY_SHARE", 20)
    texts = [t for t in ODD if t and len(t) < 100]
    found = alignment.score_links(alignment.align_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(r.n_best, r.count_sum) for r in found.orderBy("doc_id").collect()] == [e[5:] for e in expected(texts)]


def test_memories_that_are_emptied_give_the_same(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 2)
    held = alignment.Windows(alignment.Tokenizers(alignment.A_PATH, alignment.B_PATH))
    for _ in range(3):
        for text in [t for t in ODD if t and len(t) < 100]:
            a, b, n_a, n_b = held.tokenizers.encode([text])
            groups = held.align(a, b, n_a)[0]
            assert groups == [";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in plain(text)[2])]


HELD = alignment.windows_of(alignment.A_PATH, alignment.B_PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t a'sB1.▁é語"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_stretches_tokenise_as_whole_texts(text):
    a, b, groups, _ = plain(text)
    got_a, got_b, n_a, n_b = HELD.tokenizers.encode([text])
    assert got_a.tolist() == a and got_b.tolist() == b
    assert HELD.align(got_a, got_b, n_a)[1][0] == len(groups)
