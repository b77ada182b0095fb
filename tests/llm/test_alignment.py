"""Token alignment against the tokenizers' own libraries and plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lakeops.llm import align
from lakeops.llm.checks import QUERIES

SF_DIR = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return align.read_vocabularies(A_PATH, B_PATH, public_tokenizers.PATTERN)


def spans(sizes):
    at, out = 0, []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def brute(texts):
    """Per text: ids and spans by the libraries, links by comparing byte places, groups by common ends."""
    a_tok = Tokenizer.from_file(A_PATH)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = align.byte_letters()
    a_text = {i: bytes(letters[c] for c in t) for t, i in a_tok.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}
    piece = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for text in texts:
        a, b = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids, b_tok.encode(text or "", num_threads=1)
        wanted = b" " + (text or "").encode()
        if not text or b"".join(a_text[i] for i in a) != wanted or b"".join(map(piece, b)) != wanted:
            found.append(None)
            continue
        sa, sb = spans(len(a_text[i]) for i in a), spans(len(piece(i)) for i in b)
        at_byte = {k: j for j, (s, e) in enumerate(sb) for k in range(s, e)}
        links = [(i, j) for i, (s, e) in enumerate(sa) for j in sorted({at_byte[k] for k in range(s, e)})]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        place = {end: k for k, end in enumerate(ends)}
        groups, k = [([], []) for _ in ends], 0
        for side, (ids, covered) in enumerate(((a, sa), (b, sb))):
            k = 0
            for x, (_, e) in zip(ids, covered):
                groups[k][side].append(x)
                k = place[e] + 1 if e in place else k
        found.append((a, b, links, groups))
    counts = Counter((a[i], b[j]) for f in found if f for a, b, links, _ in [f] for i, j in links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = f
        n = [counts[a[i], b[j]] for i, j in links]
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        inside = sum(len(x) * len(y) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), inside, sum(k == best[b[j]] for k, (_, j) in zip(n, links)), sum(n), listed))
    return rows, found


ODD = [None, "", " ", "a", "a", "x▁y", "\x00", "<|endoftext|> <s> </s> <unk>", "é漢字😀‍ ﬁ", "  two  spaces \n\n", "a" * 5000, "no-break space　wide"]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute([r.text for r in docs])
    got = {r.doc_id: r for r in QUERIES["op12_cross_tokenizer_alignment"](spark, SF_DIR).collect()}
    for r, (*figures, listed) in zip(docs, want, strict=True):
        assert tuple(got[r.doc_id][f] for f in align.FIGURES) == tuple(figures)
        assert got[r.doc_id].groups_sha256 == (hashlib.sha256(listed.encode()).hexdigest() if listed else "")


@pytest.mark.parametrize("head", [0, 3, align.HEAD])
def test_odd_texts(spark, both, head):
    texts = [*ODD, "the cat sat on the mat " * 500, "the cat sat on the mat " * 500]
    df = spark.createDataFrame([(i % 5 or None, t, 7, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, row int, a string, pair string")
    coded = align.tokenize(df, both)
    got = align.align(coded, both, align.count_pairs(coded, both, head)).collect()
    want = Counter((i % 5 or None, *w) for i, w in enumerate(brute(texts)[0]))
    assert Counter(tuple(r) for r in got) == want
    none = align.tokenize(df.limit(0), both)
    assert align.align(none, both, align.count_pairs(none, both, head)).count() == 0


def test_links_over_slices(spark, both, monkeypatch):
    texts = ["Überraschung: tokenization of antidisestablishmentarianism 12345 " * 3, "", "short", "x▁y", "öäü ß " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    coded = align.tokenize(df, both)
    numbers = {r.row: r.doc_id for r in coded.select("row", "doc_id").collect()}
    want = {(i, x, y, f[0][x], f[1][y]) for i, f in enumerate(brute(texts)[1]) if f for x, y in f[2]}
    for limit in (4, align.PIECE_TOKENS):
        monkeypatch.setattr(align.slices, "__defaults__", (limit,))
        assert {(numbers[r.row], *tuple(r)[1:]) for r in align.link_rows(coded, both).collect()} == want


def test_row_products_equal_dense_ones():
    draw = np.random.default_rng(2)
    dense_a, dense_b = draw.integers(0, 3, (7, 11)), draw.integers(0, 3, (11, 5))

    def sparse(m):
        rows, columns = np.nonzero(m)
        return align.Csr(np.searchsorted(rows, np.arange(len(m) + 1)), columns, m[rows, columns], m.shape[1])

    found = align.row_product(sparse(dense_a), sparse(dense_b))
    out = np.zeros((7, 5), dtype=np.int64)
    out[np.repeat(np.arange(7), np.diff(found.starts)), found.columns] = found.values
    assert (out == dense_a @ dense_b).all()
    turned = sparse(dense_a).transposed()
    assert (turned.starts == sparse(dense_a.T).starts).all() and (turned.columns == sparse(dense_a.T).columns).all()
    assert align.shared_group_counts(np.array([0, 0, 1]), np.array([0, 1, 1, 1]), 2).tolist() == [1, 1, 3]
