"""Spelling variants against brute force."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from lakeops.llm import variants
from lakeops.llm.checks import QUERIES

SF_DIR = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute_counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return counts


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(itertools.zip_longest(a, b)) if x != y))
    return a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :]


def brute_variants(counts):
    buckets = defaultdict(set)
    for w in counts:  # words one edit apart share a word with one letter replaced by a blank, or with a blank put in
        for i in range(len(w) + 1):
            buckets[w[:i] + "\0" + w[i:]].add(w)
            if i < len(w):
                buckets[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in buckets.values():
        for a, b in itertools.permutations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    counts = {w: n for w, n in brute_counts(rows).items() if len(w) >= 5 and n >= 3}
    got = QUERIES["op11_spelling_variants"](spark, SF_DIR).collect()
    assert {tuple(r) for r in got} == brute_variants(counts) and len(got) == len(counts) > 100


def test_dense_vocabulary_over_many_blocks(spark):
    draw = np.random.default_rng(4)
    words = {"".join(draw.choice(list("abé"), draw.integers(1, 9))) for _ in range(700)}
    words |= {"x" * 200 + "ab", "x" * 200 + "abc", "x" * 200 + "b", "y" * 10_000, "y" * 10_001, "aaaaa", "aaaaaa", "ab" * 40, "ba" * 40}
    counts = {w: int(2 ** draw.integers(0, 12)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    short = {w: n for w, n in counts.items() if len(w) < 1000}
    want = brute_variants(short)
    pair = ("y" * 10_000, "y" * 10_001)
    for sizes in ((40, 8192, 25), (5, 20, 100)):
        got = {tuple(r) for r in variants.spelling_variants(df, *sizes).collect()}
        assert {r for r in got if r[0] in short} == want
        assert {r[0]: r[4] for r in got if r[0] in pair} == {pair[0]: 1, pair[1]: 1} and len(got) == len(words)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "1 2 !"), (None, "Straße straße STRAßE"), (4, "word WORD Wörd " * 3), (4, "word WORD Wörd " * 3), (5, "A" * 200_000), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], "doc_id long, text string, word string, n int, key string")
    assert {r.word: r.n for r in variants.count_words(df).collect()} == brute_counts(rows)
    empty = variants.spelling_variants(variants.vocabulary(variants.count_words(df.limit(0))))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    odd = spark.createDataFrame([("", 3), (None, 4), ("a", 1), ("b", 8)], "word string, n long")
    found = {r.word: (r.form, r.root, r.n_near) for r in variants.spelling_variants(odd).collect()}
    assert found == {"": ("b", "b", 2), "a": ("b", "b", 2), "b": (None, "b", 2)}


def test_ties_and_chains(spark):
    counts = {"aaaaa": 1, "aaaab": 2, "aaaac": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "zzzzz": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r.word: (r.form, r.root) for r in variants.spelling_variants(df).collect()}
    assert found["aaaaa"] == ("aaaab", "bbbbb") and found["aaaac"] == (None, "aaaac") and found["zzzzz"] == (None, "zzzzz")


def test_neighbours_share_matrix_rows(spark):
    """Ranges beyond one edit are skipped: the states walked stay far below queries x words."""
    words = sorted({"".join(w) for w in itertools.product("abcd", repeat=6)})
    held = variants.SortedList(words, np.ones(len(words), dtype=np.int64))
    seen = []
    whole = held.children
    held.children = lambda low, high, depth: seen.append(len(low)) or whole(low, high, depth)
    query, word = variants.near_words(words[:500], variants.prefix_lengths(words[:500], False), held)
    assert len(query) == 500 * 3 * 4 and sum(seen) < 500 * 60
