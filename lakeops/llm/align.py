"""Alignment of two tokenizers by the bytes their tokens cover.

Every text is encoded once by both; the ids are written to the shared folder. Tokens x bytes incidence
matrices in hand-built CSR form give the overlap links as row products A·Bᵀ (bytes between two neighbouring token
ends have equal columns, so such a run is one column whose value is its length); byte offsets where tokens of
both end cut a text into groups, whose token x group incidence gives the links inside shared groups.

How often an id pair is linked is counted over the whole corpus. The counts of the ``HEAD`` most frequent
pairs travel to the tasks (a fixed number, about 4 MB), and so does the highest count of each B id (bounded
by the vocabulary). All other pairs meet their counts in a join: such a pair holds less than a share of
1 / ``HEAD`` of all links, so no join key is hot.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.shared import handover

HEAD = 1 << 18
PIECE_TOKENS = 1 << 17  # tokens whose matrices a task holds at once; longer texts are cut between groups
BATCH_ROWS = 1000  # texts, or their ids, that come to a Python worker at once
TEXTS_LETTERS = 1 << 19  # of texts a task encodes or writes out at once; a longer text is held alone


# ---- CSR matrices ----------------------------------------------------------------------------


@dataclass
class Csr:
    """Rows of (column, value) entries: row i holds the places ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(len(self)), np.diff(self.starts))
        starts = np.zeros(self.width + 1, dtype=np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=starts[1:])
        return Csr(starts, rows[order], self.values[order], len(self))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of all ranges, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Entries per row of A·B before equal columns are added up (the symbolic step of a row product)."""
    sizes = np.diff(b.starts)[a.columns]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ends[a.starts[1:]] - ends[a.starts[:-1]]


def row_product(a: Csr, b: Csr) -> Csr:
    """A·B, row by row: row i adds up the rows of B that the entries of row i of A name."""
    sizes = np.diff(b.starts)[a.columns]
    places = spread(b.starts[a.columns], sizes)
    rows = np.repeat(np.repeat(np.arange(len(a)), np.diff(a.starts)), sizes)
    values = np.repeat(a.values, sizes) * b.values[places]
    cells = rows * b.width + b.columns[places]
    if len(cells) and (np.diff(cells) < 0).any():
        order = np.argsort(cells, kind="stable")
        cells, values = cells[order], values[order]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    cells = cells[first]
    starts = np.searchsorted(cells, np.arange(len(a) + 1) * b.width)
    return Csr(starts, cells % b.width if b.width else cells, np.add.reduceat(values, first) if len(first) else values, b.width)


def byte_incidence(stops: np.ndarray, widths: np.ndarray) -> Csr:
    """Tokens x bytes. Bytes between two neighbouring token ends (of either side) lie in the same tokens, so they are one
    column and their number is its value: ``widths`` of all columns, and how many columns end with or before each token."""
    return Csr(np.concatenate([[0], stops]), np.arange(len(widths)), widths, len(widths))


def group_incidence(groups: np.ndarray, count: int) -> Csr:
    """Tokens x groups: one entry a token."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), dtype=np.int64), count)


def overlap_links(a_stops: np.ndarray, b_stops: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the tokens that share bytes."""
    links = row_product(byte_incidence(a_stops, widths), byte_incidence(b_stops, np.ones_like(widths)).transposed())
    return np.repeat(np.arange(len(links)), np.diff(links.starts)), links.columns


def shared_group_counts(a_groups: np.ndarray, b_groups: np.ndarray, count: int) -> np.ndarray:
    """For each A token, the number of B tokens of its group. Only sizes are formed, as the pairs of one group
    may be many; its B tokens are neighbours, so a size and the first one name them all."""
    return row_sizes(group_incidence(a_groups, count), group_incidence(b_groups, count).transposed())


# ---- tokenizers ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabularies:
    """What tasks need of both tokenizers: token bytes by id, the pre-token pattern and the piece model."""

    a_bytes: tuple[bytes, ...]
    a_special: tuple[tuple[str, int], ...]
    pattern: str
    b_model: bytes


def byte_letters() -> dict[str, int]:
    """Byte of each letter in which byte-level vocabularies spell their tokens: visible Latin-1 characters stand
    for themselves, all other bytes for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def read_vocabularies(a_path: str, b_path: str, pattern: str) -> Vocabularies:
    """A: a byte-level BPE file of the ``tokenizers`` library whose ids follow its merges, so that merging by
    lowest id equals merging by the list (checked). B: a ``sentencepiece`` model file."""
    with open(a_path, encoding="utf-8") as text:
        spec = json.load(text)
    model, cut = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or spec["normalizer"]:
        raise ValueError(f"{a_path}: not a plain byte-level BPE vocabulary")
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if sum(len(t) == 1 for t in vocabulary) < 256:
        raise ValueError(f"{a_path}: some bytes have no token")
    if sorted(vocabulary.values()) != list(range(len(vocabulary))) or [vocabulary[x + y] for x, y in merges] != list(range(256, 256 + len(merges))):
        raise ValueError(f"{a_path}: ids do not follow the merges")
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    spelled = sorted((i, token) for token, i in vocabulary.items() if token not in special)
    with open(b_path, "rb") as data:
        return Vocabularies(tuple(bytes(letters[c] for c in token) for _, token in spelled), tuple(special.items()), pattern, data.read())


class Coder:
    """Both tokenizers inside a task."""

    def __init__(self, given: Vocabularies):
        self.given = given
        self.a_bytes = list(given.a_bytes)
        self.a_sizes = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.spelled: list[str] = []

    @cached_property
    def a(self) -> tiktoken.Encoding:
        ranks = {token: i for i, token in enumerate(self.a_bytes)}
        return tiktoken.Encoding("a", pat_str=self.given.pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def b(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.given.b_model)

    @cached_property
    def b_bytes(self) -> list[bytes]:
        return [self._piece(i) for i in range(self.b.get_piece_size())]

    @cached_property
    def b_sizes(self) -> np.ndarray:
        return np.array([len(t) for t in self.b_bytes], dtype=np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each text in both vocabularies, as little-endian unsigned 32-bit integers; none where B does not give the
        text back byte by byte, or the text is empty. A does so always: it has every byte and changes none."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            if text and b"".join(map(self.b_bytes.__getitem__, b)) == b" " + text.encode():
                a = self.a.encode_ordinary(" " + text)
                out.append((np.array(a, dtype="<u4").tobytes(), np.array(b, dtype="<u4").tobytes()))
            else:
                out.append((b"", b""))
        return out

    def names(self) -> list[str]:
        """Ids as decimals with the sign behind them: ``a,``, then ``a|``, ``b,`` and ``b;``."""
        if not self.spelled:
            sizes = [(len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")]
            self.spelled = [f"{i}{sign}" for n, signs in sizes for sign in signs for i in range(n)]
        return self.spelled


_coders: dict[int, Coder] = {}


def coder(given: Vocabularies) -> Coder:
    key = hash(given)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(given)
    return _coders[key]


# ---- links and groups of encoded texts -------------------------------------------------------


@dataclass
class Slice:
    """Some whole groups of one text, or the tokens of several whole texts, end to end."""

    a: np.ndarray
    b: np.ndarray
    a_stops: np.ndarray  # byte columns up to the end of each token
    b_stops: np.ndarray
    widths: np.ndarray  # bytes of each column
    a_groups: np.ndarray
    b_groups: np.ndarray
    n_groups: int
    owners: np.ndarray  # row of the batch of each group

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return overlap_links(self.a_stops, self.b_stops, self.widths)


def slices(ids_a: pa.Array, ids_b: pa.Array, given: Coder, limit: int = PIECE_TOKENS) -> Iterator[Slice]:
    """The encoded texts of a batch in slices of about ``limit`` A tokens, cut where tokens of both end."""
    (a, a_bounds), (b, b_bounds) = flat_ids(ids_a), flat_ids(ids_b)
    at = 0
    while at < len(ids_a):
        stop = max(at + 1, int(np.searchsorted(a_bounds, a_bounds[at] + limit, side="right")) - 1)
        x, y = slice(a_bounds[at], a_bounds[stop]), slice(b_bounds[at], b_bounds[stop])
        if x.start < x.stop:
            yield from _cut(at, a[x], b[y], a_bounds[at + 1 : stop + 1] - x.start, given, limit)
        at = stop


def flat_ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and where each row's begin (n + 1 places)."""
    _, offsets, data = ids.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype="<u4") if data is not None and data.size >= 4 else np.empty(0, dtype="<u4")
    return whole[bounds[0] // 4 : bounds[-1] // 4].astype(np.int64), (bounds - bounds[0]) // 4


def _cut(first: int, a: np.ndarray, b: np.ndarray, lasts: np.ndarray, given: Coder, limit: int) -> Iterator[Slice]:
    """Texts from ``first`` on; ``lasts`` holds the number of A tokens up to the end of each."""
    a_ends, b_ends = np.cumsum(given.a_sizes[a]), np.cumsum(given.b_sizes[b])
    # one merge of both lists of ends: where they meet, and every token's place among all ends
    meet = np.searchsorted(b_ends, a_ends)
    a_common = b_ends[meet] == a_ends
    b_common = np.zeros(len(b), dtype=bool)
    b_common[meet[a_common]] = True
    a_groups, b_groups = np.cumsum(a_common) - a_common, np.cumsum(b_common) - b_common
    a_places = np.arange(len(a)) + meet - a_groups
    only_b = np.ones(len(a) + len(b) - int(a_common.sum()), dtype=bool)
    only_b[a_places] = False
    b_places = np.empty(len(b), dtype=np.int64)
    b_places[b_common], b_places[~b_common] = a_places[a_common], np.flatnonzero(only_b)
    cuts = np.empty(len(only_b), dtype=np.int64)
    cuts[a_places], cuts[b_places] = a_ends, b_ends
    bounds = a_ends[a_common]
    owner = first + np.searchsorted(np.concatenate([[0], a_ends])[lasts], bounds)
    group_a = np.concatenate([[0], np.flatnonzero(a_common) + 1])
    group_b = np.concatenate([[0], np.flatnonzero(b_common) + 1])
    group_cuts = np.concatenate([[0], a_places[a_common] + 1])
    widths = np.diff(cuts, prepend=0)
    at = 0
    while at < len(bounds):
        stop = max(at + 1, int(np.searchsorted(group_a, group_a[at] + limit, side="right")) - 1)
        x, y, z = (slice(g[at], g[stop]) for g in (group_a, group_b, group_cuts))
        yield Slice(
            a[x], b[y], a_places[x] - z.start + 1, b_places[y] - z.start + 1, widths[z], a_groups[x] - at, b_groups[y] - at, stop - at, owner[at:stop]
        )
        at = stop


def group_codes(part: Slice, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in :meth:`Coder.names` of the slice's tokens in the order in which groups are written, and the group of each."""
    before_b = np.searchsorted(part.b_groups, part.a_groups)
    before_a = np.searchsorted(part.a_groups, part.b_groups, side="right")
    codes = np.empty(len(part.a) + len(part.b), dtype=np.int64)
    groups = np.empty_like(codes)
    last_a = np.append(np.diff(part.a_groups) != 0, True)
    last_b = np.append(np.diff(part.b_groups) != 0, True)
    a_at, b_at = np.arange(len(part.a)) + before_b, np.arange(len(part.b)) + before_a
    codes[a_at] = part.a + n_a * last_a
    codes[b_at] = 2 * n_a + part.b + n_b * last_b
    groups[a_at], groups[b_at] = part.a_groups, part.b_groups
    return codes, groups


# ---- operators -------------------------------------------------------------------------------


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def parts(sizes: np.ndarray, limit: int = TEXTS_LETTERS) -> Iterator[slice]:
    """Neighbouring rows whose sizes add up to about ``limit``; a longer row is a part of its own."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield slice(at, stop)
        at = stop


def _sizes(values: pa.Array) -> np.ndarray:
    """Bytes of each value, 0 where it is null."""
    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)


def tokenize(docs: DataFrame, given: Vocabularies, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, row, a, b): the ids of each text by both, and a number of its own for each input row; written once.

    Texts that are null or empty, or that B does not give back byte by byte, have no ids.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(given)
        for batch in batches:
            for part in parts(_sizes(batch.column(1))):
                found = code.encode(batch.column(1)[part].fill_null("").to_pylist())
                ids = [pa.array([f[i] for f in found], type=pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], *ids], names=["key", "a", "b"])

    rows = docs.select(_quoted(key).alias("key"), _quoted(text).alias("text")).mapInArrow(run, f"key {kind}, a binary, b binary")
    return handover(rows.select(F.col("key").alias(key), F.monotonically_increasing_id().alias("row"), "a", "b"), "tokens", BATCH_ROWS)


def link_rows(coded: DataFrame, given: Vocabularies) -> DataFrame:
    """(row, a_at, b_at, a_id, b_id): every overlap link of every text, positions counted from 0."""
    schema = "row long, a_at int, b_at int, a_id int, b_id int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(given)
        for batch in batches:
            numbers = batch.column("row").to_numpy()
            before: dict[int, tuple[int, int]] = {}
            for part in slices(batch.column("a"), batch.column("b"), code):
                x, y = part.links()
                rows = part.owners[part.a_groups[x]]
                first_a, first_b = _first_places(part, before)
                columns = [numbers[rows], x - first_a[rows], y - first_b[rows], part.a[x], part.b[y]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names=["row", "a_at", "b_at", "a_id", "b_id"]
                )

    return coded.select("row", "a", "b").mapInArrow(run, schema)


def _first_places(part: Slice, before: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """By row of the batch: what to take off a place in the slice to get the place in the text. ``before`` holds
    how many tokens of a text earlier slices had."""
    size = int(part.owners.max()) + 1
    firsts = []
    for side, groups in enumerate((part.a_groups, part.b_groups)):
        owner = part.owners[groups]
        counts = np.bincount(owner, minlength=size)
        earlier = np.zeros(size, dtype=np.int64)
        for row, seen in before.items():
            if row < size:
                earlier[row] = seen[side]
        firsts.append((np.cumsum(counts) - counts - earlier, counts))
    for row in np.unique(part.owners).tolist():
        seen = before.get(row, (0, 0))
        before[row] = (seen[0] + int(firsts[0][1][row]), seen[1] + int(firsts[1][1][row]))
    return firsts[0][0], firsts[1][0]


@dataclass
class PairCounts:
    """Corpus-wide link counts of id pairs: all of them as a table, the most frequent ones as sorted arrays, and
    the highest count of each B id (0: never linked)."""

    table: DataFrame
    head_pairs: np.ndarray
    head_counts: np.ndarray
    best: np.ndarray


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


def count_pairs(coded: DataFrame, given: Vocabularies, head: int = HEAD) -> PairCounts:
    """Count the linked id pairs of all texts; pairs are added up inside each batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(given)
        for batch in batches:
            for some in parts(_sizes(batch.column("a"))):
                for part in slices(batch.column("a")[some], batch.column("b")[some], code):
                    x, y = part.links()
                    pairs, counts = np.unique(_pairs(part.a[x], part.b[y]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    table = handover(coded.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs", BATCH_ROWS)
    first = table.orderBy(F.desc("n"), "pair").limit(head).toArrow()
    pairs, counts = first.column("pair").to_numpy(), first.column("n").to_numpy()
    order = np.argsort(pairs)
    highest = table.groupBy(F.expr("pair & 4294967295").cast("int").alias("b")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(len(coder(given).b_bytes), dtype=np.int64)
    best[highest.column("b").to_numpy()] = highest.column("n").to_numpy()
    return PairCounts(table, pairs[order], counts[order], best)


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_best", "count_sum")
TAIL = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64()), ("best", pa.int64())]))
RESULT = ", ".join(f"{name} long" for name in FIGURES) + ", groups string, tail array<struct<pair: long, n: long, best: long>>"


def _aligned(ids_a: pa.Array, ids_b: pa.Array, code: Coder, pairs: np.ndarray, numbers: np.ndarray, best: np.ndarray) -> list[pa.Array]:
    """Columns of RESULT for some encoded texts."""
    n = len(ids_a)
    figures = {name: np.zeros(n, dtype=np.int64) for name in FIGURES}
    spelled: list[list[str]] = [[] for _ in range(n)]
    tails: list[list[dict]] = [[] for _ in range(n)]
    names = code.names()
    for part in slices(ids_a, ids_b, code):
        x, y = part.links()
        owner_a = part.owners[part.a_groups]
        owner = owner_a[x]
        linked = _pairs(part.a[x], part.b[y])
        place = np.minimum(np.searchsorted(pairs, linked), max(len(pairs) - 1, 0))
        known = pairs[place] == linked if len(pairs) else np.zeros(len(linked), dtype=bool)
        count = np.where(known, numbers[place], 0) if len(pairs) else np.zeros(len(linked), dtype=np.int64)
        tops = known & (count == best[part.b[y]])
        for name, owners in (("n_a", owner_a), ("n_b", part.owners[part.b_groups]), ("n_groups", part.owners), ("n_links", owner), ("n_best", owner[tops])):
            figures[name] += np.bincount(owners, minlength=n)
        np.add.at(figures["n_group_links"], owner_a, shared_group_counts(part.a_groups, part.b_groups, part.n_groups))
        np.add.at(figures["count_sum"], owner, count)
        for row, pair, top in zip(owner[~known].tolist(), linked[~known].tolist(), best[part.b[y[~known]]].tolist(), strict=True):
            tails[row].append({"pair": pair, "n": 1, "best": top})
        codes, group = group_codes(part, len(code.a_bytes), len(code.b_bytes))
        edges = np.flatnonzero(np.diff(part.owners[group], prepend=-1, append=-1))
        places, written = edges.tolist(), list(map(names.__getitem__, codes.tolist()))
        for row, start, stop in zip(part.owners[group[edges[:-1]]].tolist(), places[:-1], places[1:], strict=True):
            spelled[row].append("".join(written[start:stop]))
    texts = pa.array(["".join(t)[:-1] for t in spelled], type=pa.string())
    return [*(pa.array(figures[name]) for name in FIGURES), texts, pa.array(tails, type=TAIL)]


def align(
    coded: DataFrame,
    given: Vocabularies,
    counts: PairCounts,
    key: str = "doc_id",
    groups: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """One row per row of ``coded``: ``key``, the figures, and ``groups``.

    ``n_group_links`` counts the token pairs inside shared groups, ``n_best`` the links whose pair is the most
    frequent one of its B id, ``count_sum`` adds up the corpus-wide counts of all links. ``groups`` lists the ids
    as ``a1,a2|b1;a3|b2,b3``; a caller may reduce it before it moves by a column function. Rows without tokens
    (null, empty or not given back byte by byte) have zeros and an empty list. Repeated rows are scored each
    by itself; ties of the highest count all count as best; an empty table gives none.
    """
    spark = coded.sparkSession
    held = spark.sparkContext.broadcast((counts.head_pairs, counts.head_counts, counts.best))

    kind = coded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(given)
        for batch in batches:
            for part in parts(_sizes(batch.column(2))):
                some = batch.slice(part.start, part.stop - part.start)
                columns = _aligned(some.column(2), some.column(3), code, *held.value)
                yield pa.RecordBatch.from_arrays([*some.columns[:2], *columns], names=["key", "row", *FIGURES, "groups", "tail"])

    first = coded.select(_quoted(key).alias("key"), "row", "a", "b").mapInArrow(run, f"key {kind}, row long, {RESULT}")
    first = handover(first.withColumn("groups", groups(F.col("groups"))), "aligned", BATCH_ROWS)
    rare = first.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    met = rare.join(counts.table.withColumnRenamed("n", "total").hint("merge"), "pair")
    late = met.groupBy("row").agg(
        F.sum(F.col("n") * F.col("total")).alias("late_sum"), F.sum(F.when(F.col("total") == F.col("best"), F.col("n")).otherwise(0)).alias("late_best")
    )
    joined = first.drop("tail").join(late.hint("merge"), "row", "left")
    added = {"n_best": F.col("n_best") + F.coalesce("late_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("late_sum", F.lit(0))}
    return joined.withColumns(added).select(F.col("key").alias(key), *FIGURES, "groups")
