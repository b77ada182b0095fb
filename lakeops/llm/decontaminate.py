"""Benchmark passages in documents: item-sized windows, SimHash candidates, exact weighted similarity.

The benchmark is cut into blocks of bounded size by a hash of its rows; one block's index travels to the
tasks at a time, so that any number of items is handled alike. A window can only be similar to an item when
they share a shingle: those places anchor the windows. Every item-sized window around an anchor gets a
SimHash; a multi-index of eight 8-bit blocks finds all items within the radius (if at most 23 bits differ,
some block differs in at most 2), and each candidate is then compared exactly.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.words import LOWER, U64, Piece, find_words, pieces, range_hashes

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS = 8
BLOCK_FLIPS = 2
RADIUS = BLOCKS * (BLOCK_FLIPS + 1) - 1  # 23: the pigeonhole guarantee of the blocks
BLOCK_BYTES = 4 << 20  # benchmark text in one block of items
FILTER_BITS = 22
COLUMNS = "item_id: bigint, first_word: bigint, n_words: bigint, hamming: int, similarity: double"
POPCOUNT = np.array([bin(v).count("1") for v in range(256)], dtype=np.uint8)
CLOSE = POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= BLOCK_FLIPS


def _lowered(piece: Piece) -> tuple:
    words = find_words(piece)
    return words, range_hashes(LOWER[piece.flat], words.starts, words.ends)


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; they may cross texts, callers mask those."""
    at = np.arange(max(len(word_hashes) - size + 1, 0))
    return range_hashes(word_hashes, at, at + size)


def _signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return bits.astype(np.int32) * 2 - 1


def _packed(totals: np.ndarray) -> np.ndarray:
    return np.packbits(totals > 0, axis=1)  # eight bytes, one per block


class Items:
    """Index of one block of benchmark items; items without a word are no passages and are left out."""

    def __init__(self, rows: list[tuple[int, str]], size: int):
        self.ids, self.counts, self.lengths, prints, self.size = [], [], [], [], size
        places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            piece = next(pieces(pa.array([text], pa.string())), None)
            words, hashes = _lowered(piece) if piece else (None, np.empty(0, dtype=U64))
            if not len(hashes):
                continue
            width = min(size, len(hashes))
            shingles = shingle_hashes(hashes, width)
            item = len(self.ids)
            self.ids.append(item_id)
            self.lengths.append(len(hashes))
            self.counts.append(Counter(shingles.tolist()))
            prints.append(_packed(_signs(shingles).sum(axis=0)[None, :])[0])
            for at, h in enumerate(shingles.tolist()):
                places[width][h].append((item, at))
        self.lengths = np.array(self.lengths, dtype=np.int64)
        self.prints = np.array(prints, dtype=np.uint8).reshape(-1, BLOCKS)
        self.of_length = {int(n): np.flatnonzero(self.lengths == n) for n in np.unique(self.lengths)}
        self.places = {width: dict(found) for width, found in places.items()}
        self.known = {width: np.sort(np.fromiter(found, dtype=U64, count=len(found))) for width, found in places.items()}
        self.filters = {}
        for width, known in self.known.items():
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[known >> U64(64 - FILTER_BITS)] = True
            self.filters[width] = bits
        # per length and block: which items have a block within BLOCK_FLIPS bits of a value
        self.tables = {
            n: [CLOSE[:, self.prints[items, b]] for b in range(BLOCKS)] for n, items in self.of_length.items()
        }

    def anchors(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        shingles = shingle_hashes(hashes, width)
        at = np.flatnonzero(self.filters[width][shingles >> U64(64 - FILTER_BITS)])
        known = self.known[width]
        slot = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
        at = at[known[slot] == shingles[at]]
        return at, shingles[at]

    def within_radius(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs of windows and items of n words within the radius."""
        items = self.of_length[n]
        hit = reduce(np.logical_or, (self.tables[n][b][prints[:, b]] for b in range(BLOCKS)))
        window, slot = np.nonzero(hit)
        distance = POPCOUNT[prints[window] ^ self.prints[items[slot]]].sum(axis=1, dtype=np.int64)
        near = distance <= RADIUS
        return window[near], items[slot[near]], distance[near]


def similarity(counts: Counter, shingles: list[int]) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    window = Counter(shingles)
    common = sum(min(k, counts[h]) for h, k in window.items() if h in counts)
    return common / (len(shingles) + counts.total() - common)


def _scan_document(index: Items, hashes: np.ndarray, anchors: list[tuple[int, int, int]], threshold: float) -> Iterator[tuple]:
    """Best window of every item that is similar enough, from (word, width, shingle) anchors of one text."""
    total = len(hashes)
    reach: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for at, width, shingle in anchors:
        for item, _ in index.places[width][shingle]:
            n = int(index.lengths[item])
            size = min(n, total)
            reach[n, width].append((max(0, at + width - size), min(at, total - size)))
    best: dict[int, tuple] = {}
    for (n, width), spans in reach.items():
        size = min(n, total)
        spans = sorted(set(spans))
        merged = [list(spans[0])]
        for lo, hi in spans[1:]:
            if lo <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        for lo, hi in merged:
            shingles = shingle_hashes(hashes[lo : hi + size], width)
            prefix = np.zeros((len(shingles) + 1, 64), dtype=np.int32)
            np.cumsum(_signs(shingles), axis=0, out=prefix[1:])
            per_window, starts = size - width + 1, np.arange(hi - lo + 1)
            prints = _packed(prefix[starts + per_window] - prefix[starts])
            known = shingles.tolist()
            for window, item, distance in zip(*(x.tolist() for x in index.within_radius(prints, n)), strict=True):
                found = similarity(index.counts[item], known[window : window + per_window])
                if found >= threshold:
                    row = (-found, lo + window, size, distance)
                    best[item] = min(best.get(item, row), row)
    for item, (found, first, size, distance) in best.items():
        yield index.ids[item], first, size, distance, -found


def _matches(index: Items, piece: Piece, threshold: float) -> Iterator[tuple]:
    words, hashes = _lowered(piece)
    anchors: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for width in index.known:
        at, shingles = index.anchors(hashes, width)
        owner = np.searchsorted(words.bounds, at, side="right") - 1
        inside = at + width <= words.bounds[owner + 1]
        for row, place, shingle in zip(owner[inside].tolist(), (at - words.bounds[owner])[inside].tolist(), shingles[inside].tolist(), strict=True):
            anchors[row].append((place, width, shingle))
    for row, found in anchors.items():
        for match in _scan_document(index, hashes[words.bounds[row] : words.bounds[row + 1]], found, threshold):
            yield piece.first + row, *match


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, item_id, first_word, n_words, hamming, similarity): for each row of ``docs`` and each item with
    a similar window, the best window (the first one on ties).

    Words are lower-cased (A-Z); a text with fewer words than an item is one window; items of fewer words
    than ``size`` are one shingle. Null and empty texts and items match nothing. Repeated rows match each
    on their own; a null id is carried. An empty table on either side gives no rows.
    """
    items = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(item_text).alias("passage")).filter("passage is not null")
    total = items.agg(F.sum(F.octet_length("passage") + 16)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    of_block = F.pmod(F.xxhash64("item", "passage"), F.lit(n_blocks))
    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def scan(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Items(block, size)
            for batch in batches:
                found = [m for piece in pieces(batch.column(1)) for m in _matches(index, piece, threshold)] if index.ids else []
                if found:
                    row, item, first, n, hamming, like = (list(c) for c in zip(*found, strict=True))
                    ids = batch.column(0).take(pa.array(row))
                    columns = [ids, pa.array(item, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()),
                               pa.array(hamming, pa.int32()), pa.array(like, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "item_id", "first_word", "n_words", "hamming", "similarity"])

        return rows.mapInArrow(run, f"id: {id_type}, {COLUMNS}")

    parts = [scan([tuple(r) for r in items.filter(of_block == b).distinct().collect()]) for b in range(n_blocks)]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_column)


