"""Words of whole Arrow batches as flat numpy arrays.

A piece is a run of neighbouring texts, bounded in bytes (one longer text makes a piece of its own), so
that the arrays of a task stay small whatever the batch size. Words are runs of bytes other than 0x20 and
0x09-0x0D; they never cross from one text into the next. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def _power_table(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the hash base or of its inverse, modulo 2**64; kept between pieces."""
    table = _powers[kind]
    if len(table) < n:
        step = BASE if kind == "up" else _INVERSE
        table = np.full(max(n, PIECE_BYTES + 64), step, dtype=U64)
        table[0] = 1
        np.cumprod(table, out=table)
        if len(table) <= 16 * PIECE_BYTES:
            _powers[kind] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair, from one prefix sum (independent of the place)."""
    n = len(values)
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum((values.astype(U64) + U64(1)) * _power_table("up", n)[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _power_table("down", n + 1)[starts] + (ends - starts).astype(U64))


@dataclass
class Piece:
    """Neighbouring texts: ``first`` is the row of the first one in its batch."""

    first: int
    flat: np.ndarray  # uint8, all texts end to end
    offsets: np.ndarray  # int64, n + 1 places in flat

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.flat[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    starts: np.ndarray  # byte places in flat
    ends: np.ndarray
    bounds: np.ndarray  # n + 1: words of text i are bounds[i]..bounds[i+1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string column into pieces of at most ``limit`` bytes, or single longer texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.fill_null("").cast(pa.large_string())
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), len(texts))
        yield Piece(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def find_words(piece: Piece) -> Words:
    flat, offsets = piece.flat, piece.offsets
    if len(flat) == 0:
        return Words(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = IS_WORD[flat]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    at, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[at] = inside[at]
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def joined_words(piece: Piece, words: Words, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words joined by single spaces, and each word's place in that buffer."""
    lengths = words.ends - words.starts
    places = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=places[1:])
    keep = np.zeros(len(piece.flat) + 1, dtype=bool)
    keep[:-1] = IS_WORD[piece.flat]
    out = np.full(int(places[-1]), 0x20, dtype=np.uint8)
    spaces = np.zeros(len(out), dtype=bool)
    spaces[places[1:] - 1] = True
    source = piece.flat[keep[:-1]]
    out[~spaces] = LOWER[source] if lower else source
    return out, places[:-1], places[1:] - 1


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds (0 where there is none)."""
    prefix = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=prefix[1:])
    return prefix[bounds[1:]] - prefix[bounds[:-1]]
