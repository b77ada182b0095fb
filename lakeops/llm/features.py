"""Hashed word and byte n-grams of whole pieces, and bounded labelled samples to learn from."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.shared import fold
from lakeops.llm.words import U64, Piece, Words, find_words, mix, pieces, range_hashes, sums

BITS = 14
GRAM_BYTES = 4


@dataclass
class Grams:
    """One kind of n-gram: a bucket per gram, and the bounds of each text's grams."""

    buckets: np.ndarray
    bounds: np.ndarray


def _clipped(bounds: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the places of a text at which a run of ``cut`` + 1 still fits."""
    return bounds[:-1], np.maximum(bounds[1:] - cut, bounds[:-1])


def _grams(buckets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Grams:
    counts = ends - starts
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=bounds[1:])
    keep = np.zeros(len(buckets) + 1, dtype=np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    return Grams(buckets[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)], bounds)


def quality_grams(piece: Piece, words: Words | None = None, hashes: np.ndarray | None = None) -> list[Grams]:
    """Words, neighbouring word pairs (a repeated word is one and the same pair) and 4-byte n-grams."""
    words = words or find_words(piece)
    if hashes is None:
        hashes = range_hashes(piece.flat, words.starts, words.ends)
    shift = U64(64 - BITS)
    single = Grams((hashes >> shift).astype(np.int64), words.bounds)
    pairs = np.zeros(len(hashes), dtype=np.int64)
    if len(hashes) > 1:
        pairs[:-1] = mix(hashes[:-1] ^ hashes[1:]) >> shift
    pair = _grams(pairs, *_clipped(words.bounds, 1))
    flat = piece.flat.astype(np.uint32)
    codes = np.zeros(len(flat), dtype=np.uint32)
    n = len(flat) - GRAM_BYTES + 1
    if n > 0:
        for i in range(GRAM_BYTES):
            codes[:n] |= flat[i : n + i] << np.uint32(8 * i)
    codes = codes * np.uint32(0x9E3779B1)
    codes ^= codes >> np.uint32(15)
    codes = codes * np.uint32(0x85EBCA77)
    grams = _grams((codes >> np.uint32(32 - BITS)).astype(np.int64), *_clipped(piece.offsets, GRAM_BYTES - 1))
    return [single, pair, grams]


N_KINDS = 3
DIMENSIONS = N_KINDS << BITS
SCALE = 32.0


def linear_scores(kinds: list[Grams], weights: np.ndarray) -> np.ndarray:
    """Per text the sum over kinds of the mean weight of its grams (0 where it has none), times SCALE."""
    total = 0.0
    for k, grams in enumerate(kinds):
        own = weights[k << BITS : (k + 1) << BITS]
        total = total + sums(own[grams.buckets], grams.bounds) / np.maximum(np.diff(grams.bounds), 1)
    return SCALE * total


def sparse_rows(kinds: list[Grams]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dimensions, values) of each text; its product with weights equals ``linear_scores``."""
    for i in range(len(kinds[0].bounds) - 1):
        at, values = [], []
        for k, grams in enumerate(kinds):
            own = grams.buckets[grams.bounds[i] : grams.bounds[i + 1]]
            found, counts = np.unique(own, return_counts=True)
            at.append(found + (k << BITS))
            values.append(SCALE * counts / max(len(own), 1))
        yield np.concatenate(at).astype(np.int32), np.concatenate(values).astype(np.float32)


@dataclass
class Sample:
    """Labelled sparse rows, end to end."""

    labels: np.ndarray
    at: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.labels)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return sums(self.values * weights[self.at], self.bounds)

    def gradient(self, per_row: np.ndarray, size: int) -> np.ndarray:
        spread = np.repeat(per_row, np.diff(self.bounds))
        return np.bincount(self.at, weights=spread * self.values, minlength=size)

    def select(self, rows: np.ndarray) -> Sample:
        lengths = np.diff(self.bounds)[rows]
        bounds = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum(lengths, out=bounds[1:])
        take = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.bounds[rows], lengths)
        return Sample(self.labels[rows], self.at[take], self.values[take], bounds)


def labelled(labels: DataFrame, label: str, id_column: str = "doc_id", modulus: int | None = 5) -> DataFrame:
    """(id, label) of the learning fold: ids whose crc32 modulo ``modulus`` is not 0, label 0 or 1; of
    contradicting repeated rows the larger label counts."""
    rows = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    if modulus:
        rows = rows.filter(fold(F.col("id"), modulus) != 0)
    return rows.groupBy("id").agg(F.max("label").alias("label"))


def bounded_sample(rows: DataFrame, per_label: int) -> DataFrame:
    """Up to ``per_label`` rows of each of the labels 0 and 1, by the hash of their id."""
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    parts = [rows.filter(F.col("label") == v).orderBy(*order).limit(per_label) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def collect_sample(
    docs: DataFrame,
    chosen: DataFrame,
    extract: Callable[[Piece], Iterator[tuple[np.ndarray, np.ndarray]]],
    id_column: str = "doc_id",
    text_column: str = "text",
) -> Sample:
    """Sparse rows of the chosen documents (a bounded number of rows, so the join broadcasts them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                rows = list(extract(piece))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, len(piece)),
                        pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                        pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                    ],
                    ["label", "at", "values"],
                )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "id")
    found = rows.select("label", "text").mapInArrow(run, "label int, at array<int>, values array<float>").toArrow()
    at = found.column("at").combine_chunks()
    lengths = np.array([0, *at.value_lengths().to_pylist()], dtype=np.int64) if len(at) else np.zeros(1, np.int64)
    order = np.argsort([hash_row(a) for a in at], kind="stable") if len(at) else np.empty(0, np.int64)
    sample = Sample(
        found.column("label").to_numpy(),
        at.flatten().to_numpy(),
        found.column("values").combine_chunks().flatten().to_numpy(),
        np.cumsum(lengths),
    )
    return sample.select(order)  # the same order whatever task came first


def hash_row(row: pa.Scalar) -> int:
    at = row.values.to_numpy() if row.values is not None else np.empty(0, np.int32)
    return int(range_hashes(at.astype(U64), np.array([0]), np.array([len(at)]))[0] >> U64(1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


class Adam:
    """Step sizes by running moments of the gradient."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
