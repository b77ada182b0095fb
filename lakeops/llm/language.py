"""Language of texts by nearest centroid: TF-IDF vectors of letter n-grams, several centroids a language.

Document frequencies cover all labelled texts. The centroids of a language are found by spherical k-means
on a bounded sample of its texts, one language per group. A text gets the language of the centroid with the
highest cosine; it is rejected where its distance is beyond the radius of that centroid, a quantile of the
distances of all learning texts of the language that are nearest to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.shared import fold, handover
from lakeops.llm.words import LOWER, Piece, pieces

BITS = 12
SIZE = 1 << BITS
ORDERS = (2, 3, 4)  # bytes per n-gram; a word's n-grams include the space on either side
CENTROIDS = 4
PER_LANGUAGE = 400  # texts of each language in the sample the centroids are fitted on
RADIUS_QUANTILE = 0.995  # share of a centroid's learning texts within its rejection radius
UNKNOWN = "und"
LETTERS = np.full(256, 0x20, dtype=np.uint8)
LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTERS[0x80:] = np.arange(0x80, 0x100)
MAX_SAMPLE_ROWS = 1 << 20
MAX_MODEL_BYTES = 512 << 20  # refuse a model beyond this rather than ship it


def counts(piece: Piece) -> np.ndarray:
    """Texts x SIZE counts of hashed n-grams; everything but letters (bytes beyond ASCII too) is a space."""
    n = len(piece)
    padded = piece.offsets + np.arange(n + 1)  # one space before each text and one at the end
    flat = np.full(int(piece.offsets[-1]) + n + 1, 0x20, dtype=np.uint8)
    inside = np.ones(len(flat), dtype=bool)
    inside[padded] = False
    flat[inside] = LETTERS[LOWER[piece.flat]]
    codes = flat.astype(np.uint32)
    owner = np.repeat(np.arange(n) << BITS, np.diff(padded))
    total = np.zeros(n << BITS, dtype=np.int64)
    gram = codes
    for order in range(2, max(ORDERS) + 1):
        gram = gram[:-1] | (codes[order - 1 :] << np.uint32(8 * (order - 1)))
        if order in ORDERS:
            mixed = (gram ^ np.uint32(order * 0x27D4EB2F)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed = mixed * np.uint32(0x85EBCA77)
            # none that begins with two spaces; one past the end of a text covers only the space between
            keep = (flat[: len(gram)] != 0x20) | (flat[1 : len(gram) + 1] != 0x20)
            if order > 2:
                keep &= owner[: len(gram)] == owner[order - 2 :][: len(gram)]
            cell = owner[: len(gram)][keep] + (mixed[keep] >> np.uint32(32 - BITS))
            total += np.bincount(cell, minlength=n << BITS)
    return total.reshape(n, SIZE)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised rows of (1 + log count) times inverse document frequency."""
    x = np.zeros(found.shape, dtype=np.float32)
    np.log(found, out=x, where=found > 0)
    x += found > 0
    x *= idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def small_pieces(texts: pa.Array) -> Iterator[Piece]:
    """Pieces of at most 64 KB, or one longer text, and 64 texts."""
    for piece in pieces(texts, 1 << 16):
        for at in range(0, len(piece), 64):
            part = piece.offsets[at : at + 65]
            yield Piece(piece.first + at, piece.flat[part[0] : part[-1]], part - part[0])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from texts spread evenly over the similarities with the mean."""
    if not len(x):
        return np.zeros((0, SIZE), dtype=np.float32)
    k = min(k, len(x))
    ranked = np.argsort(x @ x.mean(axis=0), kind="stable")
    centroids = x[ranked[(2 * np.arange(k) + 1) * len(x) // (2 * k)]]
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[nearest == c].sum(axis=0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = (sums / np.where(norm > 0, norm, 1)).astype(np.float32)
    return centroids


@dataclass
class LanguageModel:
    languages: list[str]  # one per centroid
    centroids: np.ndarray  # rows of unit length
    radii: np.ndarray  # largest accepted distance, one per centroid
    idf: np.ndarray


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Number of texts with each hashed n-gram, and of all texts, over the whole column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, dtype=np.int64), 0
        for batch in batches:
            for piece in small_pieces(batch.column(0)):
                total += (counts(piece) > 0).sum(axis=0)
                n += len(piece)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1), pa.int32()), pa.array(np.append(total, n))], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(SIZE + 1, dtype=np.int64)
    for r in rows:
        found[r["bucket"]] = r["n"]
    return found[:-1], int(found[-1])


def learning_distances(rows: DataFrame, languages: list[str], centroids: np.ndarray, idf: np.ndarray) -> DataFrame:
    """(c, bits) of every row: the nearest centroid of the row's own language, and the bits of the distance
    to it as a 32-bit float, which order like the distance. Rows of a language without a centroid are left out."""
    own = {name: np.array([c for c, other in enumerate(languages) if other == name]) for name in set(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for piece in small_pieces(batch.column(0)):
                like = vectors(counts(piece), idf) @ centroids.T
                known = [(i, own[name]) for i, name in enumerate(names[piece.first : piece.first + len(piece)]) if name in own]
                at = np.array([among[like[i, among].argmax()] for i, among in known], dtype=np.int32)
                far = 1 - np.clip(like[[i for i, _ in known], at], 0, 1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(far.view(np.int32))], ["c", "bits"])

    return rows.select("text", "lang").mapInArrow(run, "c int, bits int")


def learning_radii(rows: DataFrame, languages: list[str], centroids: np.ndarray, idf: np.ndarray, share: float = RADIUS_QUANTILE) -> np.ndarray:
    """Per centroid the least distance within which ``share`` of its learning texts lie; 0 where it has none.

    Exact over all rows: distances are counted by the upper half of their bits, then by the lower half
    inside the upper half at which the share is reached, so that only counts reach the driver."""
    radii = np.zeros(len(languages), dtype=np.float32)
    if not languages:
        return radii.astype(np.float64)
    distances = handover(learning_distances(rows, languages, centroids, idf), "distances")
    high, low = F.shiftright("bits", 16), F.col("bits").bitwiseAND(F.lit(0xFFFF))

    def counted(found: DataFrame, half: Column) -> dict[int, list[tuple[int, int]]]:
        out: dict[int, list[tuple[int, int]]] = {}
        for r in found.groupBy("c", half.alias("half")).count().collect():
            out.setdefault(r["c"], []).append((r["half"], r["count"]))
        return {c: sorted(halves) for c, halves in out.items()}

    def reached(halves: list[tuple[int, int]], needed: int) -> tuple[int, int]:
        for half, n in halves:
            if n >= needed:
                return half, needed
            needed -= n
        raise AssertionError("fewer rows than were counted")

    upper = counted(distances, high)
    at = {c: reached(halves, max(int(np.ceil(share * sum(n for _, n in halves))), 1)) for c, halves in upper.items()}
    if at:
        chosen = distances.sparkSession.createDataFrame([(c, h) for c, (h, _) in at.items()], "c int, high int")
        inside = distances.withColumn("high", high).join(F.broadcast(chosen), ["c", "high"])  # one row a centroid
        for c, halves in counted(inside, low).items():
            half, needed = at[c]
            radii[c] = np.int32(half << 16 | reached(halves, needed)[0]).view(np.float32)
    return radii.astype(np.float64)


def fit_languages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
    modulus: int | None = 5, k: int = CENTROIDS, per_language: int = PER_LANGUAGE,
) -> LanguageModel:
    """Learn from rows with text and language whose id's crc32 modulo ``modulus`` is not 0."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    if modulus:
        rows = rows.filter(fold(F.col("id"), modulus) != 0)
    frequency, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + np.float32(0.1)
    keys = rows.select("id", "lang", F.xxhash64(F.col("id").cast("string"), "lang").alias("h"))
    drawn = keys.withColumn("part", F.pmod("h", F.lit(64)))  # a language's texts meet in two steps
    for level in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*level).orderBy("h", "id"))
        drawn = drawn.withColumn("rank", rank).filter(F.col("rank") <= per_language)
    drawn = handover(drawn.select("id", "lang").distinct(), "drawn")
    if drawn.count() > MAX_SAMPLE_ROWS:
        raise ValueError(f"more than {MAX_SAMPLE_ROWS} sample rows: fewer per language are needed for so many languages")

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array(group["text"].sort_values(kind="stable"), type=pa.string())
        x = np.concatenate([vectors(counts(piece), idf) for piece in small_pieces(texts)])
        centroids = spherical_kmeans(x, k)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "c": range(len(centroids)), "centroid": list(centroids)})

    sample = rows.join(F.broadcast(drawn), ["id", "lang"]).select("lang", "text")  # at most MAX_SAMPLE_ROWS keys
    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, c int, centroid array<float>")
    parts = found.collect()
    if len(parts) * SIZE * 4 > MAX_MODEL_BYTES:
        raise ValueError(f"{len(parts)} centroids exceed the model bound of {MAX_MODEL_BYTES} bytes")
    parts.sort(key=lambda r: (r["lang"], r["c"]))
    centroids = np.array([r["centroid"] for r in parts], dtype=np.float32).reshape(-1, SIZE)
    languages = [r["lang"] for r in parts]
    return LanguageModel(languages, centroids, learning_radii(rows, languages, centroids, idf), idf)


def language(text: Column | str, model: LanguageModel) -> Column:
    """Struct (nearest, score, distance, rejected) of a text.

    ``score`` is the cosine with the nearest centroid, clipped to 0..1; equal cosines go to the first
    language by name. Null texts, texts without a letter and all texts under an empty model are ``und``
    with score 0 and rejected. Whole texts of any length count.
    """
    kind = pa.struct([("centroid", pa.int32()), ("score", pa.float64())])

    def run(texts: pa.Array) -> pa.Array:
        at, score = [np.empty(0, np.int32)], [np.empty(0)]
        for piece in small_pieces(texts):
            like = vectors(counts(piece), model.idf) @ model.centroids.T
            best = like.argmax(axis=1)
            at.append(best.astype(np.int32))
            score.append(np.clip(like[np.arange(len(best)), best].astype(np.float64), 0, 1))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(score))], fields=list(kind))

    known = F.col(text) if isinstance(text, str) else text
    letter = F.coalesce(known.rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return F.struct(F.lit(UNKNOWN).alias("nearest"), F.lit(0.0).alias("score"), F.lit(1.0).alias("distance"), F.lit(True).alias("rejected"))
    found = F.arrow_udf(run, "struct<centroid: int, score: double>")(text)
    names, radii = F.array(*map(F.lit, model.languages)), F.array(*map(F.lit, model.radii.tolist()))
    score = F.when(letter, found["score"]).otherwise(0.0)
    return F.struct(
        F.when(letter, names[found["centroid"]]).otherwise(UNKNOWN).alias("nearest"),
        score.alias("score"),
        (1 - score).alias("distance"),
        (~letter | (1 - score > radii[found["centroid"]])).alias("rejected"),
    )


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang, nearest, score, rejected) of every row: ``lang`` is the nearest language, or ``und``
    where the text is rejected. Rows repeat as in the input, null ids stay."""
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    found = rows.select(id_column, language("text", model).alias("v"))
    lang = F.when(F.col("v.rejected"), UNKNOWN).otherwise(F.col("v.nearest"))
    return found.select(id_column, lang.alias("lang"), "v.nearest", "v.score", "v.rejected")
