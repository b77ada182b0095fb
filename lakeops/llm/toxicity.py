"""Toxic documents by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled set is a sample of all documents whatever their
label. The risk of a linear classifier over presence features is estimated as
prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)); where the estimate of the negative
part turns below zero its gradient is reversed, so that it cannot be fitted away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.features import Adam, Sample, collect_sample, labelled, sigmoid
from lakeops.llm.shared import fold
from lakeops.llm.words import LOWER, U64, Piece, mix, pieces, range_hashes, sums

BITS = 20
PREFIXES = (4, 5, 6, 7)  # bytes of a word's beginning that are features beside the whole word
POSITIVES, UNLABELLED = 2000, 4000  # documents in the sample the classifier is fitted on
SELECTED = 1024  # features kept, by how much more positives have them
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def presence(piece: Piece, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once: lower-cased letter runs and their beginnings, hashed.

    With ``known`` (a flag per feature) only those features are looked at.
    """
    flat = LOWER[piece.flat]
    inside = LETTER[flat]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = piece.offsets[:-1] < piece.offsets[1:]
    at, last = piece.offsets[:-1][filled], piece.offsets[1:][filled] - 1
    begins[at] = inside[at]
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    owner = np.searchsorted(piece.offsets, starts, side="right") - 1
    keys = [(range_hashes(flat, starts, ends), owner)]
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        keys.append((mix(range_hashes(flat, starts[longer], starts[longer] + size) + U64(size)), owner[longer]))
    feature = np.concatenate([k >> U64(64 - BITS) for k, _ in keys]).astype(np.int64)
    text = np.concatenate([o for _, o in keys])
    if known is not None:
        kept = known[feature]
        feature, text = feature[kept], text[kept]
    pairs = np.unique((text << BITS) | feature)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _presence_rows(piece: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    text, feature = presence(piece)
    bounds = np.searchsorted(text, np.arange(len(piece) + 1))
    for i in range(len(piece)):
        own = feature[bounds[i] : bounds[i + 1]]
        yield own.astype(np.int32), np.ones(len(own), dtype=np.float32)


@dataclass
class ToxicityModel:
    """Weights of the selected features (all others weigh 0) and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.features] = self.weights
        return out


def select_features(sample: Sample, limit: int = SELECTED) -> np.ndarray:
    """Features that positives have more often than the unlabelled, by the z value of the two shares."""
    spread = np.repeat(sample.labels, np.diff(sample.bounds))
    n_p, n_u = max(int((sample.labels == 1).sum()), 1), max(int((sample.labels == 0).sum()), 1)
    p = np.bincount(sample.at[spread == 1], minlength=1 << BITS)
    u = np.bincount(sample.at[spread == 0], minlength=1 << BITS)
    pooled = (p + u + 1) / (n_p + n_u + 2)
    z = (p / n_p - u / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    best = np.argsort(-z, kind="stable")[:limit]
    return np.sort(best[(z[best] > 5) & (p[best] >= 3)])


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic-loss nnPU by full gradients; ``x`` has a row per document, 1 where it has a feature."""
    weights, bias, adam = np.zeros(x.shape[1]), np.log(prior / (1 - prior)), Adam(x.shape[1] + 1, rate)
    pos, unl = x[positive], x[~positive]
    for _ in range(steps):
        g_p, g_u = pos @ weights + bias, unl @ weights + bias
        negative_risk = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        d_positive = -prior * sigmoid(-g_p) / len(g_p)
        d_negative_u, d_negative_p = sigmoid(g_u) / len(g_u), -prior * sigmoid(g_p) / len(g_p)
        if negative_risk >= 0:
            d_p, d_u = d_positive + d_negative_p, d_negative_u
        else:
            d_p, d_u = -d_negative_p, -d_negative_u
        gradient = np.append(d_p @ pos + d_u @ unl + penalty * weights, d_p.sum() + d_u.sum())
        move = adam.step(gradient)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", modulus: int | None = 5,
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> ToxicityModel:
    """Fit on bounded samples of the learning fold: confirmed positives, and any documents as unlabelled.

    The class prior is the share of the label among all labelled rows of the fold. Without a positive or
    an unlabelled document every text scores the prior (0 where that is unknown).
    """
    rows = labelled(labels, label, id_column, modulus)
    prior = rows.agg(F.avg("label")).first()[0] or 0.0
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    everyone = docs.select(F.col(id_column).alias("id")).filter("id is not null")
    if modulus:
        everyone = everyone.filter(fold(F.col("id"), modulus) != 0)
    toxic = rows.filter("label = 1").orderBy(*order).limit(positives)
    drawn = everyone.orderBy(*order).limit(unlabelled).select("id", F.lit(0).alias("label"))
    sample = collect_sample(docs, toxic.unionByName(drawn.dropDuplicates(["id"])), _presence_rows, id_column)
    prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
    features = select_features(sample)
    if len(np.unique(sample.labels)) < 2 or not len(features):
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))))
    column = np.full(1 << BITS, -1)
    column[features] = np.arange(len(features))
    x = np.zeros((len(sample), len(features)), dtype=np.float32)
    row, at = np.repeat(np.arange(len(sample)), np.diff(sample.bounds)), column[sample.at]
    x[row[at >= 0], at[at >= 0]] = 1
    weights, bias = fit_nnpu(x, sample.labels == 1, prior)
    return ToxicityModel(features, weights, bias)


def toxicity_score(text: Column | str, model: ToxicityModel) -> Column:
    """Score 0 to 1 of a text. Null and empty texts have no features and score by the intercept alone;
    texts may have any length."""

    def run(texts: pa.Array) -> pa.Array:
        table = model.table()
        known = table != 0
        parts = []
        for piece in pieces(texts):
            owner, feature = presence(piece, known)
            parts.append(sums(table[feature], np.searchsorted(owner, np.arange(len(piece) + 1))))
        return pa.array(sigmoid(np.concatenate(parts) + model.bias) if parts else np.empty(0), type=pa.float64())

    return F.arrow_udf(run, "double")(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; rows repeat as in the input, null ids stay."""
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    scored = rows.select(id_column, toxicity_score("text", model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
