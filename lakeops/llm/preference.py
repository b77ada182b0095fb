"""Document quality by pairwise ranking: a Bradley-Terry model over hashed n-grams.

A pair is a document labelled 1 preferred to one labelled 0; the probability of the preference is the
logistic function of the difference of their scores, so the loss works on feature differences and has no
intercept. The cut between good and bad is a quantile of the scores of all labelled rows of the learning fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.features import (
    DIMENSIONS, Adam, Sample, bounded_sample, collect_sample, labelled, linear_scores, quality_grams, sigmoid, sparse_rows,
)
from lakeops.llm.shared import handover
from lakeops.llm.words import pieces

PER_LABEL = 1000  # labelled rows of each label in the sample the pairs are drawn from
PAIRS = 4000  # preference pairs of one step
STEPS = 60
CUT = 0.3  # the score that the quantile is mapped to
BINS = 4096  # counts of one step towards a quantile


@dataclass
class RankingModel:
    """Ranking weights; ``cut`` is the raw score of the quantile and becomes the score CUT."""

    weights: np.ndarray
    cut: float
    spread: float

    def score(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid((raw - self.cut) / self.spread + np.log(CUT / (1 - CUT)))


def fit_pairs(sample: Sample, pairs: int = PAIRS, steps: int = STEPS, rate: float = 0.05, penalty: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Minimise log(1 + exp(-(s(better) - s(worse)))) over pairs drawn anew in each step."""
    draw, weights, adam = np.random.default_rng(seed), np.zeros(DIMENSIONS), Adam(DIMENSIONS, rate)
    better, worse = np.flatnonzero(sample.labels == 1), np.flatnonzero(sample.labels == 0)
    for _ in range(steps):
        a, b = draw.choice(better, pairs), draw.choice(worse, pairs)
        scores = sample.dot(weights)
        pull = sigmoid(scores[b] - scores[a]) / pairs
        per_row = np.bincount(b, pull, len(sample)) - np.bincount(a, pull, len(sample))
        weights -= adam.step(sample.gradient(per_row, DIMENSIONS) + penalty * weights)
    return weights


def raw_score(text: Column | str, weights: np.ndarray) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        parts = [linear_scores(quality_grams(piece), weights) for piece in pieces(texts)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), type=pa.float64())

    return F.arrow_udf(run, "double")(text)


def neighbours_of_quantile(scored: DataFrame, weight: tuple[float, float], level: float) -> tuple[float | None, float, float | None]:
    """The next smaller value, the value and the next larger value (None beyond the ends) at the ``level``
    quantile of column ``raw``, where rows of label v weigh ``weight[v]`` and all weights add up to 1.

    Exact over all rows: values are counted in equal bins between the smallest and the largest, then inside
    the bin that reaches the level, until that bin holds a single value. Only counts reach the driver."""
    low, high = scored.agg(F.min("raw"), F.max("raw")).first()
    below, smaller, larger = 0.0, None, None
    while True:
        inside = scored.filter(F.col("raw").between(low, high))
        place = F.floor((F.col("raw") - low) / (high - low) * (BINS - 1)) if high > low else F.lit(0)
        bins = inside.groupBy(place.cast("int").alias("bin")).agg(
            F.min("raw").alias("low"), F.max("raw").alias("high"), *(F.count_if(F.col("label") == v).alias(f"n{v}") for v in (0, 1))
        )
        bins = sorted(bins.collect(), key=lambda r: r["bin"])
        sums = below + np.cumsum([weight[0] * r["n0"] + weight[1] * r["n1"] for r in bins])
        at = min(int(np.searchsorted(sums, level - 1e-9)), len(bins) - 1)
        smaller = bins[at - 1]["high"] if at else smaller
        larger = bins[at + 1]["low"] if at + 1 < len(bins) else larger
        below = sums[at - 1] if at else below
        low, high = bins[at]["low"], bins[at]["high"]
        if low == high:
            return smaller, low, larger


def quantile_cut(scored: DataFrame, share: float) -> tuple[float, float]:
    """The ``share`` quantile of the scores (label, raw), each label weighing as among all labelled rows, in
    the middle of the gap between the neighbouring scores; and the scale of the scores around it."""
    n = {r["label"]: r["count"] for r in scored.groupBy("label").count().collect()}
    smaller, at, larger = neighbours_of_quantile(scored, ((1 - share) / n[0], share / n[1]), 1 - share)
    beside = larger if larger is not None else smaller if smaller is not None else at
    middles = []
    for v in (0, 1):
        _, middle, _ = neighbours_of_quantile(scored.filter(F.col("label") == v), (1 / n[v], 1 / n[v]), 0.5)
        middles.append(middle)
    return (at + beside) / 2, max((middles[1] - middles[0]) / 8, 1e-3)


def fit_ranking(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, modulus: int | None = 5) -> RankingModel:
    """Fit on pairs from a bounded sample of labelled documents; the quantile level is the share of the
    label 0 among all labelled rows, and the scores are those of all labelled documents. With no pair at all
    every document scores one half."""
    rows = labelled(labels, label, modulus=modulus)
    share = rows.agg(F.avg("label")).first()[0]
    sample = collect_sample(docs, bounded_sample(rows, per_label), lambda piece: sparse_rows(quality_grams(piece)))
    if share is None or len(np.unique(sample.labels)) < 2:
        return RankingModel(np.zeros(DIMENSIONS), np.log(CUT / (1 - CUT)), 1.0)
    weights = fit_pairs(sample).astype(np.float32)
    every = docs.select(F.col("doc_id").alias("id"), raw_score("text", weights).alias("raw"))
    scored = handover(every.join(rows.hint("merge"), "id").select("label", "raw"), "scores")  # one plan at every size
    cut, spread = quantile_cut(scored, share)
    return RankingModel(weights, cut, spread)


def quality_score(text: Column | str, model: RankingModel) -> Column:
    """Score 0 to 1 of a text; CUT and more means above the quantile. Null and empty texts have no
    n-grams and get the score of the raw value 0; texts may have any length."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [model.score(linear_scores(quality_grams(piece), model.weights)) for piece in pieces(texts)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), type=pa.float64())

    return F.arrow_udf(run, "double")(text)


def rank_documents(docs: DataFrame, model: RankingModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; rows repeat as in the input, null ids stay."""
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    scored = rows.select(id_column, quality_score("text", model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
