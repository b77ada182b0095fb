"""Quality rules: exact counts of a text, and a calibrated n-gram classifier against a fixed threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.features import (
    DIMENSIONS, Adam, Sample, bounded_sample, collect_sample, labelled, linear_scores, quality_grams, sigmoid, sparse_rows,
)
from lakeops.llm.words import IS_WORD, U64, Piece, Words, find_words, mix, pieces, range_hashes, sums

PER_LABEL = 1000  # labelled rows of each label in the sample the classifier is fitted on
KEEP_FROM = 0.5  # fixed threshold on the calibrated probability of label 1
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 50, 3, 50
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = pa.struct([*((name, pa.int64()) for name in COUNTS), ("probability", pa.float64())])


@dataclass
class RulesModel:
    """Weights of the n-gram classifier and the two numbers of its calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (raw + self.bias) + self.shift)


def fit_logistic(sample: Sample, weight: np.ndarray, steps: int = 80, rate: float = 0.05, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on sparse rows; full gradients, Adam steps."""
    weights, bias, adam = np.zeros(DIMENSIONS), 0.0, Adam(DIMENSIONS + 1, rate)
    for _ in range(steps):
        residual = weight * (sigmoid(sample.dot(weights) + bias) - sample.labels)
        gradient = np.append(sample.gradient(residual, DIMENSIONS) + penalty * weights, residual.sum())
        move = adam.step(gradient)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def fit_calibration(raw: np.ndarray, labels: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over raw scores (Newton steps, softened targets)."""
    ones = (labels * weight).sum() / max(weight.sum(), 1e-12)
    n = max(len(labels), 1)
    target = np.where(labels == 1, (ones * n + 1) / (ones * n + 2), 1 / ((1 - ones) * n + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * raw + b)
        d, c = weight * (p - target), weight * p * (1 - p) + 1e-9
        g = np.array([(d * raw).sum() + 1e-3 * (a - 1.0) / n, d.sum()])
        h = np.array([[(c * raw * raw).sum() + 1e-3 / n, (c * raw).sum()], [(c * raw).sum(), c.sum()]])
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, modulus: int | None = 5) -> RulesModel:
    """Fit on a bounded sample of labelled documents: four fifths for the weights, the rest to calibrate.

    Rows are weighted so that both labels keep their share among all labelled rows. With no labelled row
    of one label the classifier accepts everything (probability 1).
    """
    rows = labelled(labels, label, modulus=modulus)
    share = rows.agg(F.avg("label")).first()[0]
    sample = collect_sample(docs, bounded_sample(rows, per_label), lambda piece: sparse_rows(quality_grams(piece)))
    if share is None or len(np.unique(sample.labels)) < 2:
        return RulesModel(np.zeros(DIMENSIONS), 0.0, 1.0, 60.0)
    ones = sample.labels == 1
    weight = np.where(ones, share / ones.sum(), (1 - share) / (~ones).sum())
    held = np.zeros(len(sample), dtype=bool)
    for group in (np.flatnonzero(ones), np.flatnonzero(~ones)):
        held[group[4::5]] = True
    fit = np.flatnonzero(~held)
    weights, bias = fit_logistic(sample.select(fit), weight[fit] / weight[fit].sum())
    test = np.flatnonzero(held) if len(np.unique(sample.labels[held])) == 2 else np.arange(len(sample))
    raw = sample.select(test).dot(weights) + bias
    slope, shift = fit_calibration(raw, sample.labels[test], weight[test] / weight[test].sum())
    return RulesModel(weights.astype(np.float32), bias, slope, shift)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(keys), dtype=bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def repeated_words(words: Words, hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text the words inside windows that occur twice or more in it."""
    owner = words.owners()
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(len(words.bounds) - 1, dtype=np.int64)
    at = np.arange(n)
    inside = owner[at] == owner[at + window - 1]
    at = at[inside]
    keys = range_hashes(hashes, at, at + window) ^ mix(owner[at].astype(U64))
    covered = np.zeros(len(hashes), dtype=bool)
    found = at[_repeats(keys)]
    for i in range(window):
        covered[found + i] = True
    return sums(covered, words.bounds)


def repeated_lines(piece: Piece) -> np.ndarray:
    """Per text the \\n-split lines with a word that equal an earlier line of it."""
    out = np.zeros(len(piece), dtype=np.int64)
    if not len(piece.flat):
        return out
    begins = np.zeros(len(piece.flat) + 1, dtype=bool)
    begins[piece.offsets[:-1]] = True
    breaks = np.flatnonzero(piece.flat == 0x0A)
    begins[breaks + 1] = True
    starts = np.flatnonzero(begins[:-1])
    owner = np.searchsorted(piece.offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(piece.flat))
    ends = ends - (piece.flat[ends - 1] == 0x0A)
    filled = np.zeros(len(piece.flat) + 1, dtype=np.int64)
    np.cumsum(IS_WORD[piece.flat], out=filled[1:])
    with_word = filled[ends] > filled[starts]
    starts, ends, owner = starts[with_word], ends[with_word], owner[with_word]
    keys = range_hashes(piece.flat, starts, ends) ^ mix(owner.astype(U64))
    order = np.argsort(keys, kind="stable")
    later = order[1:][keys[order][1:] == keys[order][:-1]]
    np.add.at(out, owner[later], 1)
    return out


def _verdicts(texts: pa.Array, model: RulesModel) -> pa.Array:
    columns: list[list[np.ndarray]] = [[] for _ in range(len(COUNTS) + 1)]
    for piece in pieces(texts):
        words = find_words(piece)
        hashes = range_hashes(piece.flat, words.starts, words.ends)
        leading = (piece.flat & 0xC0) != 0x80
        for column, part in zip(
            columns,
            (
                words.counts,
                sums(leading & IS_WORD[piece.flat], piece.offsets),
                sums(SYMBOLS[piece.flat], piece.offsets),
                repeated_lines(piece),
                repeated_words(words, hashes),
                model.probability(linear_scores(quality_grams(piece, words, hashes), model.weights)),
            ),
            strict=True,
        ):
            column.append(part)
    kinds = [np.int64] * len(COUNTS) + [np.float64]
    arrays = [pa.array(np.concatenate(c).astype(k) if c else np.empty(0, k)) for c, k in zip(columns, kinds, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=list(VERDICT))


def verdict(text: Column | str, model: RulesModel, keep_from: float = KEEP_FROM) -> Column:
    """Struct of the counts, ``probability``, ``base_failed`` and ``kept`` of a text.

    Null and empty texts have no words: all counts 0, base_failed, not kept. Texts may have any length.
    """
    kind = "struct<" + ", ".join(f"{name}: bigint" for name in COUNTS) + ", probability: double>"
    found = F.arrow_udf(lambda texts: _verdicts(texts, model), kind)(text)
    few = found["n_words"] < MIN_WORDS
    failed = few | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
    return F.struct(
        *(found[name].alias(name) for name in COUNTS),
        found["probability"].alias("probability"),
        failed.alias("base_failed"),
        (~failed & (found["probability"] >= keep_from)).alias("kept"),
    )


def apply_rules(docs: DataFrame, model: RulesModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, counts, probability, base_failed, kept) of every row; rows and null ids stay as they are."""
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    return rows.select(id_column, verdict("text", model).alias("v")).select(id_column, "v.*")
