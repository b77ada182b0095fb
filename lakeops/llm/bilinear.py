"""Log-bilinear language model over words, trained in numpy with noise-contrastive estimation.

The network predicts a class from the two classes before it: the most frequent words are classes of their
own, all others share classes by their last two bytes. A word of a shared class then has its add-one share
within the class, so that the probabilities of all words, seen or not, add up to one. Counts cover all
learning texts. Every split trains on all its tokens from the same start; the parameters are averaged by
the number of tokens. The normalisers of all context pairs come from batched matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.features import sigmoid
from lakeops.llm.shared import handover
from lakeops.llm.words import LOWER, U64, Piece, find_words, pieces, range_hashes, sums

SHARED = 64  # classes of the less frequent words
OWN = 447  # words with a class of their own
END = OWN + SHARED  # the end of a text, and what stands before its first word
CLASSES = END + 1
HEAD = 1 << 18  # most frequent words whose counts travel to the tasks (4 MB); the others meet theirs in a join
SIZE = 24
NOISE = 16  # noise classes drawn for a batch and shared by its tokens
BATCH = 4096
RATE = 0.08
END_HASH = U64(1)


def tokens(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, shared class of each, bounds) of lower-cased words with an end after each text's last."""
    flat = LOWER[piece.flat]
    words = find_words(piece)
    bounds = words.bounds + np.arange(len(words.bounds))
    hashes = np.full(int(bounds[-1]), END_HASH, dtype=U64)
    shared = np.full(len(hashes), END, dtype=np.int16)
    inside = np.ones(len(hashes), dtype=bool)
    inside[bounds[1:] - 1] = False
    hashes[inside] = np.maximum(range_hashes(flat, words.starts, words.ends), U64(2))
    last = flat[words.ends - 1].astype(np.uint32)
    before = np.where(words.ends - words.starts > 1, flat[np.maximum(words.ends - 2, 0)], 0).astype(np.uint32)
    mixed = (last * np.uint32(251) + before + np.uint32(1)) * np.uint32(0x9E3779B1)
    shared[inside] = OWN + (mixed >> np.uint32(32 - 6)).astype(np.int16)
    return hashes, shared, bounds


def count_words(texts: DataFrame) -> DataFrame:
    """(word, shared, n): how often each token (by hash) occurs in the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for piece in pieces(batch.column(0), 1 << 21):
                hashes, shared, _ = tokens(piece)
                found, at, n = np.unique(hashes, return_index=True, return_counts=True)
                parts.append((found, shared[at], n))
            if not parts:
                continue
            words, shared, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            found, at, inverse = np.unique(words, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weights=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(shared[at]), pa.array(total)], ["word", "shared", "n"]
            )

    parts = texts.select("text").mapInArrow(run, "word long, shared short, n long")
    return parts.groupBy("word").agg(F.min("shared").alias("shared"), F.sum("n").alias("n"))


@dataclass
class Head:
    """The most frequent words in order of their hashes: counts, and class or -1."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_counts: np.ndarray  # tokens per class
    class_words: np.ndarray  # distinct words per shared class

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the head's words, -1 elsewhere."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def classify(self, at: np.ndarray, shared: np.ndarray) -> np.ndarray:
        own = self.classes[at] if len(self.words) else np.full(len(at), -1)
        return np.where((at >= 0) & (own >= 0), own, shared).astype(np.int64)


def fit_head(counts: DataFrame, size: int = HEAD) -> Head:
    order = [F.col("n").desc(), F.col("word")]
    top = counts.orderBy(*order).limit(size).toArrow()
    words, n = top.column("word").to_numpy().view(U64), top.column("n").to_numpy()
    shared = top.column("shared").to_numpy()
    ranked = np.lexsort((words.view(np.int64), -n))
    own = ranked[words[ranked] != END_HASH][:OWN]
    classes = np.full(len(words), -1)
    classes[own] = np.arange(len(own))
    classes[words == END_HASH] = END
    per_class = counts.groupBy("shared").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    class_counts, class_words = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for r in per_class:
        class_counts[r["shared"]], class_words[r["shared"]] = r["n"], r["words"]
    np.subtract.at(class_counts, shared[own], n[own])
    np.subtract.at(class_words, shared[own], 1)
    class_counts[: len(own)] = n[own]
    order = np.argsort(words)
    return Head(words[order], n[order], classes[order], class_counts, class_words)


@dataclass
class Network:
    """Class vectors as context and as target, a matrix per context place, and target biases."""

    context: np.ndarray
    target: np.ndarray
    places: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(class_counts: np.ndarray, seed: int = 11) -> Network:
        draw = np.random.default_rng(seed)
        unigram = (class_counts + 1) / (class_counts + 1).sum()
        vectors = lambda: draw.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32)
        places = np.stack([np.eye(SIZE), 0.5 * np.eye(SIZE)]).astype(np.float32)
        return Network(vectors(), vectors(), places, np.log(unigram).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.target, self.places, self.bias)])

    @staticmethod
    def unflat(x: np.ndarray) -> Network:
        n = CLASSES * SIZE
        context, target, places, bias = np.split(x.astype(np.float32), [n, 2 * n, 2 * n + 2 * SIZE * SIZE])
        return Network(context.reshape(CLASSES, SIZE), target.reshape(CLASSES, SIZE), places.reshape(2, SIZE, SIZE), bias)

    def normalisers(self, rows: int = 64) -> np.ndarray:
        """log of the sum over classes for each (class before, class two before); blocks of contexts."""
        near, far = self.context @ self.places[0], self.context @ self.places[1]
        out = np.empty((CLASSES, CLASSES), dtype=np.float32)
        for at in range(0, CLASSES, rows):
            h = (near[at : at + rows, None, :] + far[None, :, :]).reshape(-1, SIZE)
            scores = h @ self.target.T + self.bias
            top = scores.max(axis=1, keepdims=True)
            out[at : at + rows] = (top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))).reshape(-1, CLASSES)
        return out


def contexts(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class before each token and class two before; END before the first word of a text."""
    one, two = np.full(len(classes), END), np.full(len(classes), END)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[bounds[:-1]] = END
    two[bounds[:-1]] = END
    second = bounds[:-1] + 1
    two[second[second < bounds[1:]]] = END
    return one, two


class Trainer:
    """Noise-contrastive steps: tell each token from NOISE draws of the unigram distribution."""

    def __init__(self, net: Network, class_counts: np.ndarray, seed: int = 13):
        self.net, self.draw = net, np.random.default_rng(seed)
        self.noise = (class_counts + 1) / (class_counts + 1).sum()
        self.edges = np.cumsum(self.noise)
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        self.seen = [np.full_like(x, 1e-4) for x in (net.context, net.target, net.places, net.bias)]

    def scatter(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        cells = (rows[:, None] * SIZE + np.arange(SIZE)).ravel()
        return np.bincount(cells, values.ravel(), CLASSES * SIZE).reshape(CLASSES, SIZE).astype(np.float32)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, len(target)
        a, b = net.context[one], net.context[two]
        h = a @ net.places[0] + b @ net.places[1]
        t = net.target[target]
        noise = np.minimum(np.searchsorted(self.edges, self.draw.random(NOISE)), CLASSES - 1)
        q = net.target[noise]
        pull = sigmoid((h * t).sum(axis=1) + net.bias[target] - self.log_noise[target]) - 1
        push = sigmoid(h @ q.T + net.bias[noise] - self.log_noise[noise])
        pull, push = (pull / n).astype(np.float32), (push / n).astype(np.float32)
        dh = pull[:, None] * t + push @ q
        d_target = self.scatter(target, pull[:, None] * h)
        np.add.at(d_target, noise, push.T @ h)
        d_bias = np.bincount(target, pull, CLASSES).astype(np.float32)
        np.add.at(d_bias, noise, push.sum(axis=0))
        d_context = self.scatter(one, dh @ net.places[0].T) + self.scatter(two, dh @ net.places[1].T)
        d_places = np.stack([a.T @ dh, b.T @ dh])
        for seen, x, d in zip(self.seen, (net.context, net.target, net.places, net.bias), (d_context, d_target, d_places, d_bias), strict=True):
            seen += d * d
            x -= RATE * d / np.sqrt(seen)


def train(texts: DataFrame, head: Head) -> Network:
    """Average, weighted by tokens, of the networks that the splits train on all their texts."""
    start = Network.start(head.class_counts).flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, n = Trainer(Network.unflat(start), head.class_counts), 0
        held: list[tuple] = []
        size = 0

        def learn(final: bool) -> int:
            one, two, target = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = len(target) if final else len(target) // BATCH * BATCH
            for at in range(0, whole, BATCH):
                part = slice(at, min(at + BATCH, whole))
                trainer.step(one[part], two[part], target[part])
            held[:] = [(one[whole:], two[whole:], target[whole:])]
            return len(target) - whole

        for batch in batches:
            for piece in pieces(batch.column(0)):
                hashes, shared, bounds = tokens(piece)
                classes = head.classify(head.find(hashes), shared)
                held.append((*contexts(classes, bounds), classes))
                n, size = n + len(classes), size + len(classes)
                if size >= 16 * BATCH:
                    size = learn(False)
        if n:
            learn(True)
            values = trainer.net.flat().astype(np.float64) * n
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values), pa.array(np.full(len(values), n))], ["at", "value", "n"])

    parts = texts.select("text").mapInArrow(run, "at int, value double, n long")
    found = parts.groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow()
    flat = start.copy()
    flat[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return Network.unflat(flat)


@dataclass
class BilinearModel:
    """The network with its normalisers, the head, the table of all counts and their totals."""

    network: Network
    normalisers: np.ndarray
    head: Head
    counts: DataFrame
    n_tokens: int
    n_words: int


def fit_bilinear(docs: DataFrame, learning: Column | None = None, text_column: str = "text") -> BilinearModel:
    """Learn from the rows for which ``learning`` holds (all without it). Null texts are empty: an end
    alone. Without any text the totals are 0 and the network keeps its start."""
    texts = (docs if learning is None else docs.filter(learning)).select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    counts = handover(count_words(texts), "counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).first()
    head = fit_head(counts)
    network = train(texts, head)
    return BilinearModel(network, network.normalisers(), head, counts, totals["n"] or 0, totals["words"])


SCORED = "n_tokens: bigint, n_known: bigint, base: double, score: double, words: array<bigint>, times: array<int>"


def _score_texts(texts: pa.Array, model: tuple[Network, np.ndarray, Head]) -> pa.StructArray:
    network, normalisers, head = model
    log_count = np.log10(head.counts + 1.0)
    log_share = np.log10(head.class_counts[OWN:END] + head.class_words[OWN:END] + 1.0)
    near, far = network.context @ network.places[0], network.context @ network.places[1]
    out: list[list[np.ndarray]] = [[] for _ in range(4)]
    words, times, lengths = [], [], []
    for piece in pieces(texts):
        hashes, shared, bounds = tokens(piece)
        at = head.find(hashes)
        found = at >= 0
        classes = head.classify(at, shared)
        one, two = contexts(classes, bounds)
        natural = ((near[one] + far[two]) * network.target[classes]).sum(axis=1) + network.bias[classes] - normalisers[one, two]
        logs = np.zeros(len(hashes))
        logs[found] = log_count[at[found]]
        sharing = (classes >= OWN) & (classes < END)
        inner = np.where(sharing, logs - log_share[np.clip(classes - OWN, 0, SHARED - 1)], 0.0)
        for column, value in zip(
            out,
            (np.diff(bounds), sums(found, bounds), sums(logs, bounds), sums(natural / np.log(10) + inner, bounds)),
            strict=True,
        ):
            column.append(value)
        # the other words of each text, each once with its number
        rest = np.flatnonzero(~found)
        owner = np.searchsorted(bounds, rest, side="right") - 1
        order = np.lexsort((hashes[rest], owner))
        o, h = owner[order], hashes[rest][order]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        words.append(h[first].view(np.int64))
        times.append(np.diff(np.append(first, len(o))))
        lengths.append(np.bincount(o[first], minlength=len(piece)))
    joined = [np.concatenate(x) if x else np.empty(0) for x in (*out, words, times, lengths)]
    offsets = pa.array(np.concatenate([[0], np.cumsum(joined[6])]), pa.int32())
    return pa.StructArray.from_arrays(
        [
            pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.int64()),
            pa.array(joined[2], pa.float64()), pa.array(joined[3], pa.float64()),
            pa.ListArray.from_arrays(offsets, pa.array(joined[4], pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array(joined[5], pa.int32())),
        ],
        ["n_tokens", "n_known", "base", "score", "words", "times"],
    )


def score_documents(docs: DataFrame, model: BilinearModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row, log10 of probabilities.

    Null and empty texts are one end. Rows repeat as in the input and null ids stay. Counts of words
    outside the head come from a join on the word, whose partial sums are added per row.
    """
    parts = (model.network, model.normalisers, model.head)

    def run(texts: pa.Array) -> pa.Array:
        return _score_texts(texts, parts)

    found = docs.select(F.col(id_column).alias("id"), F.arrow_udf(run, f"struct<{SCORED}>")(text_column).alias("v"))
    rows = handover(found.select("id", "v.*").withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    sums_of = (
        rest.join(model.counts.select("word", "n"), "word")
        .groupBy("row")
        .agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    )
    total = F.log10(F.lit(float(model.n_tokens + model.n_words + 1)))
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.drop("words", "times").join(handover(sums_of, "sums"), "row", "left").select(
        F.col("id").alias(id_column),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * total).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
