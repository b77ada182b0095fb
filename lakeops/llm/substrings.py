"""Long word sequences that an earlier document has too: a compacted De Bruijn graph of sampled k-mers.

Of every 50 consecutive words the k-mer with the smallest hash is picked, so equal windows pick the same
k-mer at the same place. The picked k-mers are the nodes; what a node is picked for, with the words around
it, are its edges. A node with a single surrounding wherever it occurs does not branch: the windows that it
stands for are one path, compacted to one row, and share one first document. Only at branching nodes are
windows looked at one by one, by 128-bit hashes taken at their source coordinates in a second reading of
the texts. The branching nodes reach the tasks as a filter of fixed size, which may let others through
but none escape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.shared import handover
from lakeops.llm.words import U64, Piece, find_words, joined_words, mix, pieces, range_hashes

WINDOW = 50  # words
K = 20
FILTER_BITS = 26  # size of the filter of branching nodes: 8 MB, whatever their number


def _second(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ U64(0xD6E8FEB86659FD93))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    out, reach = values, 1
    while 2 * reach <= width:
        out = np.minimum(out[: len(out) - reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def nodes_of(piece: Piece, window: int, k: int) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """Picked k-mers of a piece: hash, text, first and last window start (words of the text) they stand
    for, and the hash of the words from the first to the end of the last; and all word hashes."""
    words = find_words(piece)
    hashes = range_hashes(piece.flat, words.starts, words.ends)
    if len(hashes) < window:
        return None
    at = np.arange(len(hashes) - k + 1)
    mers = range_hashes(hashes, at, at + k)
    place_bits = U64(max(int(len(mers)).bit_length(), 1))
    ranked = (mers >> place_bits << place_bits) | at.astype(U64)  # ties: the leftmost
    picked = (_smallest(ranked, window - k + 1) & ((U64(1) << place_bits) - U64(1))).astype(np.int64)
    starts = np.arange(len(picked))
    owner = words.owners()
    inside = owner[starts] == owner[starts + window - 1]
    starts, picked = starts[inside], picked[inside]
    if not len(starts):
        return None
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (picked[1:] != picked[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, b, mer = starts[first], starts[last], picked[first]
    around = mix(range_hashes(hashes, a, b + window) ^ ((mer - a).astype(U64) << U64(32)) ^ (b - a).astype(U64))
    row = owner[a]
    base = words.bounds[row]
    return {"hash": mers[mer], "around": around, "row": row, "a": a - base, "b": b - base, "base": base}, hashes


def _occurrences(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                found = nodes_of(piece, window, k)
                if found:
                    f = found[0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(f["row"] + piece.first)),
                            pa.array(f["hash"].view(np.int64)), pa.array(f["around"].view(np.int64)),
                            pa.array(f["a"].astype(np.int32)), pa.array((f["b"] + window).astype(np.int32)),
                        ],
                        ["id", "node", "around", "start", "stop"],
                    )

    return run


def _windows(window: int, k: int, bits: np.ndarray):
    shift = U64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                found = nodes_of(piece, window, k)
                if not found:
                    continue
                f, hashes = found
                slot = f["hash"] >> shift
                wanted = np.flatnonzero(bits[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8) & 1)
                n = f["b"][wanted] - f["a"][wanted] + 1
                each = np.repeat(wanted, n)
                start = f["a"][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                at = start + f["base"][each]
                one = range_hashes(hashes, at, at + window)
                two = range_hashes(_second(hashes), at, at + window)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(f["row"][each] + piece.first)),
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(start.astype(np.int32)),
                    ],
                    ["id", "one", "two", "start"],
                )

    return run


def branching_filter(branching: DataFrame) -> np.ndarray:
    """Bits of all branching nodes by their leading hash bits; a fixed number of bytes."""
    slots = branching.select(F.shiftrightunsigned("node", 64 - FILTER_BITS).alias("slot"))
    rows = (
        slots.groupBy(F.shiftrightunsigned("slot", 5).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 AS int)))").alias("mask"))
        .toArrow()
    )
    out = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, start, stop): word spans of a document made of windows that a smaller id has as well.

    Spans may overlap. Rows without an id or with a null or shorter text have none.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("id is not null and text is not null")
    found = handover(rows.mapInArrow(_occurrences(window, k), f"id {id_type}, node long, around long, start int, stop int"), "nodes")
    nodes = found.groupBy("node").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("around").alias("lo"), F.max("around").alias("hi")
    )
    repeated = handover(nodes.filter("first_id < last_id").select("node", "first_id", (F.col("lo") < F.col("hi")).alias("branches")), "repeated")
    paths = handover(repeated.filter("NOT branches").select("node", "first_id"), "paths")
    along = found.join(paths, "node").filter("id > first_id").select("id", "start", "stop")
    bits = branching_filter(repeated.filter("branches"))
    single = handover(rows.mapInArrow(_windows(window, k, bits), f"id {id_type}, one long, two long, start int"), "windows")
    firsts = single.groupBy("one", "two").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    firsts = handover(firsts.filter("first_id < last_id").select("one", "two", "first_id"), "firsts")
    apart = single.join(firsts, ["one", "two"]).filter("id > first_id").select("id", "start", (F.col("start") + window).alias("stop"))
    return along.unionByName(apart)


def _cut(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    n_words, removed, kept = [], [], []
    starts, stops = starts.fill_null([]) if starts.null_count else starts, stops.fill_null([]) if stops.null_count else stops
    for piece in pieces(texts):
        words = find_words(piece)
        buffer, begin, end = joined_words(piece, words)
        data = buffer.tobytes()
        cover = np.zeros(len(begin) + 1, dtype=np.int32)
        for i in range(len(piece)):
            base, top = int(words.bounds[i]), int(words.bounds[i + 1])
            own = starts[piece.first + i].values
            gone = None
            if own is not None and len(own):
                cover[:] = 0
                np.add.at(cover, np.minimum(base + own.to_numpy(), top), 1)
                np.add.at(cover, np.minimum(base + stops[piece.first + i].values.to_numpy(), top), -1)
                gone = np.cumsum(cover[base:top]) > 0
            n_words.append(top - base)
            removed.append(int(gone.sum()) if gone is not None else 0)
            if gone is None:
                kept.append(data[begin[base] : end[top - 1]] if top > base else b"")
            else:
                left = base + np.flatnonzero(~gone)
                kept.append(b" ".join([data[a:b] for a, b in zip(begin[left].tolist(), end[left].tolist(), strict=True)]))
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["n_words", "n_removed", "kept"]
    )


def cut_spans(text: Column | str, starts: Column | str, stops: Column | str) -> Column:
    """Struct (n_words, n_removed, kept): the words outside the spans, joined by single spaces (bytes)."""
    return F.arrow_udf(_cut, "struct<n_words: bigint, n_removed: bigint, kept: binary>")(text, starts, stops)


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: each word is removed that a window of ``window`` words
    covers whose words also start in a row with a smaller id.

    Windows are judged on the input. Rows with equal ids are no earlier documents of each other and get
    the spans found for that id in each of them that has the words; null ids have no order and keep all;
    null and empty texts have no words. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, window, k, id_column, text_column)
    # neighbouring window starts of a document melt into one span each before they meet its text
    order = Window.partitionBy("id").orderBy("start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    lists = merged.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    lists = handover(lists.select(F.col("id").alias("span_id"), "spans"), "spans")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # the same plan at every size: spans and texts meet in a shuffle even where the spans are few
    joined = rows.join(lists.hint("merge"), rows.id == lists.span_id, "left")
    cut = joined.select("id", cut_spans("text", F.col("spans.start"), F.col("spans.stop")).alias("v"))
    return cut.select(F.col("id").alias(id_column), "v.*")
