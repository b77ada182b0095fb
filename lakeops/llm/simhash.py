"""Near duplicates by 64-bit SimHash fingerprints and a range join over segment bit counts.

A fingerprint is mapped to the bit counts of its 32 two-bit segments, a point of an integer grid. Counts of
two fingerprints differ (Manhattan distance) by at most the number of differing bits, so the grid distance
is a lower bound of the Hamming distance. Two points at distance 2 or less share a grid cell when each is
put into its own cell and into those of its one-bit neighbours: that is the range join. Cells with a single
fingerprint are done. In the others a pair is verified exactly by the one-bit neighbour both have: it
exists just when they differ in at most 2 bits. Each neighbour links its members to its smallest one, so a
dense group of near copies gives rows in proportion to its size, never its pairs.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from lakeops.llm.shared import handover
from lakeops.llm.words import find_words, joined_words, pieces

SHINGLE = 3
SEED = 42
ODD_BITS = 0x5555555555555555
LANES = 255  # hashes that add up in one byte per bit


def _fingerprints(texts: pa.Array, size: int) -> np.ndarray:
    out = []
    for piece in pieces(texts):
        words = find_words(piece)
        buffer, starts, ends = joined_words(piece, words, lower=True)
        data, counts = buffer.tobytes(), words.counts
        per_text = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
        bounds = np.zeros(len(piece) + 1, dtype=np.int64)
        np.cumsum(per_text, out=bounds[1:])
        owner = np.repeat(np.arange(len(piece)), per_text)
        first = np.arange(bounds[-1]) - bounds[owner] + words.bounds[owner]
        last = np.minimum(first + size, words.bounds[owner + 1]) - 1
        digests = b"".join(
            [xxh64_digest(data[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)]
        )
        ones = np.zeros((len(piece), 64), dtype=np.int64)
        if len(owner):
            # up to 255 hashes add up as bytes, eight bits of the hash to a machine word
            bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).view(np.uint64).reshape(-1, 8)
            parts = -(-per_text // LANES)
            part_owner = np.repeat(np.arange(len(piece)), parts)
            part_no = np.arange(len(part_owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            part_sums = np.add.reduceat(bits, bounds[part_owner] + part_no * LANES, axis=0).view(np.uint8)
            np.add.at(ones, part_owner, part_sums.reshape(-1, 64))
        majority = 2 * ones > per_text[:, None]
        out.append(np.packbits(majority.astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)


def fingerprint(text: Column | str, size: int = SHINGLE) -> Column:
    """SimHash of the lower-cased word shingles with repeats: a bit is set if it is set in over half of
    their XXH64 values. Fewer words than ``size`` make one shingle; no words (null too) give 0."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(_fingerprints(texts, size), type=pa.int64())

    return F.arrow_udf(run, "long")(text)


def grid_cell(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed into the same 64 bits."""
    other = F.shiftrightunsigned(fp, 1)
    both, one = fp.bitwiseAND(other).bitwiseAND(F.lit(ODD_BITS)), fp.bitwiseXOR(other).bitwiseAND(F.lit(ODD_BITS))
    return F.shiftleft(both, 1).bitwiseOR(one)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(fp: str) -> Column:
    """The fingerprint and its 64 one-bit neighbours."""
    masks = [0, *(_signed(1 << i) for i in range(64))]
    return F.array(*(F.col(fp).bitwiseXOR(F.lit(m).cast("long")) for m in masks))


def links(fingerprints: DataFrame) -> DataFrame:
    """Verified links (src, dst), dst < src, between distinct fingerprints (column ``fp``): their
    connected groups are those of all pairs with at most 2 differing bits."""
    probes = fingerprints.select("fp", F.explode(near("fp")).alias("x")).select("fp", "x", grid_cell(F.col("x")).alias("cell"))
    cells = probes.select("cell", "fp").groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    shared = handover(cells.filter("lo < hi").select("cell"), "cells")
    candidates = probes.join(shared, "cell", "left_semi")
    stars = handover(candidates.groupBy("x").agg(F.min("fp").alias("dst"), F.max("fp").alias("hi")).filter("dst < hi").select("x", "dst"), "stars")
    return (
        fingerprints.select(F.col("fp").alias("src"), F.explode(near("fp")).alias("x"))
        .join(stars, "x")
        .filter("src > dst")
        .select("src", "dst")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each linked node reaches; (src, dst) may come in any order.

    Rounds of neighbour minimum and pointer jumping, each written to the shared folder; the driver only
    reads whether a label changed.
    """
    both = handover(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct(), "edges")
    labels = handover(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("dst"), "root")
        around = both.join(seen, "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near_root"))
        hooked = handover(
            labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "near_root").alias("root")), "hooked"
        )
        # the old root of a node follows to the smaller root found; then each node jumps to its root's root
        moved = (
            hooked.select(F.col("old").alias("node"), "root").union(hooked.select("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
        )
        jumps = handover(moved, "moved")
        up = jumps.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        following = handover(
            jumps.join(labels.select("node", F.col("root").alias("old")), "node")
            .join(up, "root", "left")
            .select("node", F.coalesce("upper", "root").alias("root"), "old"),
            "labels",
        )
        if following.filter("root <> old").isEmpty():
            return following.select("node", "root")
        labels = following.select("node", "root")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, fp, root, component_id) for every row: its SimHash, its group (``root``, a fingerprint) and the
    smallest id among all rows whose fingerprints connect to it by steps of at most 2 differing bits.

    Exact copies share a fingerprint and are folded before the join. Null and empty texts have
    fingerprint 0 and link like any other. Rows repeat as in the input; a null id takes part and is never
    a component_id unless its whole group has none. An empty table gives an empty result.
    """
    own = [F.col(f"`{c}`").alias(c) for c in keep]
    rows = handover(docs.select(F.col(id_column).alias("id"), *own, fingerprint(text_column).alias("fp")), "fingerprints")
    firsts = handover(rows.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    roots = components(links(firsts.select("fp")))
    grouped = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = handover(grouped.join(handover(least, "least"), "root").select("fp", "root", "component_id"), "classes")
    return rows.join(classes, "fp").select(F.col("id").alias(id_column), *keep, "fp", "root", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


