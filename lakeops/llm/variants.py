"""Spelling variants: words one edit apart, found by dynamic programming over the sorted vocabulary.

The vocabulary is sorted once by Spark (range partitions) and cut into blocks of neighbouring words. A query
word visits the blocks that can hold its near words and walks each as a sorted list: words that share a
prefix (their adjacent LCPs say which) share the rows of the banded edit matrix, each row is computed once per
shared prefix, and a range whose prefix already exceeds one edit is skipped whole.

One edit leaves either the first ``h`` letters of the query alone or all letters behind them, with
``h`` = (length - 1) // 2. So a query meets only the words that begin with its first ``h`` letters, and, in the vocabulary
of reversed words, those that end with its last ``length - h``: two short runs of a sorted list.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.llm.shared import handover

RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 5, 3
DROP_ONE_IN = 97
BLOCK_WORDS = 2048  # words of one block, unless that makes more than MOST_BLOCKS of them
MOST_BLOCKS = 8192
CHUNK_QUERIES = 8192  # queries that meet one block in one task
BORDER = 64  # letters of a block's border words that route the queries
LONG_LETTERS = 1 << 20  # longer batches of queries are cut
FAR = 2  # any distance above one


# ---- words -----------------------------------------------------------------------------------


def lower_ascii(word: Column) -> Column:
    """Only A-Z in lower case; other letters stay as they are."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, CAPITALS, SMALL))


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): runs of letters, lower-cased, counted over all texts.

    One in 97 occurrences by the crc32 of ``<key>:<run>`` loses the letter at crc32 % length. Null texts have no
    words, a null key counts as empty text. Words are counted before they move, so a frequent one is no hot key.
    """
    named = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").alias("text"))
    runs = named.select("key", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select("key", lower_ascii(F.col("run")).alias("run")).select(mutated(F.col("key"), F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def mutated(key: Column, run: Column) -> Column:
    h = F.crc32(F.concat_ws(":", key, run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % DROP_ONE_IN == 0, shorter).otherwise(run)


def vocabulary(counted: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    return counted.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


# ---- the walk over a sorted list -------------------------------------------------------------


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words end to end, and where each word starts (n + 1 places)."""
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), starts


class SortedList:
    """A sorted run of distinct words with the LCPs of neighbours."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.counts = words, counts
        self.flat, self.starts = letters(words)
        self.sizes = np.diff(self.starts)
        self.lcp = self._neighbour_lcps()

    def _neighbour_lcps(self) -> np.ndarray:
        """lcp[i]: letters that word i shares with word i - 1; -1 before the first and behind the last word."""
        n = len(self.words)
        out = np.full(n + 1, -1, dtype=np.int64)
        out[1:n] = 0
        alive = np.arange(1, n)
        depth = 0
        while len(alive):
            alive = alive[(self.sizes[alive] > depth) & (self.sizes[alive - 1] > depth)]
            alive = alive[self.flat[self.starts[alive] + depth] == self.flat[self.starts[alive - 1] + depth]]
            depth += 1
            out[alive] = depth
        return out

    def children(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut each range of words sharing ``depth`` letters by their next letter: (parent, low, high) of the parts.

        Ranges that several queries walk are cut once; different ones of a depth do not overlap, so the work is that of
        the list's words. The first word of a range may end there; it has no next letter and is left out.
        """
        n = len(self.words) + 1
        cells, where = np.unique((depth * n + low) * n + high, return_inverse=True)
        high, rest = cells % n, cells // n
        low, depth = rest % n, rest // n
        low = low + (self.sizes[low] == depth)
        size = high - low
        place = ranges(low, size)
        owner = np.repeat(np.arange(len(cells)), size)
        first = (self.lcp[place] <= depth[owner]) | (place == low[owner])
        starts, owner = place[first], owner[first]
        last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
        ends = np.where(last, high[owner], np.append(starts[1:], 0)[: len(owner)])
        parts = np.bincount(owner, minlength=len(cells))
        before = np.cumsum(parts) - parts
        taken = ranges(before[where], parts[where])
        return np.repeat(np.arange(len(where)), parts[where]), starts[taken], ends[taken]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of every entry, end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def near_words(queries: list[str], prefix: np.ndarray, held: SortedList) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) places of all words of the list exactly one edit away that share the query's first ``prefix`` letters.

    All queries walk down together, one letter a step. A state is a query and a range of words with a common
    prefix; it carries the three banded cells of the matrix row of that prefix, which all its words share.
    """
    flat, starts = letters(queries)
    length = np.diff(starts)
    low, high = prefix_ranges(queries, prefix, held)
    query = np.flatnonzero(low < high)
    low, high, depth = low[query], high[query], prefix[query].astype(np.int64)
    # cells of row d: distance of the d-letter prefix to the query's first d - 1, d and d + 1 letters
    left, middle, right = np.full(len(query), 1), np.zeros(len(query), dtype=np.int64), np.full(len(query), 1)
    right[depth >= length[query]] = FAR
    found_query, found_word = [], []
    while len(query):
        ended = held.sizes[low] == depth
        behind = length[query] - depth  # -1, 0 or 1 where the whole query lies in the band
        distance = np.where(behind == 0, middle, np.where(behind == 1, right, np.where(behind == -1, left, FAR)))
        hit = ended & (distance == 1)
        found_query.append(query[hit])
        found_word.append(low[hit])
        parent, low, high = held.children(low, high, depth)
        query, depth = query[parent], depth[parent] + 1
        left, middle, right = left[parent], middle[parent], right[parent]
        letter = held.flat[held.starts[low] + depth - 1]
        left, middle, right = next_row(flat, starts[query], length[query], depth, letter, left, middle, right)
        alive = np.minimum(np.minimum(left, middle), right) <= 1
        query, low, high, depth = query[alive], low[alive], high[alive], depth[alive]
        left, middle, right = left[alive], middle[alive], right[alive]
    return np.concatenate([np.empty(0, np.int64), *found_query]), np.concatenate([np.empty(0, np.int64), *found_word])


def next_row(flat, starts, length, depth, letter, left, middle, right):
    """The banded row of the prefix one letter longer: cells at query places depth - 1, depth and depth + 1."""

    def differs(place: np.ndarray) -> np.ndarray:
        inside = (place >= 1) & (place <= length)
        seen = flat[np.where(inside, starts + place - 1, 0)] if len(flat) else np.zeros(len(place), np.uint32)
        return np.where(inside, seen != letter, True)

    new_left = np.minimum(left + differs(depth - 1), middle + 1)
    new_middle = np.minimum(np.minimum(middle + differs(depth), right + 1), new_left + 1)
    new_right = np.minimum(right + differs(depth + 1), new_middle + 1)
    new_left = np.where(depth - 1 <= length, new_left, FAR)
    new_middle = np.where(depth <= length, new_middle, FAR)
    new_right = np.where(depth + 1 <= length, new_right, FAR)
    return np.minimum(new_left, FAR), np.minimum(new_middle, FAR), np.minimum(new_right, FAR)


def prefix_ranges(queries: list[str], prefix: np.ndarray, held: SortedList) -> tuple[np.ndarray, np.ndarray]:
    """The run of words that begin with each query's first letters."""
    starts = [q[:p] for q, p in zip(queries, prefix.tolist(), strict=True)]
    words = np.array(held.words, dtype=object)
    low = np.searchsorted(words, np.array(starts, dtype=object), side="left")
    high = np.searchsorted(words, np.array([after(s) for s in starts], dtype=object), side="left")
    return low, high


def after(prefix: str) -> str:
    """A text behind all texts with this prefix."""
    return prefix + chr(0x10FFFF)


# ---- blocks and their queries ----------------------------------------------------------------


def cut_blocks(words: DataFrame, column: str, block_words: int, most_blocks: int) -> DataFrame:
    """(block, low, high, words, counts): the sorted vocabulary in blocks of neighbours, one row a block.

    Spark's range partitioning spreads the sorted list; each partition is cut into blocks of a proven size.
    """
    total = words.count()
    size = max(block_words, -(-total // most_blocks))
    parts = max(-(-total // (4 * size)), 1)
    ordered = words.select(F.col(column).alias("word"), "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    schema = "low string, high string, words array<string>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = [], []

        def block() -> pa.RecordBatch:
            columns = [[held[0][:BORDER]], [held[-1][:BORDER]], [list(held)], [list(counts)]]
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["low", "high", "words", "counts"])

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                held.append(word)
                counts.append(n)
                if len(held) >= size:
                    yield block()
                    held, counts = [], []
        if held:
            yield block()

    return handover(ordered.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "blocks")


def prefix_lengths(words: list[str], reverse: bool) -> np.ndarray:
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    half = np.maximum(sizes - 1, 0) // 2
    return sizes - half if reverse else half


def route(words: DataFrame, column: str, borders: list[tuple[str, str, int]], reverse: bool) -> DataFrame:
    """(block, word): each query word beside every block whose words may share its prefix.

    ``borders`` are the blocks in order; there are at most ``MOST_BLOCKS`` and a few more, each with two borders of at most
    ``BORDER`` letters.
    """
    highs, lows = [b[1] for b in borders], [b[0] for b in borders]
    numbers = np.array([b[2] for b in borders], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = batch.column("word").to_pylist()
            at, rows = [], []
            for i, (word, p) in enumerate(zip(queries, prefix_lengths(queries, reverse).tolist(), strict=True)):
                start = word[: min(p, BORDER)]
                first = bisect_left(highs, start)  # right for cut borders too: no start is longer than they are
                last = bisect_right(lows, after(start))
                rows.extend(range(first, last))
                at.extend([i] * (last - first))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[rows] if rows else [], pa.int64()), batch.column("word").take(pa.array(at, pa.int64()))], names=["block", "word"])

    return words.select(F.col(column).alias("word")).mapInArrow(run, "block long, word string")


def best_near(words: DataFrame, reverse: bool, block_words: int, most_blocks: int, chunk: int) -> DataFrame:
    """(word, n_near, best_n, best): near words by one of the two lists, folded per query and block."""
    spark = words.sparkSession
    lists = words.select(F.reverse("word").alias("word"), "n") if reverse else words
    blocks = cut_blocks(lists, "word", block_words, most_blocks)
    borders = [(r.low, r.high, r.block) for r in blocks.select("low", "high", "block").orderBy("low", "high", "block").collect()]
    routed = handover(route(lists, "word", borders, reverse), "routed")
    sizes = routed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("chunks"))
    held = spark.createDataFrame([tuple(r) for r in sizes.collect()], "block long, chunks long")  # one row a block, as bounded as the borders
    left = routed.join(F.broadcast(held), "block").withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks"))).drop("chunks")
    right = blocks.join(F.broadcast(held), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    out = "word string, n_near long, best_n long, best string"
    kinds = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def walk(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not asked.num_rows or not block.num_rows:
            return kinds.empty_table()
        listed = SortedList(block.column("words")[0].as_py(), np.array(block.column("counts")[0].as_py(), dtype=np.int64))
        queries = asked.column("word").to_pylist()
        found: list[tuple] = []
        for part in bounded(queries):
            prefix = prefix_lengths(part, reverse)
            query, word = near_words(part, prefix, listed)
            found.extend(folded(part, query, word, listed, reverse))
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(walk, out)


def bounded(queries: list[str]) -> Iterator[list[str]]:
    """Queries in lists of about LONG_LETTERS letters."""
    held, size = [], 0
    for q in queries:
        held.append(q)
        size += len(q)
        if size >= LONG_LETTERS:
            yield held
            held, size = [], 0
    if held:
        yield held


def folded(queries: list[str], query: np.ndarray, word: np.ndarray, listed: SortedList, reverse: bool) -> list[tuple]:
    """Per query: number of near words, and the most frequent one (ties: the first in code-point order)."""
    best: dict[int, tuple[int, int, str]] = {}
    turn = slice(None, None, -1) if reverse else slice(None)
    for q, w in zip(query.tolist(), word.tolist(), strict=True):
        near = listed.words[w][turn]
        if reverse:
            own = queries[q][turn]
            half = (len(own) - 1) // 2
            if near[:half] == own[:half]:
                continue  # found by the forward list
        n = int(listed.counts[w])
        seen, top, name = best.get(q, (0, 0, ""))
        if not seen or n > top or (n == top and near < name):
            top, name = n, near
        best[q] = (seen + 1, top, name)
    return [(queries[q][turn], seen, top, name) for q, (seen, top, name) in best.items()]


# ---- forms and roots -------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of forms. A form is at least twice as frequent as its word, so chains are
    shorter than log2 of the largest count; each round doubles the steps taken."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = handover(at.join(step.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return at


def spelling_variants(
    counted: DataFrame, block_words: int = BLOCK_WORDS, most_blocks: int = MOST_BLOCKS, chunk: int = CHUNK_QUERIES, ratio: int = 2
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``counted`` (distinct ``word``, its count ``n``).

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest
    ``n`` (ties: the first in code-point order) if that is at least ``ratio`` times the word's own, else null; ``root``
    follows forms to the last one, or is the word itself. Words of any length are handled, the empty word and null
    have no near words, and an empty table gives none.
    """
    words = handover(counted.filter("word is not null").select("word", "n"), "vocabulary")
    both = [best_near(words, reverse, block_words, most_blocks, chunk) for reverse in (False, True)]
    found = both[0].unionByName(both[1]).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("top")
    )
    joined = words.join(found.hint("merge"), "word", "left")
    count = -F.col("top.less")
    near = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(count >= ratio * F.col("n"), F.struct(F.col("top.form").alias("form"), count.alias("n"))).alias("f"))
    named = handover(near.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")), "forms")
    ends = roots(named.filter("form is not null"))
    return named.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
