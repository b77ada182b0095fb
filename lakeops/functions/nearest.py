"""Arrow kernels that keep the best chunks per question inside one task.

Spark splits, ships and merges the data. A kernel scores a slice of chunks against the questions it holds and
lets in only what beats each question's last kept score, so a slice without such an entry sorts nothing.
Chunks are handled by their place in id order; ids come back at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGITS = 12
SLACK = 10.0**-DIGITS  # rounding to DIGITS moves a score by less
CELLS = 4_000_000
FIRST_ROWS = 128  # of the first slice of a task; the following ones double
DENSE_ROWS = 512  # first chunks of a task without bars, scored against every question
GROWTH = 6  # of the slices after them
ROW_SHARE = 1024  # a word in one of so many chunks has a row of bits
ROWS_BYTES = 32 << 20  # of all rows of bits in a task
BATCH_BYTES = 64 << 10  # of one plane of the questions counted at a time
WORD_END = "\x1f"  # between words that move as one string
SET_SHARE = 0.005  # 64 words become one bit set while their squared shares of the questions add up to this
MOST_SETS = 8
CELL_ROWS = 256  # chunks of one cell inside a task, on average
FIRST_CELLS = 4  # cells a question without a bar looks at first
MARGIN = 1e-7  # what rounding can take from a bound


@dataclass
class Questions:
    """Questions held by a task: ids, how many chunks each asks for and keeps, unit vectors, and their words as an
    inverted index (vectors and words may be absent).

    ``words`` are sorted by falling number of questions. The first 64 x ``sets.shape[0]`` of them are bits of one number per
    question and set; the postings of word i, ``posting_questions[posting_offsets[i]:posting_offsets[i + 1]]``, serve the others.
    """

    ids: pa.Array
    asked: np.ndarray
    keep: np.ndarray
    vectors: np.ndarray | None = None
    words: pa.Array | None = None
    sets: np.ndarray | None = None
    posting_offsets: np.ndarray | None = None
    posting_questions: np.ndarray | None = None

    @classmethod
    def from_table(cls, table: pa.Table, depth: int = 0) -> Questions:
        """Columns ``query_id``, ``k`` and optionally ``vector`` and ``terms``; at least ``depth`` are kept."""
        asked = table.column("k").to_numpy()
        result = cls(table.column("query_id").combine_chunks(), asked, np.maximum(asked, depth))
        if "vector" in table.column_names:
            result.vectors = unit_rows(to_matrix(table.column("vector").combine_chunks()))
        if "terms" in table.column_names:
            result._index(table.column("terms").combine_chunks())
        return result

    def _index(self, lists: pa.Array) -> None:
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        encoded = pc.dictionary_encode(lists.flatten())
        codes, count = encoded.indices.to_numpy(), len(encoded.dictionary)
        asking = np.bincount(codes, minlength=count)
        by_count = np.argsort(-asking, kind="stable")
        place = np.empty(count, dtype=np.int64)
        place[by_count] = np.arange(count)
        codes = place[codes]
        order = np.argsort(codes, kind="stable")
        self.words = encoded.dictionary.take(pa.array(by_count))
        self.posting_questions = owner[order]
        self.posting_offsets = np.searchsorted(codes[order], np.arange(count + 1))
        shares = (asking[by_count] / max(len(lists), 1)) ** 2
        worth = np.add.reduceat(shares, np.arange(0, count, 64)) >= SET_SHARE if count else np.empty(0, bool)
        self.sets = np.zeros((min(int(worth.sum()), MOST_SETS), len(lists)), dtype=np.uint64)
        for s, bits in enumerate(self.sets):
            own = slice(self.posting_offsets[64 * s], self.posting_offsets[min(64 * (s + 1), count)])
            np.add.at(bits, self.posting_questions[own], np.uint64(1) << (codes[order][own] - 64 * s).astype(np.uint64))


def to_matrix(lists: pa.Array) -> np.ndarray:
    if len(pc.unique(pc.list_value_length(lists))) > 1:
        raise ValueError("vectors of different lengths cannot be compared")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def overlap_scores(questions: Questions, batch: pa.RecordBatch) -> np.ndarray:
    """Number of shared distinct words of every chunk and question: the set bits both have, and for all other
    words one for each posting."""
    lists, count = batch.column("terms"), len(questions.ids)
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    found = pc.index_in(lists.flatten(), value_set=questions.words)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    word = pc.drop_null(found).to_numpy().astype(np.int64)
    rows = rows[known]
    shared = np.zeros((len(lists), count), dtype=np.int32)
    for s, asked in enumerate(questions.sets):
        own = word // 64 == s
        bits = np.zeros(len(lists), dtype=np.uint64)
        np.add.at(bits, rows[own], np.uint64(1) << (word[own] - 64 * s).astype(np.uint64))
        shared += np.bitwise_count(bits[:, None] & asked[None, :])
    rare = word >= 64 * len(questions.sets)
    rows, word = rows[rare], word[rare]
    start, length = questions.posting_offsets[word], np.diff(questions.posting_offsets)[word]
    flat = shared.reshape(-1)
    for part in bounded(length):
        n = length[part]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = questions.posting_questions[np.repeat(start[part], n) + within]
        np.add.at(flat, np.repeat(rows[part], n) * count + hit, 1)
    return shared


def bounded(lengths: np.ndarray) -> Iterator[slice]:
    """Consecutive runs whose lengths add up to about ``CELLS``; a longer entry is a run of its own."""
    before = np.cumsum(lengths) - lengths
    edges = np.unique(np.concatenate([np.searchsorted(before // CELLS, np.unique(before // CELLS)), [len(lengths)]]))
    return (slice(a, b) for a, b in zip(edges[:-1], edges[1:]))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of every entry, end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


STEP_BITS = 41


def cosine_steps(score: np.ndarray) -> np.ndarray:
    """Rounded cosines as whole numbers below 2 ** STEP_BITS, the best ones smallest."""
    return np.rint((1.0 - score) * 10**DIGITS).astype(np.int64) + 8


def count_steps(score: np.ndarray) -> np.ndarray:
    """The same for numbers of shared words."""
    return (1 << STEP_BITS - 1) - score.astype(np.int64)


class Best:
    """Best chunks per question so far, by falling score, then place; question q has the slots ``starts[q]`` to
    ``starts[q] + keep[q] - 1``. ``floor`` is the score a chunk must beat in any case."""

    def __init__(self, keep: np.ndarray, floor: float | np.ndarray = -np.inf, steps: Callable[[np.ndarray], np.ndarray] | None = None):
        self.keep, self.floor, self.steps = keep, floor, steps or cosine_steps
        self.starts = np.cumsum(keep) - keep
        self.scores = np.full(int(keep.sum()), -np.inf)
        self.places = np.full(int(keep.sum()), -1, dtype=np.int64)
        self.sorts = 0

    @property
    def bars(self) -> np.ndarray:
        """What a later chunk has to beat: the last kept score, as equal scores rank by place."""
        return np.maximum(self.scores[self.starts + self.keep - 1], self.floor)

    def add(self, scores: np.ndarray, first: int) -> None:
        """Scores of a slice: chunks (rows, the first at place ``first``) by questions (columns)."""
        bars = self.bars
        row, question = np.nonzero(scores > bars - SLACK)
        found = np.round(scores[row, question], DIGITS)
        enters = found > bars[question]
        row, question, found = row[enters], question[enters], found[enters]
        if len(question):
            self.merge(question, first + row, found)

    def merge(self, question: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        """Entries that enter, of later places than the kept ones, each question's by place."""
        touched = np.flatnonzero(np.bincount(question))
        if len(touched) > 1 and len(question) + self.keep[touched].sum() > CELLS // 2:
            first = question < touched[len(touched) // 2]
            for half in (first, ~first):
                self.merge(question[half], place[half], score[half])
            return
        self.sorts += 1
        slots = ranges(self.starts[touched], self.keep[touched])
        filled = self.places[slots] >= 0
        slots, owner = slots[filled], np.repeat(touched, self.keep[touched])[filled]
        question, place, score = (np.concatenate(p) for p in ((owner, question), (self.places[slots], place), (self.scores[slots], score)))
        # one key for question and score; kept entries come first and have earlier places, so a stable sort breaks ties by place
        order = np.argsort((question << STEP_BITS) | self.steps(score), kind="stable")
        question = question[order]
        counts = np.bincount(question)
        rank = np.arange(len(order)) - (np.cumsum(counts) - counts)[question]
        kept = rank < self.keep[question]
        target, order = self.starts[question[kept]] + rank[kept], order[kept]
        self.scores[target], self.places[target] = score[order], place[order]

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, place, score) of all filled slots, in order."""
        filled = self.places >= 0
        return np.repeat(np.arange(len(self.keep)), self.keep)[filled], self.places[filled], self.scores[filled]


def rank_chunks(
    chunks: pa.Table, questions: Questions, bars: np.ndarray | None = None, bar_ids: pa.Array | None = None
) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of the chunks in order, and the best (question, place, score) by number of shared words. With ``bars``, a score (0: none)
    and a chunk id per question, only what ranks before them.

    Without bars the first chunks are scored one by one against all questions, and slices grow, so that the lists they fill shut
    out most of the later ones. Slices after that are counted by :class:`WordRows`.
    """
    chunks = chunks.take(pc.sort_indices(chunks, [("chunk_id", "ascending")]))
    ids, lists, count = chunks.column("chunk_id").combine_chunks(), chunks.column("terms").combine_chunks(), len(questions.ids)
    bars = np.zeros(count) if bars is None else bars
    best = Best(questions.keep, 0.0, count_steps)
    before = places_before(ids, bar_ids) if bar_ids is not None else np.full(count, len(ids))
    at = 0
    if not bars.any():
        most = max(1, CELLS // max(1, count))
        while at < min(DENSE_ROWS, len(ids)):
            part = lists.slice(at, min(max(at, FIRST_ROWS), most, DENSE_ROWS - at))
            best.add(overlap_scores(questions, compact(pa.record_batch({"terms": part}))), at)
            at += len(part)
    place, word = known_words(lists.slice(at), questions.words)
    asked = AskedWords.of(questions, word)
    place += at
    word = asked.rank[word]
    while at < len(ids):
        end = min(GROWTH * at, len(ids)) if at else len(ids)
        own = slice(*np.searchsorted(place, [at, end]))
        rows = WordRows(place[own] - at, word[own], end - at, len(asked.rank))
        parts, pending = [], 0
        beaten = np.maximum(bars, best.bars)
        for question, found, score in rows.reach(asked, beaten.astype(np.int64), np.where(best.bars < bars, before - at, 0)):
            parts.append((question, found + at, score.astype(float)))
            pending += len(question)
            if pending > CELLS // 4:
                best.merge(*(np.concatenate(x) for x in zip(*parts)))
                parts, pending = [], 0
        if pending:
            best.merge(*(np.concatenate(x) for x in zip(*parts)))
        at = end
    return ids, best.lists()


def unpacked(table: pa.Table) -> pa.Table:
    """``terms`` of every row, from the strings ``joined`` where it is NULL."""
    kept, at = table.column("terms"), table.schema.get_field_index("terms")
    lists = pc.split_pattern(table.column("joined"), WORD_END).cast(kept.type)
    lists = lists if kept.null_count == len(kept) else pc.coalesce(kept, lists)
    return table.set_column(at, "terms", lists).drop_columns("joined")


def known_words(lists: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every word in ``lists`` that is one of ``words``."""
    rows = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    found = pc.index_in(lists.flatten(), value_set=words)
    return rows[found.is_valid().to_numpy(zero_copy_only=False)], pc.drop_null(found).to_numpy()


@dataclass
class AskedWords:
    """The words of each question, ``words[offsets[q]:offsets[q + 1]]``, as ranks by falling number of chunks that have them;
    ``rank`` turns a word's number into its rank."""

    rank: np.ndarray
    offsets: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, questions: Questions, word: np.ndarray) -> AskedWords:
        """``word`` has the word numbers of all chunks."""
        count = len(questions.words)
        rank = np.empty(count, dtype=np.int32)
        rank[np.argsort(-np.bincount(word, minlength=count), kind="stable")] = np.arange(count)
        owner = questions.posting_questions
        words = np.repeat(rank, np.diff(questions.posting_offsets))
        order = np.lexsort((words, owner))
        return cls(rank, np.searchsorted(owner[order], np.arange(len(questions.ids) + 1)), words[order])


class WordRows:
    """Which chunks of a slice have which word: a row of bits per frequent word, places in a list for the others.

    Rows are added as they are, 64 chunks at a time: bit j of every chunk's number of shared words stands in plane j.
    """

    def __init__(self, place: np.ndarray, word: np.ndarray, size: int, words: int):
        """``place`` and ``word``, a rank by falling frequency, of every word in ``size`` chunks."""
        counts = np.bincount(word, minlength=words)
        self.width = -(-size // 64)
        self.rows = min(int((counts * ROW_SHARE >= size).sum()), ROWS_BYTES // (8 * self.width))
        frequent = word < self.rows
        self.bits = np.zeros((self.rows + 1, self.width), dtype=np.uint64)  # the last row stays empty
        set_bits(self.bits.reshape(-1), word[frequent] * np.int64(64 * self.width) + place[frequent])
        shift = np.int64(int(size).bit_length())
        listed = np.sort((word[~frequent] << shift) | place[~frequent])
        self.places = listed & ((1 << shift) - 1)
        self.starts = np.concatenate([np.zeros(self.rows + 1, np.int64), np.cumsum(counts[self.rows :])])

    def reach(self, asked: AskedWords, beaten: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(question, place, score) of all chunks that share more than ``beaten`` words, or as many and have a place below
        ``before``, by question and place, some questions at a time."""
        length = np.diff(asked.offsets)
        owner = np.repeat(np.arange(len(length)), length)
        frequent = np.bincount(owner[asked.words < self.rows], minlength=len(length))
        able = np.flatnonzero(length >= beaten + (before <= 0))
        able = able[np.argsort(frequent[able], kind="stable")]
        size = max(1, BATCH_BYTES // (8 * self.width))
        for at in range(0, len(able), size):
            some = able[at : at + size]
            planes = self._planes(asked.words, asked.offsets[some], frequent[some], length[some])
            own, place, score = reaching(planes, beaten[some], before[some], self.width)
            yield some[own], place, score

    def _planes(self, words: np.ndarray, starts: np.ndarray, frequent: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        levels = []
        turn = np.arange(int(frequent.max(initial=0)))[:, None]
        for row in np.where(turn < frequent, words[np.minimum(starts + turn, len(words) - 1)], self.rows):
            add_bits(levels, self.bits.take(row, axis=0), 0)
        rare = length - frequent
        word = words[ranges(starts + frequent, rare)]
        sizes = self.starts[word + 1] - self.starts[word]
        owner = np.repeat(np.repeat(np.arange(len(starts)), rare), sizes)
        hits = np.sort(owner * (64 * self.width) + self.places[ranges(self.starts[word], sizes)])
        first = np.flatnonzero(np.append(True, hits[1:] != hits[:-1])[: len(hits)])
        counts = np.diff(first, append=len(hits))
        for j in range(int(counts.max(initial=0)).bit_length()):
            row = np.zeros((len(starts), self.width), dtype=np.uint64)
            set_bits(row.reshape(-1), hits[first[counts >> j & 1 == 1]])
            add_bits(levels, row, j)
        return settled(levels)


def set_bits(flat: np.ndarray, at: np.ndarray) -> None:
    """Set bits of an array of 64-bit numbers by their places, each named once."""
    for part in steps(len(at), 1):
        np.add.at(flat, at[part] >> 6, np.uint64(1) << (at[part] & 63).astype(np.uint64))


def add_bits(levels: list[list[np.ndarray]], row: np.ndarray, level: int) -> None:
    """Add bits that are worth 2 ** level to ``levels``; three rows of one level become a row there and a carried one. Rows are
    written over."""
    while True:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(row)
        if len(levels[level]) < 3:
            return
        a, b, c = levels[level]
        one = a ^ b
        a &= b
        np.bitwise_and(one, c, out=b)
        a |= b
        one ^= c
        levels[level], row, level = [one], a, level + 1


def settled(levels: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One row per level, with the same sum."""
    level = 0
    while level < len(levels):
        if len(levels[level]) == 2:
            a, b = levels[level]
            levels[level] = [a ^ b]
            add_bits(levels, a & b, level + 1)
        level += 1
    return [rows[0] if rows else np.zeros_like(levels[-1][0]) for rows in levels]


def reaching(planes: list[np.ndarray], beaten: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, number) where the number whose bits are ``planes`` is more than the row's ``beaten``, or the same at a place
    below ``before``."""
    every, none = ~np.uint64(0), np.uint64(0)
    above = np.zeros((len(beaten), width), dtype=np.uint64)
    equal = np.where(beaten >> len(planes) == 0, every, none)[:, None] | above
    for j in reversed(range(len(planes))):
        differs = planes[j] ^ np.where(beaten >> j & 1 == 1, every, none)[:, None]
        higher = equal & differs
        equal ^= higher
        higher &= planes[j]
        above |= higher
    for row, end in zip(equal, np.clip(before, 0, 64 * width).tolist()):
        row[end >> 6 : (end >> 6) + 1] &= np.uint64((1 << (end & 63)) - 1)
        row[(end >> 6) + 1 :] = 0
    above |= equal
    above = above.reshape(-1)
    some = np.flatnonzero(above)
    bits = np.flatnonzero(np.unpackbits(above[some].astype("<u8").view(np.uint8), bitorder="little"))
    at, bit = some[bits >> 6], (bits & 63).astype(np.uint64)
    number = np.zeros(len(at), dtype=np.int64)
    for j, plane in enumerate(planes):
        number |= (plane.reshape(-1)[at] >> bit & np.uint64(1)).astype(np.int64) << j
    return at // width, at % width * 64 + (bits & 63), number


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's pivot of highest cosine, and its angle to it."""
    if len(vectors) and vectors.shape[1] != pivots.shape[1]:
        raise ValueError("vectors of different lengths cannot be compared")
    own, angle = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
    for part in steps(len(vectors), len(pivots)):
        cosines = vectors[part] @ pivots.T
        own[part] = cosines.argmax(axis=1)
        angle[part] = np.arccos(np.clip(cosines.max(axis=1), -1.0, 1.0))
    return own, angle


def steps(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` that make about a quarter of ``CELLS`` with ``width`` columns."""
    size = max(1, CELLS // 4 // max(1, width))
    return (slice(at, min(at + size, rows)) for at in range(0, rows, size))


def cosine_bounds(cosines: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Highest cosine that any vector of a cell (columns) can have to a question (rows), given the questions' cosines to
    the pivots. A cell holds the vectors whose nearest pivot is its own, within ``radius`` (an angle, -1 if it is empty).

    The first bound is the triangle inequality of angles. The second: a cell lies beyond the bisector between its pivot
    and the question's nearest one, and a point at distance d from the question has no higher cosine than sqrt(1 - d * d).
    """
    upper = np.cos(np.maximum(np.arccos(np.clip(cosines, -1.0, 1.0)) - radius, 0.0))
    own = cosines.argmax(axis=1)
    square = (pivots**2).sum(axis=1)
    apart = np.sqrt(np.maximum(square[own][:, None] + square[None, :] - 2.0 * (pivots[own] @ pivots.T), 0.0))
    distance = np.divide(cosines.max(axis=1)[:, None] - cosines, apart, out=np.zeros_like(cosines), where=apart > 1e-4)
    upper = np.minimum(upper, np.sqrt(np.maximum(1.0 - distance**2, 0.0)))
    return np.where(radius >= 0, upper, -np.inf)


class Found:
    """Candidates per question, cut to the best whenever they are many. ``bars`` are scores that a question's last chunk
    reaches in any case; lower ones stay out, equal ones rank by place."""

    def __init__(self, keep: np.ndarray, bars: np.ndarray):
        self.keep, self.bars = keep, bars.copy()
        self.parts, self.pending = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0

    def add(self, scores: np.ndarray, places: np.ndarray, questions: np.ndarray) -> None:
        """Scores of some chunks (rows) and questions (columns)."""
        row, column = np.nonzero(scores >= self.bars[questions] - SLACK)
        question, score = questions[column], np.round(scores[row, column], DIGITS)
        kept = score >= self.bars[question]
        self.parts.append((question[kept], places[row[kept]], score[kept]))
        self.pending += int(kept.sum())
        if self.pending > CELLS // 4:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, place, score) of the best so far, in order; full lists raise their question's bar."""
        question, place, score, rank = first_of(*(np.concatenate(x) for x in zip(*self.parts)), self.keep)
        last = rank == self.keep[question]
        self.bars[question[last]] = np.maximum(self.bars[question[last]], score[last])
        self.parts, self.pending = [(question, place, score)], 0
        return self.parts[0]


def rank_near(chunks: pa.Table, questions: Questions, bars: np.ndarray) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of the chunks in order, and the best (question, place, score) by cosine that reach the questions' ``bars``.

    The chunks are grouped around every ``CELL_ROWS``-th of them; a question meets the cells whose bound reaches its bar.
    """
    chunks = chunks.take(pc.sort_indices(chunks, [("chunk_id", "ascending")]))
    vectors = unit_rows(to_matrix(chunks.column("vector").combine_chunks()))
    pivots = np.unique(vectors[::CELL_ROWS], axis=0)
    if questions.vectors.shape[1] != pivots.shape[1]:
        raise ValueError("vectors of different lengths cannot be compared")
    cell, angle = nearest_pivots(vectors, pivots)
    order = np.argsort(cell, kind="stable")
    starts = np.searchsorted(cell[order], np.arange(len(pivots) + 1))
    radius = np.full(len(pivots), -1.0)
    np.maximum.at(radius, cell, angle)
    found = Found(questions.keep, bars)

    def visit(meets: np.ndarray, first: int) -> None:
        for j in np.flatnonzero(meets.any(axis=0)):
            asking = np.flatnonzero(meets[:, j]) + first
            for part in steps(starts[j + 1] - starts[j], len(asking)):
                places = order[starts[j] + part.start : starts[j] + part.stop]
                found.add(vectors[places] @ questions.vectors[asking].T, places, asking)

    for part in steps(len(questions.ids), len(pivots)):
        cosines = questions.vectors[part] @ pivots.T
        seen = np.zeros(cosines.shape, dtype=bool)
        unbarred = np.isneginf(found.bars[part])
        if unbarred.any():
            count = min(FIRST_CELLS, len(pivots))
            np.put_along_axis(seen, np.argpartition(-cosines, count - 1, axis=1)[:, :count], True, axis=1)
            seen[~unbarred] = False
            visit(seen, part.start)
            found.settle()
        visit((cosine_bounds(cosines, pivots, radius) >= found.bars[part][:, None] - MARGIN) & ~seen, part.start)
    return chunks.column("chunk_id").combine_chunks(), found.settle()


def places_before(ids: pa.Array, bar_ids: pa.Array) -> np.ndarray:
    """How many of the sorted ``ids`` come before each bar's chunk id; all where it is NULL."""
    known = bar_ids.is_valid().to_numpy(zero_copy_only=False)
    places = np.full(len(bar_ids), len(ids), dtype=np.int64)
    places[known] = np.searchsorted(ids.to_numpy(zero_copy_only=False), bar_ids.filter(bar_ids.is_valid()).to_numpy(zero_copy_only=False))
    return places


def compact(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rebuild sliced list columns so that their offsets start at zero."""
    return batch.take(pa.array(np.arange(batch.num_rows)))


def list_rows(ids: pa.Array, state: Best, questions: Questions, ranker: str, schema: pa.Schema) -> pa.RecordBatch:
    """One row per question with a list: ids and scores of its best chunks."""
    question, place, score = state.lists()
    return merged_rows(questions.ids, ids, (question, place, score, None), questions.asked, ranker, schema)


def merged_rows(queries: pa.Array, ids: pa.Array, found: tuple, asked: np.ndarray, ranker: str, schema: pa.Schema) -> pa.RecordBatch:
    """Merged lists of one ranker as list rows again."""
    question, chunk, score, _ = found
    own, first = np.unique(question, return_index=True)
    offsets = pa.array(np.append(first, len(question)).astype(np.int32))
    values = {
        "query_id": queries.take(pa.array(own)),
        "ranker": pa.array([ranker] * len(own), pa.string()),
        "k": pa.array(asked[own].astype(np.int32)),
        "chunk_ids": pa.ListArray.from_arrays(offsets, ids.take(pa.array(chunk))),
        "scores": pa.ListArray.from_arrays(offsets, pa.array(score, pa.float64())),
    }
    return pa.RecordBatch.from_arrays([values[f.name].cast(f.type) for f in schema], schema=schema)


def with_fragment(rows: pa.RecordBatch, some: pa.Table, schema: pa.Schema) -> pa.Table:
    """The list rows of a group with its fragment in front."""
    table = pa.Table.from_batches([rows])
    return table.add_column(0, schema.field(0), pa.array([some.column("fragment")[0].as_py()] * table.num_rows, pa.int64()))


def merge_lists(lists: pa.Table, depth: int) -> tuple[pa.Array, pa.Array, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Merge the lists of several fragments: ids of the questions and chunks they name, per ranker (question, chunk,
    score, rank) by question and rank, and how many each question asks for."""
    queries = pc.dictionary_encode(lists.column("query_id").combine_chunks())
    chunk_lists = lists.column("chunk_ids").combine_chunks()
    chunks = pc.dictionary_encode(chunk_lists.flatten())
    by_id = pc.sort_indices(chunks.dictionary).to_numpy()
    place = np.empty(len(by_id), dtype=np.int64)
    place[by_id] = np.arange(len(by_id))
    sizes = np.diff(chunk_lists.offsets.to_numpy())
    question = np.repeat(queries.indices.to_numpy(), sizes)
    chunk = place[chunks.indices.to_numpy()]
    score = lists.column("scores").combine_chunks().flatten().to_numpy()
    asked = np.zeros(len(queries.dictionary), dtype=np.int64)
    asked[queries.indices.to_numpy()] = lists.column("k").to_numpy()
    ranker = np.repeat(np.array(lists.column("ranker").to_pylist(), dtype=object), sizes)
    merged = {}
    for name in sorted(set(lists.column("ranker").to_pylist())):
        own = np.flatnonzero(ranker == name)
        merged[name] = first_of(question[own], chunk[own], score[own], np.maximum(asked, depth))
    return queries.dictionary, chunks.dictionary.take(pa.array(by_id)), merged, asked


def first_of(question: np.ndarray, chunk: np.ndarray, score: np.ndarray, keep: np.ndarray):
    """(question, chunk, score, rank) of the first ``keep`` entries per question by score, then chunk; ranks start at 1."""
    order = np.lexsort((chunk, -score, question))
    question = question[order]
    rank = np.arange(len(order)) - np.searchsorted(question, question) + 1
    kept = rank <= keep[question]
    return question[kept], chunk[order][kept], score[order][kept], rank[kept]


def fuse(merged: dict, n_chunks: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, chunk, score): the sum of 1 / (offset + rank) over the rankers' lists, to DIGITS digits."""
    question, chunk, rank = (np.concatenate([m[i] for m in merged.values()]) for i in (0, 1, 3))
    cells, where = np.unique(question * n_chunks + chunk, return_inverse=True)
    score = np.bincount(where, weights=1.0 / (offset + rank), minlength=len(cells))
    return cells // max(n_chunks, 1), cells % max(n_chunks, 1), np.round(score, DIGITS)
