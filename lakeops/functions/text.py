"""Text columns: page quality, chunking, identity hashes, offline embeddings, masking."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeops.functions.rules import as_column

# Character classes of the page-quality rule.
NON_LETTERS = r"[^\p{L}]+"
CLEAN_CHARACTERS = r"[\p{L}\p{N} \t\r\n.,;:!?'\"()\-/]+"
NON_TERM = r"[^\p{L}\p{N}]+"


def alpha_ratio(text) -> Column:
    """Share of letters among all characters; 0 for empty or NULL text."""
    t = as_column(text)
    letters = F.length(F.regexp_replace(t, NON_LETTERS, ""))
    return F.coalesce(letters / F.nullif(F.length(t), F.lit(0)), F.lit(0.0))


def noise_ratio(text) -> Column:
    """Share of characters outside letters, digits, blanks and common punctuation."""
    t = as_column(text)
    noise = F.length(F.regexp_replace(t, CLEAN_CHARACTERS, ""))
    return F.coalesce(noise / F.nullif(F.length(t), F.lit(0)), F.lit(0.0))


def chunk_texts(text, size: int, overlap: int) -> Column:
    """Array of fixed windows of ``size`` characters, each starting ``size - overlap`` after the last.

    The last window is the first one that reaches the end; empty text gives an empty array. The text
    is cut once into step-long pieces and each window is glued from its own few pieces, so the cost
    stays linear in the text length (``substring`` per window would walk the text from its start).
    """
    if not 0 <= overlap < size:
        raise ValueError("chunk overlap must be at least 0 and less than the chunk size")
    step = size - overlap
    width = math.ceil(size / step)
    t = as_column(text)
    length = F.length(t)
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    last = F.when(length <= size, F.lit(0)).otherwise(F.ceil((length - size) / step).cast("int"))

    def window_text(position: Column, parts: Column) -> Column:
        return F.substring(F.array_join(F.slice(parts, position + 1, width), ""), 1, size)

    # The pieces ride along as a one-element array so that they are computed once per text.
    windows = F.flatten(
        F.transform(
            F.array(pieces),
            lambda parts: F.transform(F.sequence(F.lit(0), last), lambda i: window_text(i, parts)),
        )
    )
    return F.when(length > 0, windows).otherwise(F.array().cast("array<string>"))


def normalize_text(text) -> Column:
    """Trimmed, single-spaced, lower-case text."""
    return F.lower(F.trim(F.regexp_replace(as_column(text), r"[ \t\r\n]+", " ")))


def text_hash(text) -> Column:
    return F.sha2(as_column(text), 256)


def terms(text) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(as_column(text)), NON_TERM)), "")


def hash_embedding(text, dimensions: int = 8) -> Column:
    """Deterministic offline vector: per dimension, 32 bits of an md5 scaled to [-1, 1]."""
    t = as_column(text)
    scale = float(2**32 - 1)
    parts = [
        F.conv(F.substring(F.md5(F.concat(F.lit(str(i)), t)), 1, 8), 16, 10).cast("double") / scale * 2.0 - 1.0
        for i in range(dimensions)
    ]
    return F.array(*parts)


def unit_vector(vector) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    v = as_column(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / norm)
    )


def masked_text(value, style: str) -> Column:
    """One masked form of a text column: ``full``, ``hash``, ``email`` or ``digits``."""
    v = as_column(value)
    if style == "full":
        return F.mask(v, upperChar=F.lit("X"), lowerChar=F.lit("x"), digitChar=F.lit("n"))
    if style == "hash":
        return F.sha2(v, 256)
    if style == "email":
        return F.regexp_replace(v, r"^[^@]+", "***")
    if style == "digits":
        return F.regexp_replace(v, r"[0-9]", "*")
    raise ValueError(f"unknown masking style: {style}")
