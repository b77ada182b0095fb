"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from a rank file.

No tokenizer is trained: each token of the rank file becomes one piece, its bytes mapped to one character
each, its score the negative rank. Merging the best-scored neighbours is then merging by lowest rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

# Field numbers and enum values of the public sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND, UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, BPE, VOCAB_SIZE = 3, 2, 4
NAME, DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES = 1, 3, 4, 5

BYTE_CHARS = [chr(0x100 + b) for b in range(256)]  # one letter per byte, none of them a space
CACHE_BYTES = 128 << 20  # of remembered pre-tokens in each Python worker


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + pack("<f", x)


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token, rank per line) in rank order; the ranks must be 0..n-1."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes | None] = [None] * len(pairs)
    for token, rank in pairs:
        if not 0 <= int(rank) < len(pairs) or tokens[int(rank)] is not None:
            raise ValueError(f"{path}: ranks are not 0..{len(pairs) - 1}, each once")
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def serialise_model(tokens: list[bytes]) -> bytes:
    """The sentencepiece model whose piece i is token i; the unknown piece comes last."""
    spell = BYTE_CHARS.__getitem__
    parts = [
        _block(PIECES, _block(PIECE, "".join(map(spell, token)).encode()) + _float(SCORE, -float(rank)))
        for rank, token in enumerate(tokens)
    ]
    parts.append(_block(PIECES, _block(PIECE, b"<unk>") + _float(SCORE, 0.0) + _number(KIND, UNKNOWN)))
    parts.append(_block(TRAINER, _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(tokens) + 1)))
    rules = _block(NAME, b"identity") + b"".join(_number(f, 0) for f in (DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES))
    return b"".join([*parts, _block(NORMALIZER, rules)])


class Encoder:
    """Ids (little-endian unsigned 32-bit) of texts; remembers pre-tokens up to a bounded size."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.spell = dict(enumerate(BYTE_CHARS))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, new: list[str]) -> None:
        spelled = [t.encode().decode("latin-1").translate(self.spell) for t in new]
        for token, ids in zip(new, self.processor.encode(spelled, out_type=int, num_threads=1), strict=True):
            self.known[token] = coded = pack(f"<{len(ids)}I", *ids)
            self.held += len(token) + len(coded) + 160

    def encode(self, texts: list[str]) -> list[bytes]:
        """One model call for the new pre-tokens of all the texts."""
        split = [self.split(text) for text in texts]
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, tokens)) for tokens in split]


def groups(texts: pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    """Neighbouring texts (null: empty) in lists of about ``limit`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    yield held


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(model: bytes, pattern: str) -> Encoder:
    """The encoder of this Python worker."""
    key = (hash(model), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model, pattern)
    return _encoders[key]


def encode(text: Column | str, tokens: list[bytes], pattern: str) -> Column:
    """Ids of each text, as the bytes of little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded apart; nothing is added. Null and empty texts give no ids; any
    length works (a task holds one Arrow batch and the bounded memory of pre-tokens).
    """
    model = serialise_model(tokens)

    def run(texts: pa.Array) -> pa.Array:
        coder = _encoder(model, pattern)
        return pa.array([ids for group in groups(texts) for ids in coder.encode(group)], type=pa.binary())

    return F.arrow_udf(run, "binary")(text)


def decode(ids: Column | str, tokens: list[bytes]) -> Column:
    """Bytes of each id sequence by the inverse mapping; a null sequence decodes to no bytes."""
    table = list(tokens)

    def run(rows: pa.Array) -> pa.Array:
        of = table.__getitem__
        return pa.array(
            [b"".join(map(of, np.frombuffer(r.as_py(), dtype="<u4").tolist())) if r.is_valid else b"" for r in rows],
            type=pa.binary(),
        )

    return F.arrow_udf(run, "binary")(ids)


def round_trip(text: Column | str, tokens: list[bytes], pattern: str) -> Column:
    """Struct (ids, decoded) of each text: encoded once, and these ids decoded again by the inverse mapping.

    Both leave one function, as two chained ones would be planned apart and encode every text twice.
    """
    model, table = serialise_model(tokens), list(tokens)

    def run(texts: pa.Array) -> pa.Array:
        coder, of = _encoder(model, pattern), table.__getitem__
        ids, back = [], []
        for group in groups(texts):
            for coded in coder.encode(group):
                ids.append(coded)
                back.append(b"".join(map(of, np.frombuffer(coded, dtype="<u4").tolist())))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["ids", "decoded"])

    return F.arrow_udf(run, "ids binary, decoded binary")(text)


def n_tokens(ids: Column | str) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
