"""Byte-level BPE encoding and decoding with a sentencepiece model written from a rank file.

The model is serialised here, field by field: one piece for each rank, in rank
order, scored by its negative rank, so that the merge order of sentencepiece is
that of the ranks; bytes stand as letters from U+0100 on, so that no piece holds
white space; normalisation is the identity. Texts are cut into pre-tokens by
the pattern of the rank file and each pre-token is encoded on its own. Decoding
maps ids to pieces and their letters back to bytes.

Null texts count as empty: no ids, no bytes. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Letters that stand for the 256 bytes: U+0100 to U+01FF.
_TO_LETTER = {b: 0x100 + b for b in range(256)}
_TO_BYTE = {0x100 + b: b for b in range(256)}

#: Pre-tokens remembered by each worker before it starts afresh; characters encoded at a time.
MEMO, PORTION = 500_000, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes as length-delimited, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE ModelProto whose ids are the ranks; the unknown piece comes after them."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    pieces = [_field(1, _field(1, letters(p).encode()) + _field(2, float(-i))) for i, p in enumerate(order)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(order) + 1) + _field(40, len(order))
    # Identity: no dummy prefix, no removal of white space, no escaping of it.
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_LETTER)


class ByteBpe:
    """Encoder and decoder; pre-tokens met before come from a memo of bounded size."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(read_ranks(ranks_path)))
        n = self.model.get_piece_size() - 1
        self.bytes_of = [self.model.id_to_piece(i).translate(_TO_BYTE).encode("latin-1") for i in range(n)]
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit integers in the machine's order; pre-tokens new to the memo are encoded in one call."""
        tokens = [self.split(t) if t else [] for t in texts]
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list(set().union(*tokens).difference(memo))
        found = self.model.encode([letters(t.encode()) for t in new], num_threads=1) if new else []
        memo.update(zip(new, (array("i", ids).tobytes() for ids in found), strict=True))
        return [b"".join(map(memo.__getitem__, own)) for own in tokens]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


def _portions(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column in lists of about PORTION characters."""
    held, size = [], 0
    for t in column:
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size > PORTION:
            yield held
            held, size = [], 0
    yield held


def _added(df: DataFrame, name: str, kind: T.DataType, batches) -> DataFrame:
    rest = [f for f in df.schema.fields if f.name != name]
    return df.select(*[f"`{f.name}`" for f in df.schema.fields]).mapInArrow(batches, T.StructType([*rest, T.StructField(name, kind)]))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of its text as array<int> in column ids (replacing one of that name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for b in batches:
            values, offsets = [], [0]
            for texts in _portions(b.column(b.schema.get_field_index(text))):
                for own in codec.encode(texts):
                    values.append(own)
                    offsets.append(offsets[-1] + len(own) // 4)
            flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(values))])
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield _with(b, ids, made)

    return _added(df, ids, T.ArrayType(T.IntegerType()), run)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """df with the bytes that its ids stand for in binary column data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids))
            flat, ends = column.flatten().to_numpy(), np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False))).astype(int)
            own = (codec.decode(flat[s:e].tolist()) for s, e in zip([0, *ends[:-1]], ends, strict=True))
            yield _with(b, data, pa.array(own, pa.binary()))

    return _added(df, data, T.BinaryType(), run)


def _with(b: pa.RecordBatch, name: str, made: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(b.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), made], [*(b.schema.names[i] for i in keep), name])
