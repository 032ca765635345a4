"""Who is in a table of keys: by a bitmap of hashed keys, bounded in size and with no false negative, or by a shuffle where the keys are too many for it.
How often keys occur, about: by a bounded table of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, unused

#: Bits for each key, and the bounds of their number as powers of two (2 ** 27 bits are 16 MiB).
PER_KEY, LEAST, MOST = 16, 16, 27
#: With fewer bits for each key than this a bitmap lets too many strangers pass to be of use.
SPARSE = 4
PAGES = 256
#: Bytes for each counted key, and the greatest power of two that their number may be (16 MiB).
PER_COUNT, MOST_COUNTS = 4, 24
_SALT = np.uint64(0x5851F42D4C957F2D)


def fits(count: int) -> bool:
    """Whether a bitmap of so many keys tells them from strangers."""
    return count * SPARSE <= 1 << MOST


def _bits(h: np.ndarray, power: int) -> np.ndarray:
    return mix64(h.view(np.uint64) ^ _SALT) >> np.uint64(64 - power)


def bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """Bitmap of a table with one long column of count keys. However many there are, its size is bounded;
    beyond 2 ** MOST / PER_KEY keys it only lets more strangers pass."""
    power = min(MOST, max(LEAST, (count * PER_KEY).bit_length()))
    width = (1 << power) // PAGES // 8

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _bits(np.asarray(b.column(0)), power)
            page = (at // np.uint64(width * 8)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(page), pa.array((at % np.uint64(width * 8)).astype(np.int32))], ["page", "bit"])

    def page(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(width * 8, np.uint8)
        for b in rows:
            own[np.asarray(b.column(1))] = 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()])], ["page", "bits"])

    out = np.zeros(PAGES * width, np.uint8)
    for r in keys.mapInArrow(paged, "page int, bit int").groupBy("page").applyInArrow(page, "page int, bits binary").collect():  # PAGES rows
        out[r["page"] * width : (r["page"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def contains(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bits(h, (len(bits) * 8).bit_length() - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def levels(counts: DataFrame, count: int) -> np.ndarray:
    """A byte by hash of the count keys of counts (h long, n > 1): it grows with the logarithm of n, the largest of the keys that share it, and is 0 only
    where no key is. However many there are, its size is bounded; beyond 2 ** MOST_COUNTS / PER_COUNT keys it only tells rare keys less well apart."""
    power = min(MOST_COUNTS, max(LEAST, (count * PER_COUNT).bit_length()))
    width = (1 << power) // PAGES

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _bits(np.asarray(b.column(0)), power)
            level = np.minimum(255, 16 * np.log2(np.asarray(b.column(1)))).astype(np.int16)
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(width)).astype(np.int32)), pa.array((at % np.uint64(width)).astype(np.int32)), pa.array(level)], ["page", "at", "level"])

    def page(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(width, np.uint8)
        for b in rows:
            np.maximum.at(own, np.asarray(b.column(1)), np.asarray(b.column(2)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([own.tobytes()])], ["page", "levels"])

    out = np.zeros(PAGES * width, np.uint8)
    for r in counts.select("h", "n").mapInArrow(paged, "page int, at int, level short").groupBy("page").applyInArrow(page, "page int, levels binary").collect():  # PAGES rows
        out[r["page"] * width : (r["page"] + 1) * width] = np.frombuffer(r["levels"], np.uint8)
    return out


def levels_of(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return table[_bits(h, len(table).bit_length() - 1)]


def parted(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two parts by a long column: rows whose key may be in the one column of ids (a written table), and rows whose key isn't or is null."""
    count = ids.count()
    if not fits(count):
        (name,) = unused(df.columns, "_id")
        own = ids.toDF(name).distinct()
        same = F.col(key).cast("long") == F.col(name)
        return df.join(own, same, "left_semi"), df.join(own, same, "left_anti")
    bits = df.sparkSession.sparkContext.broadcast(bitmap(ids, count))

    @F.pandas_udf("boolean")
    def may(values):
        import pandas as pd

        return pd.Series(contains(bits.value, values.to_numpy().astype(np.int64)))

    (hit,) = unused(df.columns, "_hit")
    marked = df.withColumn(hit, may(F.coalesce(F.col(key).cast("long"), F.lit(0))) & F.col(key).isNotNull())
    return marked.where(F.col(hit)).drop(hit), marked.where(~F.col(hit)).drop(hit)
