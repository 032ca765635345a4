"""What the operators of this package share: tables, the shared folder, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that is sent to Python.
BATCH_ROWS = 1000

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset and all runs in one process (tests), a new local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sondage-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str = "table", **options: object) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, a lost executor costs nothing. options are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once everything made from them has been written itself."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python by the thousand, so that a batch of texts or sets fits several times into a worker.

    This is a setting of the session: queries and the pipeline make it, operators don't."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def released() -> None:
    """Gives what a task no longer needs back to the system: a worker keeps it otherwise, for whatever stage it runs next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """names, each with as many underscores at its end as it takes to be no column's (letter case aside) and no other's."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


#: Bytes hashed at a time.
SEGMENT = 1 << 18


@lru_cache(maxsize=1)
def _keys() -> np.ndarray:
    """An odd number for each place in a word. They follow no rule that words could mirror, so any two words collide with a chance of 2 ** -56."""
    return mix64(np.arange(1, SEGMENT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a text in UTF-8, in order."""
    found, at = [], 0
    while at < len(data):
        stop = min(len(data), at + SEGMENT)
        if stop - at == SEGMENT:
            # A segment ends after white space; a word as long as a segment or longer is hashed alone.
            cut = max(data.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < 0:
                rest = np.frombuffer(data, np.uint8)[at:]
                end = at + int(np.argmax((rest == 32) | ((rest >= 9) & (rest <= 13)))) or len(data)
                end = end if end > at else len(data)
                found.append((np.array([xxhash.xxh3_64_intdigest(data[at:end])], np.uint64), np.array([at]), np.array([end])))
                at = end
                continue
            stop = cut + 1 if stop < len(data) else stop
        h, s, e = _hashed(np.frombuffer(data, np.uint8, stop - at, at))
        found.append((h, s + at, e + at))
        at = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _hashed(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of each word's bytes times the keys of their places (a multilinear hash)."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    place = np.arange(len(b), dtype=np.int32)
    if len(start):
        place[start[0] :] -= np.repeat(start.astype(np.int32), np.diff(start, append=len(b)))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _keys()[place], out=sums[1:])
    return mix64(sums[end] - sums[start] + _keys()[end - start - 1]), start, end
