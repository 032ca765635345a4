"""Pattern packing: token pieces into sequences of a fixed length by non-negative least squares.

The lengths' histogram (at most max_len numbers) is all that reaches the driver.
Patterns of at most three lengths that fill a sequence exactly are enumerated;
non-negative least squares fits how often each is repeated; the fit is rounded
with the fractions carried along, never beyond the pieces there are; what is
left over is packed best-fit, largest first, length by length. The plan is a
list of patterns with counts, from which every piece finds its sequence and
offset by its rank among the pieces of its length. Ranks come from salted
groups, so that a length that most pieces share isn't one group.

Null texts count as empty (their piece is the end id alone), so every row gives
a piece; repeated rows are packed like others, rows without an id too; an empty
table gives no rows. Very long texts are encoded whole and cut; those with a run
of letters or of white space that is very long itself go through the tokenizer's
own library. Pieces of equal length are interchangeable: their order is that of
the written table. Other columns of the documents aren't read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Steps of the fit; pieces of a length and salt, about, and least salts.
STEPS, PER_SALT, LEAST_SALTS = 400, 20_000, 64
#: Runs without a break that tiktoken takes more than linear time or too deep a stack for.
_LONG = re.compile(r"\s{4096}|\S{4096}")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to the ids that `tokenizers` gives for a byte-level BPE file, without what its post-processor adds.

    tiktoken does the work, in about a tenth of the time. The vocabulary spells
    bytes as letters: printable Latin-1 characters stand for themselves and the
    other bytes, in order, for U+0100 onwards. The file's added tokens are found
    in texts and have their own ids, as the tokenizer does once it is loaded.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    own: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if not _LONG.search(text):
            return fast.encode(text, allowed_special="all")
        if not own:
            own.append(Tokenizer.from_file(path))
        return own[0].encode(text, add_special_tokens=False).ids

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, max_len: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (32-bit little-endian) of every row; only the first piece may be shorter where a text is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            columns = owner, piece, start, length, data = [], array("i"), array("q"), array("q"), []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(t.as_py() or ""), end_id], dtype="<u4")
                first = len(ids) if len(ids) <= max_len else len(ids) % max_len or max_len
                at = 0
                for n, stop in enumerate(range(first, len(ids) + 1, max_len)):
                    owner.append(d)
                    piece.append(n)
                    start.append(at)
                    length.append(stop - at)
                    data.append(ids[at:stop].tobytes())
                    at = stop
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def patterns(present: np.ndarray, max_len: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of lengths that are present (0: none) and fill max_len."""
    a, b = np.meshgrid(np.arange(max_len + 1), np.arange(max_len + 1), indexing="ij")
    c = max_len - a - b
    fits = (a >= b) & (b >= c) & (c >= 0)
    found = np.stack([a[fits], b[fits], c[fits]], axis=1)
    there = np.zeros(max_len + 1, bool)
    there[present] = True
    there[0] = True
    return found[there[found].all(axis=1)]


def fit(shapes: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that makes the patterns' lengths, x times each, come near the histogram: accelerated projected gradient.

    A residual weighs by its length, since long pieces are hard to place later.
    """
    n = len(histogram)
    weight = np.sqrt(np.arange(n, dtype=float))
    weight[0] = 0
    flat = shapes.ravel()

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), n)

    norm, v = 1.0, np.ones(len(shapes))
    for _ in range(20):
        v = (weight**2 * times(v))[shapes].sum(axis=1)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(steps):
        slope = (weight**2 * (times(y) - histogram))[shapes].sum(axis=1)
        new = np.maximum(0, y - slope / (1.05 * norm))
        t, s = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (s - 1) / t * (new - x), new
    return x


def rounded(shapes: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[list[int], int]]:
    """Whole repeats, the fractions carried along in the order of the patterns; left is reduced by what they use."""
    repeats = np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0.0).astype(np.int64)
    plan = []
    for i in np.flatnonzero(repeats):
        own = [int(z) for z in shapes[i] if z]
        k = min([int(repeats[i]), *(int(left[z]) // own.count(z) for z in set(own))])
        if k > 0:
            plan.append((own, k))
            for z in own:
                left[z] -= k
    return plan


def best_fit(left: np.ndarray, max_len: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over a histogram: equal pieces are placed together."""
    room: list[list[tuple[list[int], int]]] = [[] for _ in range(max_len + 1)]
    for z in range(max_len, 0, -1):
        n = int(left[z])
        while n > 0:
            space = next((s for s in range(z, max_len) if room[s]), None)
            if space is None:
                each = max_len // z
                for k, m in ((n // each, each), (1, n % each)):
                    if k and m:
                        room[max_len - m * z].append(([z] * m, k))
                break
            own, k = room[space].pop()
            used = min(k, n)
            if used < k:
                room[space].append((own, k - used))
            room[space - z].append(([*own, z], used))
            n -= used
    return [x for level in room for x in level]


def plan(histogram: dict[int, int], max_len: int = 1024) -> list[tuple[list[int], int]]:
    """Sequences as (lengths, how many of them)."""
    left = np.zeros(max_len + 1, np.int64)
    for z, n in histogram.items():
        left[z] = n
    made = []
    shapes = patterns(np.flatnonzero(left), max_len)
    if len(shapes):
        made = rounded(shapes, fit(shapes, left.astype(float)), left)
    return made + best_fit(left, max_len)


def pack(pieces: DataFrame, max_len: int = 1024, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces, which must be a written table, with sequence_id and offset. Lengths must be 1 to max_len."""
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # max_len rows at most
    made = plan(histogram, max_len)
    slots: dict[int, list[tuple[int, int, int]]] = {z: [] for z in histogram}
    filled, base = dict.fromkeys(histogram, 0), 0
    for own, k in made:
        at = 0
        for z in own:
            slots[z].append((filled[z], base, at))
            filled[z] += k
            at += z
        base += k
    tables = {z: tuple(np.array(x, np.int64) for x in zip(*s, strict=True)) for z, s in slots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, rank = np.asarray(b.column(b.schema.get_field_index(length))), np.asarray(b.column(b.schema.get_field_index("_rank")))
            sequence, offset = np.zeros(len(z), np.int64), np.zeros(len(z), np.int64)
            by = np.argsort(z, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(z[by])) + 1) if len(by) else []:
                first, start, at = tables[int(z[own[0]])]
                i = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = start[i] + rank[own] - first[i], at[i]
            keep = [i for i, n in enumerate(b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(sequence), pa.array(offset)], [*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    salts = max(LEAST_SALTS, sum(histogram.values()) // PER_SALT)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    salted = pieces.select(*columns, F.pmod(F.xxhash64(*order), F.lit(salts)).alias("_salt"))
    before = salted.groupBy(length, "_salt").count()
    before = before.withColumn("_before", F.sum("count").over(Window.partitionBy(length).orderBy("_salt")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*order))
    ranked = salted.withColumn("_within", within).join(before, [length, "_salt"]).withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in columns)
    return ranked.select(*columns, "_rank").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of docs with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, max_len, end_id, key, text).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    # Numbered rows: those that repeat an id and a piece are dealt out like others.
    return pack(materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces"), max_len, order=("row",)).drop("row")
