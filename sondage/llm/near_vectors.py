"""Embedding near-dedup by an exact metric range join.

Equal vectors of a label are one class. Labels are dealt by hash in blocks of
bounded size, each a row of bytes; small labels share one. Every pair of blocks
of a label is a tile that is compared on its own, so a large label is many
tasks. Blocks aren't shuffled to their tiles: a tile reads both from the shared
folder, so what is written grows with the vectors and not with the pairs. In a
tile, vectors stand by their nearest of a few pivots, and the triangle
inequality rules groups of them out (unit vectors with cosine >= c lie within
r = sqrt(2 - 2c) of each other). Of the rest, cosines are first bounded from
above by some dimensions of a rotated copy and the length of what these leave
out, then computed in doubles where the bound leaves room. A tile gives link
counts and a spanning forest of its links, never its pairs. The comparisons of
a label grow with its square.

Vectors that are null, zero, or hold null or non-finite components, and vectors
without a label, link with nothing, nor do vectors of different lengths.
Repeated rows are vectors of their own. Rows without an id take part in counts,
and their component is the smallest id there is in it (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise
from .components import Forest, components

#: Classes for each pivot of a tile's side, classes of a block; dimensions that the first bound takes.
PER_PIVOT, BLOCK, BOUND = 256, 8192, 16
#: Cosines this close to the threshold are computed again as dot product by product of norms.
CLOSE = 1e-9
#: What the first bound, in single precision, may be off by. A part of a tile in which it lets more than one in DENSE pass is computed whole.
SLACK, DENSE = 1e-4, 50
#: Bits of a class's number in its block, and of the block's in its partition.
PLACE = 20


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """x, each row times the power of two that brings its greatest component near one: squares then neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])


def _usable(b: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Row, name of its class and vector of each row of a batch (its last columns are label and vector) that may link."""
    labels, vectors = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
    starts, ends = vectors.offsets.to_numpy()[:-1], vectors.offsets.to_numpy()[1:]
    flat = vectors.values.to_numpy(zero_copy_only=False)
    there = np.asarray(vectors.is_valid()) & np.asarray(labels.is_valid())
    for i in np.flatnonzero(there & (ends > starts)):
        x = flat[starts[i] : ends[i]]
        if np.isfinite(x).all() and x.any():
            yield i, xxhash.xxh3_128_digest(f"{labels[i]}:".encode() + (x.astype(np.float64) + 0.0).tobytes()), x


def _named(vec_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[bytes | None] = [None] * b.num_rows
            for i, key, _ in _usable(b):
                keys[i] = key
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], [vec_id, "_key"])

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, length, class, count and bytes of the vectors of a batch, equal ones once."""
    for b in batches:
        held: dict[bytes, list] = {}
        for i, key, x in _usable(b):
            held.setdefault(key, [i, 0, x])[1] += 1
        at = pa.array([i for i, _, _ in held.values()], pa.int64())
        columns = [pa.array([len(x) for *_, x in held.values()], pa.int32()), pa.array(list(held), pa.binary()), pa.array([n for _, n, _ in held.values()], pa.int64()), pa.array([x.tobytes() for *_, x in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), *columns], ["_label", "_d", "_key", "_n", "_x"])


def _pack(t: pa.Table) -> pa.Table:
    """One row for a block: its sections (rows and length of the vectors of each label and length in it), then keys, counts and vectors as bytes."""
    held: dict[tuple, dict[bytes, list]] = {}
    for label, d, key, n, x in zip(*(t.column(k).to_pylist() for k in ("_label", "_d", "_key", "_n", "_x")), strict=True):
        held.setdefault((label, d), {}).setdefault(key, [0, x])[0] += n
    own = [(key, n, x) for section in held.values() for key, (n, x) in section.items()]
    assert len(own) < 1 << PLACE
    sections = [y for (_, d), section in held.items() for y in (len(section), d)]
    columns = [pa.array([t.column("grp")[0].as_py()]), pa.array([t.column("part")[0].as_py()], pa.int32()), pa.array([sections], pa.list_(pa.int32())), pa.array([b"".join(k for k, _, _ in own)], pa.binary()), pa.array([np.array([n for _, n, _ in own], np.int64).tobytes()], pa.binary()), pa.array([b"".join(x for *_, x in own)], pa.binary())]
    return pa.table(columns, names=["grp", "part", "sections", "keys", "ns", "xs"])


def blocks(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame, np.dtype]:
    """All rows with their class (null if they link with nothing), the blocks of classes, and the type of their components."""
    single = vectors.schema[embedding].dataType == T.ArrayType(T.FloatType(), vectors.schema[embedding].dataType.containsNull)
    x = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("_label"), x.alias("_x"))
    schema = T.StructType([rows.schema["vec_id"], T.StructField("_key", T.BinaryType())])
    named = materialise(rows.mapInArrow(_named("vec_id"), schema), "rows")
    sizes = rows.groupBy("_label", F.size("_x").alias("_d")).agg(F.count("*").alias("_rows"))
    # Labels that fill half a block or more are at most 2 / BLOCK of the rows; the others share blocks.
    large = sizes.where(F.col("_rows") * 2 >= BLOCK).select("_label", "_d", F.ceil(F.col("_rows") / BLOCK).alias("_parts"))
    small = sizes.where(F.col("_rows") * 2 < BLOCK).agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    shared = F.concat(F.lit("|"), F.pmod(F.xxhash64("_label", "_d"), F.lit(max(1, -(-small // BLOCK)))).cast("string"))
    spread = rows.select("_label", "_x").mapInArrow(_distinct, "_label string, _d int, _key binary, _n long, _x binary").join(F.broadcast(large), ["_label", "_d"], "left")
    dealt = spread.select(
        "_label", "_d", "_key", "_n", "_x",
        F.when(F.col("_parts").isNull(), shared).otherwise(F.concat_ws(":", "_label", "_d")).alias("grp"),
        F.coalesce(F.pmod(F.xxhash64("_key"), F.col("_parts")), F.lit(0)).cast("int").alias("part"),
    )
    made = dealt.groupBy("grp", "part").applyInArrow(_pack, "grp string, part int, sections array<int>, keys binary, ns binary, xs binary")
    at = F.monotonically_increasing_id()
    first = F.shiftleft(F.shiftright(at, 33), 2 * PLACE) + F.shiftleft(at.bitwiseAND((1 << 33) - 1), PLACE)
    return named, materialise(made.withColumn("first", first), "blocks", **{"parquet.block.size": 8 << 20}), np.dtype(np.float32 if single else np.float64)


@lru_cache(maxsize=8)
def _axes(d: int) -> np.ndarray:
    """BOUND dimensions of a rotation."""
    return np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0][:, :BOUND]


class Side:
    """Vectors of a tile's side: sections of rows by their nearest pivot, with its distances."""

    def __init__(self, raw: np.ndarray):
        self.raw = _scaled(raw)
        self.x = _unit(self.raw)
        some = self.x[:: max(PER_PIVOT, 1)]
        away = np.sqrt(np.maximum(0, 2 - 2 * self.x @ some.T))
        nearest = away.argmin(axis=1)
        order = np.argsort(nearest, kind="stable")
        kept, starts = np.unique(nearest[order], return_index=True)
        #: Rows of each pivot, the pivots, and how far their rows reach.
        self.rows, self.pivots = np.split(order, starts[1:]), some[kept]
        self.reach = np.array([away[r, k].max() for r, k in zip(self.rows, kept, strict=True)])
        d = raw.shape[1]
        if d > BOUND + 8:
            y = self.x @ _axes(d)
            self.bound = np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1, keepdims=True)))], axis=1).astype(np.float32)
        else:
            self.bound = self.x.astype(np.float32)


def linked(a: Side, b: Side, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b that link, in parts."""
    r = np.sqrt(max(0.0, 2 - 2 * cosine))
    apart = np.sqrt(np.maximum(0, 2 - 2 * a.pivots @ b.pivots.T))
    room = apart <= a.reach[:, None] + b.reach[None] + r + 1e-6
    for k, left in enumerate(a.rows):
        near = [b.rows[m] for m in np.flatnonzero(room[k])]
        for left_ in np.split(left, range(PER_PIVOT, len(left), PER_PIVOT)):
            if not near:
                continue
            right = np.concatenate(near)
            found = np.flatnonzero(a.bound[left_] @ b.bound[right].T >= cosine - SLACK)
            if not len(found):
                continue
            if len(found) * DENSE > len(left_) * len(right):
                g = (a.x[left_] @ b.x[right].T).ravel()
                found = np.flatnonzero(g >= cosine - CLOSE)
                g = g[found]
            else:
                g = None
            i, j = left_[found // len(right)], right[found % len(right)]
            if g is None:
                g = np.einsum("ij,ij->i", a.x[i], b.x[j])
            for at in np.flatnonzero(np.abs(g - cosine) < CLOSE):
                u, v = a.raw[i[at]], b.raw[j[at]]
                g[at] = (u @ v) / (np.sqrt(u @ u) * np.sqrt(v @ v))
            yield i[g >= cosine], j[g >= cosine]


def _compare(c: np.ndarray, n: np.ndarray, a: Side, b: Side, half: int, cosine: float) -> pa.RecordBatch:
    """Link counts (a = b) and a spanning forest (n = 0) of the links of a and b. c, n: of the classes of a and, from half on, of b; half is 0 if they are the same."""
    counts, label = np.zeros(len(c), np.int64), np.arange(len(c))
    for i, j in linked(a, b, cosine):
        j = j + half
        i, j = i[i != j], j[i != j]
        np.add.at(counts, i, n[j])
        if half:
            np.add.at(counts, j, n[i])
        forest = Forest()
        for pair in np.unique(label[i] * len(c) + label[j]).tolist():
            forest.link(*divmod(pair, len(c)))
        moved = np.arange(len(c))
        for x, root in forest.edges():
            moved[x] = root
        label = moved[label]
    tied, counted = np.flatnonzero(label != np.arange(len(c))), np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[tied], c[counted]])), pa.array(np.concatenate([c[label[tied]], c[counted]])), pa.array(np.concatenate([np.zeros(len(tied), np.int64), counts[counted]]))], ["a", "b", "n"])


def _tile(cosine: float, kind: np.dtype):
    def sections(first: int, shape: list[int], ns: bytes, xs: bytes) -> Iterator[tuple]:
        n, x, at, place = np.frombuffer(ns, np.int64), np.frombuffer(xs, kind), 0, 0
        for rows, d in zip(shape[::2], shape[1::2], strict=True):
            yield first + at + np.arange(rows), n[at : at + rows], Side(x[place : place + rows * d].astype(np.float64).reshape(rows, d))
            at, place = at + rows, place + rows * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one, other = ([b.column(side + i)[k].as_py() for i in range(4)] for side in (0, 4))
                if one[0] == other[0]:
                    for c, n, side in sections(*one):
                        yield _compare(c, n, side, side, 0, cosine)
                else:
                    (c, n, left), (e, m, right) = *sections(*one), *sections(*other)
                    yield _compare(np.concatenate([c, e]), np.concatenate([n, m]), left, right, len(c), cosine)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, keys, ns in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            n = np.frombuffer(ns, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(n))), pa.array([keys[16 * i : 16 * i + 16] for i in range(len(n))], pa.binary()), pa.array(n)], ["_c", "_key", "_n"])


def link(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, packed, kind = blocks(vectors, vec_id, embedding, label)
    side = lambda s: packed.select(*(F.col(c).alias(f"{s}_{c}") for c in ("first", "sections", "ns", "xs", "grp", "part")))
    # A product of partitions that are read where they are needed: no block is shuffled.
    tiles = side("l").hint("shuffle_replicate_nl").join(side("r"), (F.col("l_grp") == F.col("r_grp")) & (F.col("l_part") <= F.col("r_part")))
    tiles = tiles.select(*(f"{s}_{c}" for s in "lr" for c in ("first", "sections", "ns", "xs")))
    found = materialise(tiles.mapInArrow(_tile(cosine, kind), "a long, b long, n long"), "found")
    made = materialise(packed.select("first", "keys", "ns").mapInArrow(_members, "_c long, _key binary, _n long"), "classes")
    discard(packed)
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("_links")).withColumnRenamed("a", "_c")
    member = components(found.where("n = 0"), "a", "b").withColumnRenamed("node", "_c")
    named = made.join(counts, "_c", "left").where("_links > 0 or _n > 1").join(member, "_c", "left")
    named = materialise(named.select("_key", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("n_links"), F.coalesce("component", "_c").alias("component")), "named")
    discard(made, found)
    first = rows.join(named, "_key").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = materialise(named.join(first, "component").select("_key", "n_links", "component_id"), "named")
    return rows.join(named, "_key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
