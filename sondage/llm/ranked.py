"""Ranked lexical search over a clustered index, with exact stopping.

Documents are reordered by recursive graph bisection, so that those which share terms stand together. The tree of bisections is fitted
on a sample of `SAMPLE` documents; each node keeps what it costs a term to stand on either side, and every document of the corpus goes down
the tree by these costs. The places at the end of the tree, cut by a hash of doc_id into parts of about `PART` documents, are the shards of
the index: a row each, with postings in order of term and the greatest impact of every term.

A query's bound for a shard is the sum of its terms' greatest impacts. Each round visits the shards with the best bounds (`ROUNDS`), then the
k-th score so far is known; the last round visits all shards whose bound reaches it. A shard with a lower bound holds no answer, so the result is that of a
full scan. Within a shard documents stand in order of doc_id, and equal scores are told apart by it.

Only terms of the queries are indexed. Queries are taken in blocks of bounded number and size, one index for each block. N, L and df count all documents.

Null texts and texts without a term count for nothing. Rows with a null doc_id count in N, L and df but aren't ranked. Rows with equal doc_id
are ranked each. Queries are the distinct pairs of id and text; a null id is an id. Queries without a known term, and an empty table of documents, give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Documents of the sample, levels of bisection, swaps tried at a level, and terms that a node weighs.
SAMPLE, DEPTH, SWAPS, WEIGHED = 4096, 6, 12, 16_384
#: Documents of a shard, as aimed at; shards a query visits in each round before the last.
PART, ROUNDS = 4096, (4, 28)
#: Queries and characters of their texts in a block.
QUERIES, QUERY_CHARS = 1024, 1 << 22
#: Bytes of a text taken at a time; bytes of a row group of the index.
PORTION, GROUP_BYTES = 1 << 22, 16 << 20
#: Saturation and length normalisation, in hundredths.
SATURATION, LENGTH = 120, 25

#: Letters and digits of ASCII and all bytes of other characters are of a term; only A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_INDEX = "shard long, docs array<long>, terms array<int>, starts array<int>, rows array<int>, impacts array<int>, best array<int>"


def terms_of(data: bytes) -> Counter:
    """How often each term occurs in a text in UTF-8."""
    found: Counter = Counter()
    at = 0
    while at < len(data):
        stop = at + PORTION
        while stop < len(data) and _TERM_BYTES[data[stop]] != 32:
            stop += 1
        found.update(data[at:stop].translate(_TERM_BYTES).split())
        at = stop
    return found


def _counted(vocabulary):
    """For each document with a term: its id, its number of terms, and the numbers and counts of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(vocabulary.value)}
        for b in batches:
            ids, sizes, terms, counts, offsets = [], [], [], [], [0]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                found = terms_of(text.as_py() or b"")
                if not found:
                    continue
                own = sorted([(known[t], c) for t, c in found.items() if t in known])
                ids.append(doc_id)
                sizes.append(found.total())
                terms += [t for t, _ in own]
                counts += [c for _, c in own]
                offsets.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return run


class Bisection:
    """A tree of bisections of a sample, as costs of terms at each node: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, docs: list[np.ndarray], width: int):
        often = np.bincount(np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64), minlength=width)
        chosen = np.argsort(-often, kind="stable")[:WEIGHED]
        chosen = chosen[often[chosen] > 1]
        #: Place of each term among those weighed; the last place is for the others.
        self.place = np.full(width + 1, len(chosen), np.int32)
        self.place[chosen] = np.arange(len(chosen))
        self.costs = np.zeros(((1 << DEPTH) - 1, len(chosen) + 1), np.float32)
        self.bias = np.zeros((1 << DEPTH) - 1, np.float32)
        own = [self.place[d] for d in docs]
        own = [d[d < len(chosen)] for d in own]
        self._split(0, 0, own)

    @staticmethod
    def _costs(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """What a document of the left (right) loses by each of its terms when it goes to the other side."""

        def cost(d):
            return d * np.log2(n / (d + 1))

        here = cost(left) + cost(right)
        down_l, down_r = np.maximum(left - 1, 0), np.maximum(right - 1, 0)
        return here - cost(down_l) - cost(right + 1), here - cost(left + 1) - cost(down_r)

    def _split(self, node: int, level: int, docs: list[np.ndarray]) -> None:
        if level == DEPTH or len(docs) < 4:
            return
        width = self.costs.shape[1]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = np.concatenate([*docs, np.zeros(0, np.int32)])
        owner = np.repeat(np.arange(len(docs)), sizes)

        def sums(weights: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights[flat], len(docs))

        half = (len(docs) + 1) // 2
        left = np.zeros(len(docs), bool)
        # The first order is by the rarest term, which brings copies together.
        least = np.full(len(docs), -1)
        np.maximum.at(least, owner, flat)
        left[np.argsort(least, kind="stable")[:half]] = True
        for _ in range(SWAPS):
            on = left[owner]
            degrees = np.bincount(flat[on], minlength=width), np.bincount(flat[~on], minlength=width)
            from_left, from_right = self._costs(*degrees, half)
            gain_l, gain_r = np.where(left, sums(from_left), -np.inf), np.where(left, -np.inf, sums(from_right))
            best_l, best_r = np.argsort(-gain_l, kind="stable"), np.argsort(-gain_r, kind="stable")
            n = min(half, len(docs) - half)
            better = gain_l[best_l[:n]] + gain_r[best_r[:n]] > 0
            swaps = n if better.all() else int(np.argmin(better))
            if not swaps:
                break
            left[best_l[:swaps]], left[best_r[:swaps]] = False, True
        on = left[owner]
        a, b = np.bincount(flat[on], minlength=width).astype(float), np.bincount(flat[~on], minlength=width).astype(float)

        def added(d):
            return (d + 1) * np.log2(half / (d + 2)) - d * np.log2(half / (d + 1))

        self.costs[node] = added(a) - added(b)
        self.costs[node, -1] = 0
        value = sums(self.costs[node].astype(float))
        self.bias[node] = np.median(value)
        side = value <= self.bias[node]
        self._split(2 * node + 1, level + 1, [d for d, s in zip(docs, side, strict=True) if s])
        self._split(2 * node + 2, level + 1, [d for d, s in zip(docs, side, strict=True) if not s])

    def leaves(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The place at the end of the tree of each document, from all documents' terms in one array."""
        node = np.zeros(len(sizes), np.int64)
        owner, terms = np.repeat(np.arange(len(sizes)), sizes), self.place[flat]
        for _ in range(DEPTH):
            value = np.bincount(owner, self.costs[node[owner], terms], len(sizes))
            node = 2 * node + np.where(value <= self.bias[node], 1, 2)
        return node - ((1 << DEPTH) - 1)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists without nulls."""
    return column.flatten().to_numpy(), column.value_lengths().to_numpy()


def _placed(tree, parts):
    """Counted documents with the shard each belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[0], np.cumsum(parts)])
        for b in batches:
            leaf = tree.value.leaves(*_lists(b.column("terms")))
            part = np.asarray(b.column("hash")).view(np.uint64) % parts[leaf].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(first[leaf] + part.astype(np.int64)), *b.columns[:4]], ["shard", *b.schema.names[:4]])

    return run


def _shard(documents: int, length: int):
    """One shard's documents as a row of the index."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("doc_id").combine_chunks()
        n = np.asarray(batch.column("n"))
        (terms, sizes), (counts, _) = (_lists(batch.column(c).combine_chunks()) for c in ("terms", "counts"))
        # The product with N may leave 64 bits: whole numbers of any size.
        norm = np.array([100 - LENGTH + LENGTH * x * documents // length for x in n.tolist()], np.int64)
        row = np.repeat(np.arange(len(n)), sizes)
        tf = counts.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + SATURATION // 10 * norm[row])
        order = np.argsort(terms, kind="stable")
        own, starts = np.unique(terms[order], return_index=True)
        impact = impact[order]
        best = np.maximum.reduceat(impact, starts) if len(starts) else impact
        arrays = (np.asarray(batch.column("doc_id")), own, np.append(starts, len(terms)), row[order], impact, best)
        made = [pa.array([a], pa.list_(pa.int64() if i == 0 else pa.int32())) for i, a in enumerate(arrays)]
        return pa.Table.from_arrays([batch.column("shard")[:1], *made], ["shard", "docs", "terms", "starts", "rows", "impacts", "best"])

    return run


class _Block:
    """A block of queries, as every task gets it: terms and weights of each, and what is known of its answers."""

    def __init__(self, queries: list[Counter], vocabulary: list[bytes]):
        number = {t: i for i, t in enumerate(vocabulary)}
        self.terms = [np.array(sorted(number[t] for t in q), np.int64) for q in queries]
        self.times = [np.array([q[vocabulary[t]] for t in own], np.int64) for q, own in zip(queries, self.terms, strict=True)]
        self.weights: list[np.ndarray] = []
        #: The score that an answer must reach.
        self.needed = np.ones(len(queries), np.int64)

    def weigh(self, documents: int, df: np.ndarray) -> None:
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.weights = [weight[t] * n for t, n in zip(self.terms, self.times, strict=True)]

    def bounds(self, terms: np.ndarray, best: np.ndarray, width: int) -> np.ndarray:
        """Each query's bound for a shard."""
        wide = np.zeros(width, np.int64)
        wide[terms] = best
        return np.array([int(w @ wide[t]) for t, w in zip(self.terms, self.weights, strict=True)], np.int64)


def _bounds(block, width: int, seen, n: int):
    """Shards that each query should visit next: the n best bounds that reach what is needed, of shards that it hasn't visited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = block.value, {}
        for b in batches:
            for shard, terms, most in zip(b.column("shard").to_pylist(), b.column("terms"), b.column("best"), strict=True):
                bound = known.bounds(terms.values.to_numpy(), most.values.to_numpy(), width)
                for q in np.flatnonzero(bound >= known.needed).tolist():
                    if q not in seen.value.get(shard, ()):
                        best.setdefault(q, []).append((-int(bound[q]), shard))
            best = {q: sorted(own)[:n] for q, own in best.items()}
        rows = [(q, shard, -bound) for q, own in best.items() for bound, shard in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["q", "shard", "bound"])

    return run


def _visits(block, width: int, k: int, only, seen, visits: Accumulator | None):
    """Best k documents of each query in this task's shards: of the pairs in only or, if that is None, of all whose bound reaches what is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        needed, best = known.needed.copy(), {}
        for b in batches:
            for i, shard in enumerate(b.column("shard").to_pylist()):
                docs, terms, starts, rows, impacts, most = (b.column(c)[i].values.to_numpy() for c in ("docs", "terms", "starts", "rows", "impacts", "best"))
                if only is not None:
                    asked = only.value.get(shard, ())
                else:
                    asked = np.flatnonzero(known.bounds(terms, most, width) >= needed).tolist()
                    asked = [q for q in asked if q not in seen.value.get(shard, ())]
                if visits:
                    visits.add(len(asked))
                for q in asked:
                    score = np.zeros(len(docs), np.int64)
                    at = np.searchsorted(terms, known.terms[q])
                    held = np.flatnonzero((at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == known.terms[q])) if len(terms) else []
                    for j in held:
                        lo, hi = starts[at[j]], starts[at[j] + 1]
                        score[rows[lo:hi]] += known.weights[q][j] * impacts[lo:hi].astype(np.int64)
                    top = np.flatnonzero(score >= needed[q])
                    top = top[np.argsort(-score[top], kind="stable")][:k]
                    own = best.get(q, []) + list(zip((-score[top]).tolist(), docs[top].tolist(), strict=True))
                    best[q] = own = sorted(own)[:k]
                    if len(own) == k:
                        needed[q] = max(needed[q], -own[-1][0])
        rows = [(q, doc, -score) for q, own in best.items() for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["q", "doc_id", "score"])

    return run


def _first(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of each query; tasks cut theirs before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= n)


def _blocks(queries: DataFrame, query_id: str, query: str) -> Iterator[list[Row]]:
    own = queries.select(F.col(query_id).alias("id"), F.col(query).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = own.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(1, math.ceil(size[0] / QUERIES * 2), math.ceil((size[1] or 0) / QUERY_CHARS * 2)) if size[0] > QUERIES or (size[1] or 0) > QUERY_CHARS else 1
    for i in range(n):
        yield own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).orderBy("id", "text").collect()  # a block's queries


def search(
    docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query: str = "text",
    visits: Accumulator | None = None,
) -> DataFrame:
    """The k best documents of each query with a score above 0: (query_id, rank, doc_id, score). visits counts the shards that queries visit."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"q long, {doc_id} long, score long, rank int").join(queries.select(query_id).limit(0)).select(query_id, "rank", doc_id, "score")
    for block in _blocks(queries, query_id, query):
        found = [terms_of(r["text"].encode()) for r in block]
        if any(found):
            made = _search(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), found, k, visits)
            ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(block)], f"q long, {query_id} {queries.schema[query_id].dataType.simpleString()}")
            made = made.join(F.broadcast(ids), "q").select(query_id, "rank", F.col("doc_id").alias(doc_id), "score")
            out = out.union(made)
    return out


def _search(docs: DataFrame, queries: list[Counter], k: int, visits: Accumulator | None) -> DataFrame:
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    vocabulary = sorted(set().union(*queries))
    width = len(vocabulary)
    counted = materialise(docs.mapInArrow(_counted(send(vocabulary)), "doc_id long, n long, terms array<int>, counts array<int>"), "counted")
    indexed = (F.size("terms") > 0) & F.col("doc_id").isNotNull()
    size = counted.agg(F.count("*"), F.sum("n"), F.count_if(indexed)).first()
    documents, length = size[0], size[1] or 1
    df = np.zeros(width, np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a block's terms
        df[r["t"]] = r["count"]
    block = _Block(queries, vocabulary)
    block.weigh(documents, df)

    able = counted.where(indexed).withColumn("hash", F.xxhash64("doc_id"))
    # Cut by hash to somewhat more than the sample first: tasks would else send as many rows each.
    share = min(1.0, 1.2 * SAMPLE / max(1, size[2]))
    cut = min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)
    near = able.where(F.col("hash") <= cut).orderBy("hash").limit(SAMPLE)
    sample = [np.array(r["terms"], np.int64) for r in near.select("terms").collect()]
    tree = Bisection(sample, width)
    share = np.bincount(tree.leaves(np.concatenate([*sample, np.zeros(0, np.int64)]), np.array([len(s) for s in sample], np.int64)), minlength=1 << DEPTH)
    # A share is estimated; the 4 is for leaves that the sample hardly meets.
    parts = np.ceil((share + 4) / max(1, len(sample)) * documents / PART).astype(np.int64)
    placed = able.mapInArrow(_placed(send(tree), parts), "shard long, doc_id long, n long, terms array<int>, counts array<int>")
    index = materialise(placed.groupBy("shard").applyInArrow(_shard(documents, length), _INDEX), "index", **{"parquet.block.size": GROUP_BYTES})

    answers = None
    visited: dict[int, set[int]] = {}
    for n in ROUNDS:
        known, seen = send(block), send(visited)
        pairs = index.select("shard", "terms", "best").mapInArrow(_bounds(known, width, seen, n), "q long, shard long, bound long")
        asked: dict[int, set[int]] = {}
        for r in _first(pairs, n, F.desc("bound"), "shard").collect():  # n shards for each query of the block
            asked.setdefault(r["shard"], set()).add(r["q"])
        if not asked:
            break
        own = index.where(F.col("shard").isin(list(asked))).mapInArrow(_visits(known, width, k, send(asked), None, visits), "q long, doc_id long, score long")
        best = _first(own if answers is None else own.union(answers), k, F.desc("score"), "doc_id").drop("rank")
        answers = materialise(best, "answers")
        for r in answers.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():  # a row for each query
            if r["n"] == k:
                block.needed[r["q"]] = r["least"]
        visited = {s: visited.get(s, set()) | asked.get(s, set()) for s in {*visited, *asked}}
    rest = index.mapInArrow(_visits(send(block), width, k, None, send(visited), visits), "q long, doc_id long, score long")
    last = materialise(_first(rest if answers is None else rest.union(answers), k, F.desc("score"), "doc_id"), "answers")
    discard(counted, index)
    return last
