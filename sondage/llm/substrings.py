"""Substring dedup: repeated word windows found by matching statistics in suffix automata.

A window is 13 consecutive words; a word is removed if a window that covers it
also starts in a document with a smaller id. Automata of the whole corpus have
no size bound, so the corpus is first thinned without loss: every window has a
minimizer (the least hashed 5-gram in it), and windows whose minimizer, and
then whose own hash, occurs once cannot repeat. Both tests are bitmaps of
bounded size that never miss a repeat. What is left are runs of windows with the
same minimizer, named by 128 bits of their bytes. Each distinct run goes, with its smallest document, to the
shard of its minimizer, where equal windows always meet. A shard's suffix
automaton, built over the words of its runs, holds in each state the smallest
document that its strings start in; the shard's runs are streamed through it,
and where the match is at least 13 words long the state of its last 13 words
says whose window came first. The automata aren't broadcast, since their number
grows with the corpus: runs are sent to them.

Documents without an id (null) are neither changed nor referred to. Rows with
the same id and text are changed alike, and never because of each other. Null
and empty texts, and texts of fewer than 13 words, are returned as they are; an
empty table gives an empty one. Of equal windows the one in the smallest id
stays; within a document nothing is removed for its own sake. Very long texts
are hashed in segments. A result column whose name the table has already is
given an underscore more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .common import WORD, discard, materialise, mix64, released, unused, word_spans

#: Words of a window and of the grams whose least is its minimizer.
WINDOW, GRAM = 13, 5
#: Bytes that a task hashes at a time; runs of a shard, about; runs a task remembers having sent.
BLOCK_BYTES, PER_SHARD, MEMO = 800_000, 4000, 100_000
_BASE = 0x9E3779B97F4A7C15
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive of the hashes h, by doubling."""
    out, have, step, size = None, 0, h, 1
    while True:
        if n & size:
            out, have = (step, size) if out is None else (_join(step, out, size, have), have + size)
        if have == n:
            return out
        step, size = _join(step, step, size, size), size * 2


def _join(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    m = max(0, min(len(a), len(b) - na))
    return a[:m] * _power(nb) + b[na : na + m]


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    out, have = h, 1
    while have < n:
        step = min(have, n - have)
        out, have = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0], have + step
    return out


class Block:
    """Some whole documents: their rows, and of each window its document (index), first word, hash and minimizer."""

    def __init__(self, rows: list[tuple], texts: list[bytes], window: int, gram: int):
        self.rows, self.data = rows, b"\n".join(texts)
        h, self.start, self.end = word_spans(self.data)
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        doc = np.searchsorted(first, self.start, side="right") - 1
        #: The word that each document begins with.
        self.head = np.searchsorted(doc, np.arange(len(rows)))
        whole = rolled(h, window)
        own = doc[: len(whole)] == doc[window - 1 :][: len(whole)]
        least = sliding_min(mix64(rolled(h, gram)), window - gram + 1)[: len(whole)]
        self.word = np.flatnonzero(own)
        self.doc, self.window, self.least = doc[: len(whole)][own], mix64(whole[own]), least[own]

    def words(self, word: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[word] : self.end[word + n - 1]].split())


def blocks(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[Block]:
    """Blocks of about BLOCK_BYTES; the last column of a batch is the text. Nulls are left out."""
    rows, texts, size = [], [], 0
    for b in batches:
        keys = list(zip(*(b.column(i).to_pylist() for i in range(b.num_columns - 1)), strict=True))
        for key, t in zip(keys, b.column(b.num_columns - 1), strict=True):
            if not t.is_valid:
                continue
            rows.append(key)
            texts.append(t.as_buffer().to_pybytes())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield Block(rows, texts, window, gram)
                rows, texts, size = [], [], 0
    if rows:
        yield Block(rows, texts, window, gram)
    released()


def _counted(h: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Distinct hashes with the number of the block's documents that hold them."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h = h[new]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(first)
    return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(at, append=len(h)).astype(np.int32))], ["h", "n"])


def _repeated(docs: DataFrame, run) -> np.ndarray:
    """Bitmap of the hashes that run() finds in more than one document."""
    found = docs.mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    found = materialise(found, "repeated")
    bits = sketch.bitmap(found, found.count())
    discard(found)
    return bits


class Automaton:
    """Suffix automaton of several sequences; first[state] is the smallest owner of its strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [float("inf")]

    def _state(self, moves: dict, link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(float("inf"))
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A state of its own for the strings of q no longer than those of p, plus c."""
        made = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1)
        self.link[q] = made
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def add(self, sequence: list, owner: float) -> None:
        next_, link, length, first, none = self.next, self.link, self.length, self.first, float("inf")
        last = 0
        for c in sequence:
            q = next_[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
            else:
                made, p = len(length), last
                next_.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(none)
                while p >= 0:
                    moves = next_[p]
                    if c in moves:
                        q = moves[c]
                        link[made] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                        break
                    moves[c] = made
                    p = link[p]
                last = made
            if owner < first[last]:
                first[last] = owner

    def close(self) -> None:
        """After the last add(): owners are handed down the suffix links."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.first[s] < self.first[up]:
                self.first[up] = self.first[s]

    def owners(self, sequence: list, window: int) -> list[float | None]:
        """For each start of a window, the smallest owner of an equal one, or None: from the matching statistics."""
        next_, link, length, first = self.next, self.link, self.length, self.first
        out, state, matched = [], 0, 0
        for i, c in enumerate(sequence):
            to = next_[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = next_[state].get(c)
            if to is not None:
                state, matched = to, matched + 1
            while matched >= window and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                out.append(first[state] if matched >= window else None)
        return out


def _shard(window: int):
    def run(t: pa.Table) -> pa.Table:
        least: dict[bytes, int] = {}
        name: dict[bytes, tuple[int, int]] = {}
        for *run_, doc, text in zip(t.column("run").to_pylist(), t.column("run2").to_pylist(), t.column("doc").to_pylist(), t.column("words").to_pylist(), strict=True):
            least[text] = min(doc, least.get(text, doc))
            name[text] = tuple(run_)
        automaton = Automaton()
        ids: dict[bytes, int] = {}
        split = {text: [ids.setdefault(w, len(ids)) for w in text.split()] for text in least}
        for text, doc in least.items():
            automaton.add(split[text], doc)
        automaton.close()
        owners = [automaton.owners(split[text], window) for text in least]
        runs = (pa.array([name[x][i] for x in least], pa.int64()) for i in (0, 1))
        return pa.table({**dict(zip(("run", "run2"), runs, strict=True)), "owners": pa.array(owners, pa.list_(pa.int64()))})

    return run


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, mark, starts): starts of the windows to remove, for each document (id and hash of the text) that has any."""
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, window, gram):
            new = np.ones(len(b.least), bool)
            new[1:] = (b.least[1:] != b.least[:-1]) | (b.doc[1:] != b.doc[:-1])
            yield _counted(b.least[new], b.doc[new])

    common = spark.sparkContext.broadcast(_repeated(rows, minimizers))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, window, gram):
            hit = sketch.contains(common.value, b.least)
            yield _counted(b.window[hit], b.doc[hit])

    double = spark.sparkContext.broadcast(_repeated(rows, windows))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, int] = {}
        for b in blocks(batches, window, gram):
            hit = np.flatnonzero(sketch.contains(common.value, b.least) & sketch.contains(double.value, b.window))
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) != 1) | (b.least[hit][1:] != b.least[hit][:-1]) | (b.doc[hit][1:] != b.doc[hit][:-1])
            head = np.flatnonzero(new)
            at, n, doc = b.word[hit[head]], np.diff(head, append=len(hit)) + window - 1, b.doc[hit[head]]
            texts = [b.words(*x) for x in zip(at.tolist(), n.tolist(), strict=True)]
            names = [xxhash.xxh3_128_intdigest(x) for x in texts]
            ids, marks = (np.array([r[i] for r in b.rows], np.int64)[doc] for i in (0, 1))
            if len(sent) > MEMO:
                sent.clear()
            own: list[bytes | None] = []
            for x, h, d in zip(texts, names, ids.tolist(), strict=True):
                known = sent.get(h)
                if known is None or d < known:
                    sent[h] = d
                    own.append(x)
                else:
                    own.append(None)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([(h >> at_ & (1 << 64) - 1) - (1 << 63) for h in names], pa.int64()) for at_ in (64, 0)), pa.array(ids), pa.array(marks), pa.array((at - b.head[doc]).astype(np.int32)), pa.array(own, pa.binary()), pa.array(b.least[hit[head]].view(np.int64))],
                ["run", "run2", "doc", "mark", "at", "words", "least"],
            )

    found = materialise(rows.mapInArrow(runs, "run long, run2 long, doc long, mark long, at int, words binary, least long"), "runs")
    sent = found.where("words is not null")
    shards = max(1, sent.count() // PER_SHARD)
    first = sent.select("run", "run2", "doc", "words", F.pmod(F.xxhash64("least"), F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(_shard(window), "run long, run2 long, owners array<bigint>")
    first = materialise(first, "owners")
    met = found.select("run", "run2", "doc", "mark", "at").join(first, ["run", "run2"])
    starts = F.filter(F.transform("owners", lambda x, i: F.when(x < F.col("doc"), F.col("at") + i)), lambda x: x.isNotNull())
    return met.select("doc", "mark", starts.alias("starts")).where(F.size("starts") > 0).groupBy("doc", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def cut(text: bytes, starts: list[int], window: int) -> tuple[bytes, int]:
    """The text without the words covered by the windows, and how many those are; the white space after a kept word stays."""
    at = [m.start() for m in _WORDS.finditer(text)]
    gone = np.zeros(len(at) + 1, np.int32)
    np.add.at(gone, np.array(starts), 1)
    np.add.at(gone, np.minimum(np.array(starts) + window, len(at)), -1)
    gone = np.cumsum(gone)[:-1] > 0
    ends = [*at[1:], len(text)]
    return text[: at[0]] + b"".join(text[s:e] for s, e, g in zip(at, ends, gone.tolist(), strict=True) if not g), int(gone.sum())


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, its text without repeated passages, with n_words (before) and n_removed."""
    starts = materialise(repeats(docs, key, text, window, gram), "starts")
    n_words, n_removed, doc, mark, at_, own = unused(docs.columns, "n_words", "n_removed", "doc", "mark", "starts", "own")
    counted = docs.select("*", F.coalesce(F.regexp_count(f"`{text}`", F.lit(WORD)), F.lit(0)).cast("long").alias(n_words))
    hit, rest = sketch.parted(counted, key, starts.select("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            at, by = names.index(text), names.index(at_)
            made, removed = [], []
            for t, s in zip(b.column(at), b.column(by), strict=True):
                if s.is_valid:
                    t, n = cut(t.as_py().encode(), s.as_py(), window)
                    made.append(t.decode())
                    removed.append(n)
                else:
                    made.append(t.as_py())
                    removed.append(0)
            arrays = [pa.array(made, pa.string()) if i == at else b.column(i) for i in range(len(names)) if i != by]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed, pa.int64())], [*(n for i, n in enumerate(names) if i != by), n_removed])

    schema = T.StructType([*counted.schema.fields, T.StructField(n_removed, T.LongType())])
    mine = starts.select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("starts").alias(at_))
    same = (F.col(f"`{key}`") == F.col(doc)) & (F.col(own) == F.col(mark))
    hit = hit.withColumn(own, F.xxhash64(f"`{text}`")).join(mine, same, "left").select(*(f"`{f.name}`" for f in counted.schema.fields), at_)
    return hit.mapInArrow(run, schema).union(rest.withColumn(n_removed, F.lit(0).cast("long")))
