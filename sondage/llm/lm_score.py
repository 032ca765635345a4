"""LM scoring by masked pseudo-likelihood.

A window network predicts each word of a document from the words on both sides
of it; the sum of the conditional log-probabilities is the document's score.
The network is trained here, in numpy: embeddings of the neighbours, one table
for each place, are added up, pass a tanh, and give the word's class and the
word within the class by softmax. The FREQUENT most frequent words of the corpus
are words of their own, others share hashed ids, so every word has an id. In
score_corpus() a word's probability is that of its id times the word's own share
of the id's count in the corpus. The table of these shares has a row for every
word and grows with the corpus: the part of the most frequent words (KNOWN at most, those
of about equal counts all or none) goes along with the network, the others' part is joined to the documents' words by shuffle.

Everything gathered from the corpus covers all of it: word counts come from a
group-by over all documents, and each task trains a copy of the network from
the same start on every word of all its documents. The copies are averaged,
weighted by their words, in blocks that are summed as a stream; the averaged
network, of fixed size, scores all words. So scores depend on how the rows are
dealt to tasks, as the order of training does.

A word's 63-bit hash stands for the word in the join. Shares are summed there as
whole billionths, so that the order of a sum doesn't change it.

Null and empty texts have no words: n_tokens 0, log_prob 0, mean_log_prob null.
Repeated rows get equal scores, rows without an id too. Of words equally
frequent the smaller counts as more frequent. Very long texts are scored whole,
in portions. Other columns aren't read. On an empty table the network is
untrained and there are no scores.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, words_of

#: Words with ids of their own, hashed ids, words of a class, width of the hidden layer, neighbours on either side.
FREQUENT, HASHED, CLASS, HIDDEN, SIDE = 1024, 1024, 64, 16, 2
#: Words whose share is at hand, at most; bins of a doubling of counts by which these are chosen.
KNOWN, BINS = 65_536, 64
#: Words of the first steps, how many those are, words of later steps; rate; words handled at a time.
STEP, SHORT, LONG_STEP, RATE, PORTION = 2048, 32, 16_384, 0.1, 16_384
SEED, BLOCKS = 20240101, 64
SIZE = FREQUENT + HASHED
CLASSES = SIZE // CLASS


class Known(dict):
    """Places of the KNOWN most frequent words (bytes) by frequency; n: their counts."""

    def __init__(self, words: list[bytes], n: list[int]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.n = np.array(n, np.int64)


_HASH = 1 << 63


class Ids(dict):
    """Codes of words (bytes), remembered up to a bound: the place of a known word, else its hash with the topmost bit set."""

    LIMIT = 1_000_000

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.known = known
        #: Ids of the known words.
        self.table = np.fromiter((i if i < FREQUENT else FREQUENT + self._hash(w) % HASHED for w, i in known.items()), np.int64, len(known))

    @staticmethod
    def _hash(word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word) | _HASH

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
            self.update(self.known)
        code = self[word] = self._hash(word)
        return code

    def codes(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def ids(self, codes: np.ndarray) -> np.ndarray:
        out = (codes % np.uint64(HASHED)).astype(np.int64) + FREQUENT
        known = codes < np.uint64(KNOWN)
        out[known] = self.table[codes[known].astype(np.int64)]
        return out

    def of(self, text: bytes | None) -> np.ndarray:
        return self.ids(self.codes(text))

    def id(self, word: bytes) -> int:
        return int(self.ids(np.array([self[word]], np.uint64))[0])


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n of every word of the corpus, written."""
    return materialise(docs.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")


def vocabulary(docs: DataFrame, text: str = "text", counts: DataFrame | None = None) -> tuple[Known, np.ndarray]:
    """The most frequent words, and the corpus count of every id. counts: counted(docs), where it is there already."""
    counts = counted(docs, text) if counts is None else counts
    # The least count of a known word is set by a histogram of counts, so that no more than KNOWN words reach the driver.
    by_bin = counts.groupBy(F.floor(F.log2("n") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    least, total = 1 << 62, 0
    for r in sorted(by_bin.collect(), key=lambda r: -r["bin"]):  # some thousand rows at most
        total += r["words"]
        if total > KNOWN:
            break
        least = r["least"]
    top = sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))
    known = Known([r["word"].encode() for r in top], [r["n"] for r in top])
    given = counts.sparkSession.sparkContext.broadcast(known)
    number = np.zeros(SIZE)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ids(given.value)
        sums = np.zeros(SIZE, np.int64)
        for b in batches:
            codes = np.fromiter((own[w.encode()] for w in b.column(0).to_pylist()), np.uint64, b.num_rows)
            np.add.at(sums, own.ids(codes), np.asarray(b.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums)), pa.array(sums[sums > 0])], ["id", "n"])

    for r in counts.mapInArrow(hashed, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # SIZE rows at most
        number[r["id"]] = r["n"]
    return known, number


def known_shares(known: Known, number: np.ndarray) -> np.ndarray:
    """Log of each known word's part of its id's count."""
    return np.log(known.n / number[Ids(known).table]) if len(known) else np.zeros(0)


def shares(counts: DataFrame, known: Known, number: np.ndarray) -> DataFrame:
    """word (its code), share (log of its part of its id's count, in billionths) of every word that isn't known."""
    given = counts.sparkSession.sparkContext.broadcast((known, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, sums = given.value
        own = Ids(frequent)
        for b in batches:
            codes = np.fromiter((own[w.encode()] for w in b.column(0).to_pylist()), np.uint64, b.num_rows)
            rare = codes >= np.uint64(_HASH)
            part = np.rint(1e9 * np.log(np.asarray(b.column(1))[rare] / sums[own.ids(codes[rare])])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes[rare].view(np.int64)), pa.array(part)], ["word", "share"])

    return counts.select("word", "n").mapInArrow(run, "word long, share long")


@dataclass
class Network:
    """Parameters: neighbours' embeddings, their bias, class weights and biases, word weights and biases by class."""

    near: np.ndarray
    bias: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small random embeddings, and biases that give each id its corpus frequency."""
        rng = np.random.default_rng(SEED)
        share = ((counts + 1) / (counts + 1).sum()).reshape(CLASSES, CLASS)
        f = np.float32
        return cls(
            rng.normal(0, 0.1, (2 * SIDE, SIZE + 1, HIDDEN)).astype(f), np.zeros(HIDDEN, f),
            rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(f), np.log(share.sum(1)).astype(f),
            rng.normal(0, 0.1, (CLASSES, HIDDEN, CLASS)).astype(f), np.log(share / share.sum(1, keepdims=True)).astype(f),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.near, self.bias, self.to_class, self.class_bias, self.to_word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Network:
        at, out = 0, []
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.bias + self.near[0][context[:, 0]]
        for o in range(1, 2 * SIDE):
            h += self.near[o][context[:, o]]
        return np.tanh(h)

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its neighbours."""
        order = np.argsort(target.astype(np.int16), kind="stable")
        target, h = target[order], self.hidden(context[order])
        kind, place = target // CLASS, target % CLASS
        out = _log_prob(self.to_class.T @ h.T + self.class_bias[:, None], kind)
        for k, a, b in _runs(kind):
            out[a:b] += _log_prob(self.to_word[k].T @ h[a:b].T + self.word_bias[k][:, None], place[a:b])
        found = np.empty_like(out)
        found[order] = out
        return found


# Logits have a column for each word: reductions then go over whole rows at a time, which is several times faster than along short rows.


def _log_prob(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Log-softmax of each column at its row."""
    x -= x.max(axis=0)
    own = x[row, np.arange(x.shape[1])].astype(np.float64)
    np.exp(x, out=x)
    return own - np.log(x.sum(axis=0))


def _slope(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The softmax of each column less one at its row, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    x[row, np.arange(x.shape[1])] -= 1
    return x


def _runs(kind: np.ndarray) -> list[tuple[int, int, int]]:
    """(class, from, to) of the classes that occur in a sorted array."""
    ends = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    return [(k, a, b) for k, (a, b) in enumerate(itertools.pairwise(ends)) if a < b]


class Trainer:
    """Gradient steps with rates adapted to each parameter's past slopes."""

    def __init__(self, net: Network):
        self.net, self.past = net, [np.full(p.shape, 1e-6, np.float32) for p in net.parts()]

    def _move(self, i: int, slope: np.ndarray, at=...) -> None:
        past = self.past[i][at] + slope * slope
        self.past[i][at] = past
        slope *= RATE
        slope /= np.sqrt(past)
        self.net.parts()[i][at] -= slope

    def run(self, context: np.ndarray, target: np.ndarray, before: int) -> int:
        """Steps over some words, short ones at first; before: steps made so far. Returns how many were made."""
        size = STEP if before < SHORT else max(1, len(target))
        made = range(0, len(target), size)
        for i in made:
            self.step(context[i : i + size], target[i : i + size])
        return len(made)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        net, n = self.net, len(target)
        order = np.argsort(target.astype(np.int16), kind="stable")
        context, target = context[order], target[order]
        h = net.hidden(context)
        kind, place = target // CLASS, target % CLASS
        d = _slope(net.to_class.T @ h.T + net.class_bias[:, None], kind)
        dh = net.to_class @ d
        self._move(2, (d @ h).T / n)
        self._move(3, d.sum(1) / n)
        slopes, biases = np.zeros_like(net.to_word), np.zeros_like(net.word_bias)
        for k, a, b in _runs(kind):
            d = _slope(net.to_word[k].T @ h[a:b].T + net.word_bias[k][:, None], place[a:b])
            dh[:, a:b] += net.to_word[k] @ d
            slopes[k], biases[k] = (d @ h[a:b]).T, d.sum(1)
        self._move(4, slopes / n)
        self._move(5, biases / n)
        dh = dh.T
        dh = np.ascontiguousarray(dh) * (1 - h * h)
        self._move(1, dh.sum(0) / n)
        dh /= n
        for o in range(2 * SIDE):
            ids = context[:, o].astype(np.int16)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            at = np.flatnonzero(np.diff(ids, prepend=-1))
            self._move(0, np.add.reduceat(dh[order], at), (o, ids[at]))


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ids of the neighbours of the places at; beyond the ends of the document stands SIZE."""
    wide = np.concatenate([np.full(SIDE, SIZE), ids, np.full(SIDE, SIZE)])
    return np.stack([wide[at + SIDE + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def train(docs: DataFrame, known: Known, counts: np.ndarray, text: str = "text") -> Network:
    """The averaged network of the copies that the tasks train on their documents."""
    start = Network.start(counts)
    given = docs.sparkSession.sparkContext.broadcast((known, start))
    length = -(-len(start.flat()) // BLOCKS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, first = given.value
        own, net = Ids(frequent), first.filled(first.flat())
        trainer, held, size, seen, steps = Trainer(net), [], 0, 0, 0
        for b in batches:
            for t in b.column(0):
                x = own.of(t.as_buffer().to_pybytes() if t.is_valid else None)
                held.append(x)
                size += len(x)
                if size >= LONG_STEP:
                    c, y = np.concatenate([contexts(x, np.arange(len(x))) for x in held]), np.concatenate(held)
                    for i in range(0, size, LONG_STEP):
                        steps += trainer.run(c[i : i + LONG_STEP], y[i : i + LONG_STEP], steps)
                    seen += size
                    held, size = [], 0
        if size:
            trainer.run(np.concatenate([contexts(x, np.arange(len(x))) for x in held]), np.concatenate(held), steps)
            seen += size
        if seen:
            flat = net.flat()
            made = [flat[i * length : (i + 1) * length].tobytes() for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array(made, pa.binary())], ["block", "n", "data"])

    def mean(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = 0.0, 0
        for b in rows:
            for n, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                total, weight = total + n * np.frombuffer(data, np.float32).astype(np.float64), weight + n
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(total / weight).tobytes()], pa.binary())], ["block", "data"])

    copies = docs.select(F.col(text)).mapInArrow(local, "block int, n long, data binary")
    found = copies.groupBy("block").applyInArrow(mean, "block int, data binary").collect()  # BLOCKS rows
    return start.filled(np.concatenate([np.frombuffer(r["data"]) for r in sorted(found, key=lambda r: r["block"])])) if found else start


_SCORED = "doc_id long, n_tokens long, log_prob double, mean_log_prob double, rare array<long>"


def score(docs: DataFrame, net: Network, known: Known, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob of every row, log_prob being that of the words' ids."""
    return _scored(docs, net, known, None, key, text).drop("rare")


def _scored(docs: DataFrame, net: Network, known: Known, number: np.ndarray | None, key: str, text: str) -> DataFrame:
    """score() with the codes of the words that aren't known; with number, known words have their own probabilities."""
    own_shares = np.zeros(len(known)) if number is None else known_shares(known, number)
    given = docs.sparkSession.sparkContext.broadcast((known, net, own_shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, model, share = given.value
        own = Ids(frequent)

        def scored(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of each document the sum and the number of rare words, and these words."""
            ends, every = np.cumsum([0, *map(len, codes)]), np.concatenate(codes)
            ids = own.ids(every)
            c = np.concatenate([contexts(ids[a:e], np.arange(e - a)) for a, e in itertools.pairwise(ends.tolist())])
            p = np.concatenate([model.log_prob(c[i : i + PORTION], ids[i : i + PORTION]) for i in range(0, max(1, len(ids)), PORTION)])
            rare = every >= np.uint64(_HASH)
            p[~rare] += share[every[~rare].astype(np.int64)]
            sums = np.array([p[a:e].sum() for a, e in itertools.pairwise(ends.tolist())])
            return sums, np.diff(np.concatenate([[0], np.cumsum(rare)])[ends]), every[rare].view(np.int64)

        for b in batches:
            sizes, held, size, made = [], [], 0, [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for t in b.column(1):
                x = own.codes(t.as_buffer().to_pybytes() if t.is_valid else None)
                sizes.append(len(x))
                held.append(x)
                size += len(x)
                if size >= PORTION:
                    made.append(scored(held))
                    held, size = [], 0
            if held:
                made.append(scored(held))
            total, rares, words = (np.concatenate(x) for x in zip(*made, strict=True))
            n = np.array(sizes, np.int64)
            mean = pa.array(np.divide(total, np.maximum(n, 1)), mask=n == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rares)]), pa.int32()), pa.array(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total), mean, lists], ["doc_id", "n_tokens", "log_prob", "mean_log_prob", "rare"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, _SCORED)


def score_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Vocabulary, training and scoring on the same documents."""
    words = counted(docs, text)
    known, number = vocabulary(docs, text, words)
    net = train(docs, known, number, text)
    scored = materialise(_scored(docs, net, known, number, key, text).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(shares(words, known, number), "word")
    sums = rare.groupBy("row").agg(F.sum("share").alias("share"))
    met = scored.select("row", "doc_id", "n_tokens", "log_prob").join(sums, "row", "left")
    log_prob = F.col("log_prob") + F.coalesce(F.col("share"), F.lit(0)) / F.lit(1e9)
    return met.select("doc_id", "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob"))
