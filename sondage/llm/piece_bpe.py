"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The vocabulary is read from the model file. A text gets the dummy prefix, spaces become U+2581, and words are cut where no piece of the
vocabulary can reach across. Words that a worker hasn't met are laid out together in one flat array of symbols. In each round every
word finds the least rank among its neighbouring pairs (a segmented minimum), merges them from the left, all words at once, and the
array is compacted; words without a pair are done. Ranks are the order of scores, so the result is that of merging the best pair, leftmost
first, one at a time: a round merges more than one pair of a word only if no piece that begins or ends with the merged one has a rank as
good, since such a piece would have come before the next pair. Words of more than `LONG` symbols, of which a round would merge too
little, take their pairs from a heap, with the same result. Characters without a piece become bytes.

Null texts count as empty: no ids. Very long texts are taken by portions. Repeated rows give repeated rows, an empty table an empty one;
other columns stay, but for one with the output's name. Decoding accepts any ids of the vocabulary; null ids count as none.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: What decoding gives for the unknown piece.
UNKNOWN_SURFACE = " ⁇ "
#: Words remembered by a worker, and their length; characters of a text taken at a time; symbols of a word merged in rounds.
MEMO, MEMO_CHARS, PORTION, LONG = 500_000, 48, 1_000_000, 512
_NONE = np.iinfo(np.int32).max

codecs.register_error("sondage-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: number and value; values of 32 and 64 bits stay bytes."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value

    at = 0
    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at : at + size]
        at += size


class PieceBpe:
    """Encoder and decoder of one model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        pieces = [dict(fields(v)) for k, v in message if k == 1]
        trainer = dict(fields(next((v for k, v in message if k == 2), b"")))
        normaliser = dict(fields(next((v for k, v in message if k == 3), b"")))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("only BPE models with byte fallback, dummy prefix and identity normalisation are known")
        self.names = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, _NORMAL) for p in pieces]
        if not set(self.kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("user-defined and unused pieces are not known")
        scores = [struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces]
        self.bytes_of = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == _BYTE}
        normal = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == _NORMAL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        self._pairs(normal, {n: order[scores[i]] for n, i in normal.items()})
        self.controls = {i for i, k in enumerate(self.kinds) if k == _CONTROL}
        self.surfaces = [self._surface(i) for i in range(len(pieces))]
        self.memo: dict[str, bytes] = {}

    def _pairs(self, normal: dict[str, int], rank: dict[str, int]) -> None:
        """Symbols (pieces, and characters that only occur inside them), mergeable pairs, and pieces that merge one at a time."""
        long = [p for p in normal if len(p) > 1]
        inner = sorted({c for p in long for c in p})
        symbol = dict(normal)
        for c in inner:
            symbol.setdefault(c, len(self.names) + len(symbol))
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.class_of = np.zeros(0x110000, np.int16)
        self.class_of[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.joins = np.zeros((len(inner) + 1,) * 2, bool)
        for p in long:
            c = self.class_of[[ord(x) for x in p]]
            self.joins[c[:-1], c[1:]] = True
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in long) else "(?s:.+)")
        self.width = max(symbol.values()) + 1
        self.rank = np.full(self.width, _NONE, np.int32)
        self.alone = np.zeros(self.width, bool)
        pairs: dict[int, int] = {}
        best_around: dict[str, int] = {}
        for p in long:
            self.rank[symbol[p]] = rank[p]
            for i in range(1, len(p)):
                a, b = p[:i], p[i:]
                if a in symbol and b in symbol:
                    pairs[symbol[a] * self.width + symbol[b]] = symbol[p]
                for q in (a, b):
                    if q in rank:
                        best_around[q] = min(best_around.get(q, _NONE), rank[p])
        for p, r in best_around.items():
            self.alone[symbol[p]] = r <= rank[p]
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        # A table addressed by hash: most pairs are found, or found missing, at the first place.
        self.power = max(4, (len(keys) * 8).bit_length())
        self.table = np.full(1 << self.power, -1, np.int64)
        self.value = np.zeros(1 << self.power, np.int32)
        self.probes = 1
        for k in keys.tolist():
            at, n = int(self._place(np.array([k]))[0]), 1
            while self.table[at] >= 0:
                at, n = (at + 1) & (1 << self.power) - 1, n + 1
            self.table[at], self.value[at] = k, pairs[k]
            self.probes = max(self.probes, n)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.power)).astype(np.int64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Symbol that each pair merges into, or -1."""
        key = left.astype(np.int64) * self.width + right
        at = self._place(key)
        met = self.table[at]
        out = np.where(met == key, self.value[at], -1)
        open_ = np.flatnonzero((met != key) & (met >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (1 << self.power) - 1
            met = self.table[at[open_]]
            hit = met == key[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return out

    def _rounds(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that remain of each segment when no pair can be merged, with their segments, in order. Segments are numbered upwards."""
        done_symbols, done_segments = [], []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            merged = np.full(len(symbols), -1, np.int32)
            merged[:-1] = self._merged(symbols[:-1], symbols[1:])
            merged[np.concatenate([first[1:], [len(symbols)]]) - 1] = -1
            rank = np.where(merged >= 0, self.rank[merged], _NONE)
            sizes = np.diff(np.concatenate([first, [len(symbols)]]))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            hit = (rank == least) & (merged >= 0)
            at = np.flatnonzero(hit)
            # Where a piece may come between, a segment merges its leftmost pair only; elsewhere all that don't overlap one further left.
            own = segment[at]
            leftmost = np.concatenate([[True], own[1:] != own[:-1]])[: len(at)]
            single = np.zeros(len(at), bool)
            if len(at):
                group = np.cumsum(leftmost) - 1
                single = np.logical_or.reduceat(self.alone[merged[at]], np.flatnonzero(leftmost))[group]
                # Place in a row of overlapping pairs: every other one is taken.
                fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | leftmost[1:]])
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[np.where(single, leftmost, place % 2 == 0)]
            symbols[at] = merged[at]
            over = least == _NONE
            done_symbols.append(symbols[over])
            done_segments.append(segment[over])
            keep = ~over
            keep[at + 1] = False
            symbols, segment = symbols[keep], segment[keep]
        out, own = np.concatenate(done_symbols or [symbols]), np.concatenate(done_segments or [segment])
        order = np.argsort(own, kind="stable")
        return out[order], own[order]

    def _heaped(self, symbols: list[int]) -> list[int]:
        """The same for one long segment: pairs wait in a heap by rank and place."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.pairs.get(symbols[i] * self.width + symbols[j])) is not None:
                heap.append((int(self.rank[m]), i, j, m))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, j, m = heapq.heappop(heap)
            if gone[i] or after[i] != j or self.pairs.get(symbols[i] * self.width + symbols[j]) != m:
                continue
            symbols[i], gone[j], after[i] = m, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            fresh, heap_end = [before[i], i] if before[i] >= 0 else [i], len(heap)
            for k in fresh:
                offer(k)
            added = heap[heap_end:]
            del heap[heap_end:]
            for x in added:
                heapq.heappush(heap, x)
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words as 32-bit integers."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        kind = self.class_of[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.joins[kind[:-1], kind[1:]]
        cut[np.cumsum(size)[:-1]] = True
        segment = np.cumsum(cut) - 1
        word = np.repeat(np.arange(len(words)), size)[cut]  # of each segment
        lengths = np.bincount(segment, minlength=len(word))
        known = self.of_char[points]
        symbols = np.where(known >= 0, known, -1 - points.astype(np.int64)).astype(np.int32)
        long = lengths[segment] > LONG
        several = (lengths[segment] > 1) & ~long
        ids, own = self._rounds(symbols[several], segment[several])
        parts, owns = [ids, symbols[lengths[segment] == 1]], [own, segment[lengths[segment] == 1]]
        for s in np.flatnonzero(lengths > LONG).tolist():
            parts.append(np.array(self._heaped(symbols[segment == s].tolist()), np.int32))
            owns.append(np.full(len(parts[-1]), s))
        ids, own = np.concatenate(parts), np.concatenate(owns)
        order = np.argsort(own, kind="stable")
        ids, own = ids[order], word[own[order]]
        plain = (ids >= 0) & (ids < len(self.names))
        if not plain.all():
            # A character without a piece becomes the ids of its bytes.
            where = np.flatnonzero(~plain)
            back = {int(self.of_char[ord(c)]): ord(c) for c in {chr(-1 - i) if i < 0 else self._char(i) for i in ids[where].tolist()} if self.of_char[ord(c)] >= 0}
            spelt = [[self.bytes_of[b] for b in chr(back.get(i, -1 - i)).encode()] for i in ids[where].tolist()]
            count = np.ones(len(ids), np.int64)
            count[where] = [len(x) for x in spelt]
            wide = np.repeat(ids, count)
            wide[np.repeat(~plain, count)] = [b for x in spelt for b in x]
            ids, own = wide, np.repeat(own, count)
        ends = np.searchsorted(own, np.arange(len(words)), side="right").tolist()
        data = ids.astype(np.int32).tobytes()
        return [data[4 * s : 4 * e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    @lru_cache(maxsize=4096)
    def _char(self, symbol: int) -> str:
        return chr(int(np.flatnonzero(self.of_char == symbol)[0]))

    def _portions(self, text: str) -> Iterator[str]:
        """A text in parts that end where a word does."""
        at = 0
        while len(text) - at > PORTION:
            stop = text.find(SPACE, at + PORTION)
            while stop > 0 and text[stop - 1] == SPACE:
                stop = text.find(SPACE, stop + 1)
            if stop < 0:
                break
            yield text[at:stop]
            at = stop
        yield text[at:]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit integers in the machine's order; words new to the memo are merged together."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in self._portions(SPACE + text.replace(" ", SPACE)) if text else ():
                held.append((i, self.words.findall(part)))
                size += len(part)
                if size > PORTION:
                    self._take(held, out)
                    held, size = [], 0
        self._take(held, out)
        return [b"".join(parts) for parts in out]

    def _take(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list(set().union(*(words for _, words in held)).difference(memo))
        if new:
            memo.update(zip(new, self._new(new), strict=True))
        for i, words in held:
            out[i].append(b"".join(map(memo.__getitem__, words)))
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]

    def _surface(self, i: int) -> bytes:
        kind, name = self.kinds[i], self.names[i]
        if kind == _BYTE:
            return bytes([int(name[3:5], 16)])
        return (UNKNOWN_SURFACE if kind == _UNKNOWN else "" if kind == _CONTROL else name.replace(SPACE, " ")).encode()

    def decode(self, ids: list[int]) -> str:
        """The pieces' text without the dummy prefix; a byte that is no part of a character becomes U+FFFD."""
        if self.controls.isdisjoint(ids):
            parts = [ids]
        else:
            # A control piece has no text, but ends a run of bytes.
            turn = [i for i, x in enumerate(ids) if x in self.controls]
            parts = [p for s, e in zip([0, *(i + 1 for i in turn)], [*turn, len(ids)], strict=True) if (p := ids[s:e])]
        out = [b"".join(map(self.surfaces.__getitem__, p)) for p in parts]
        if parts and parts[0] and self.kinds[parts[0][0]] == _NORMAL and self.names[parts[0][0]].startswith(SPACE):
            out[0] = out[0][1:]
        return "".join([x.decode("utf-8", "sondage-each-byte") for x in out])


@lru_cache(maxsize=2)
def _codec(path: str) -> PieceBpe:
    return PieceBpe(path)


def _added(df: DataFrame, name: str, kind: T.DataType, made) -> DataFrame:
    """df with a column that made() gives for each batch, in place of one of that name."""
    rest = [f for f in df.schema.fields if f.name.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in rest), made(b)], [*(f.name for f in rest), name])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(name, kind)]))


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of its text as array<int> in column ids."""

    def made(b: pa.RecordBatch) -> pa.Array:
        found, offsets = _codec(model).encode(b.column(b.schema.get_field_index(text)).to_pylist()), [0]
        for own in found:
            offsets.append(offsets[-1] + len(own) // 4)
        flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(found))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return _added(df, ids, T.ArrayType(T.IntegerType()), made)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that its ids stand for in column text."""

    def made(b: pa.RecordBatch) -> pa.Array:
        codec = _codec(model)
        column = b.column(b.schema.get_field_index(ids))
        return pa.array([codec.decode(own.values.to_pylist() if own.is_valid else []) for own in column], pa.string())

    return _added(df, text, T.StringType(), made)
