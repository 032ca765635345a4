"""A lexical index that is kept up to date in immutable segments.

A segment is written once: `rows` (each row of the corpus with its tokens), `postings` (of each token and block: rows that hold it, the least
length for each frequency, and their places) and `docs` (rows, words and blocks of each path). A block is BLOCK_ROWS neighbouring rows of `rows`.
The corpus is tokenised once and nothing but the figures of paths is shuffled: a task turns the rows that it reads, some at a time
(see postings), into runs in the order of token and block. Upserts write a new
segment. Deletes and renames write what has become of a segment's paths (`fates`: nothing, or another name), and no segment. Each change
ends with a new version of the manifest, a row with the live segments and the corpus figures, so that a search reads one
state throughout and a change that fails half-way leaves the old one. Of two writers at once one fails.

compacted() merges segments by tiers of size: where `fan` of one tier have come together they become one, without what is gone.

best() is a keyword search that skips blocks. What a word adds to a row's score rises with its frequency and
falls with the row's length, so its greatest share in a block is that of one of the block's points (frequency, least length), whatever the
corpus figures are by now; a block's bound is the sum over the query's words. The blocks with the best bounds are read first; then those whose bound reaches the last of the best rows found. Other
blocks can't hold an answer. Rows that hold a token are counted by block, and anew only in blocks with a changed path.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.text import tokens

from . import bm25
from .postings import GROUP_BYTES, entries, runs, starts

#: Rows of a block, about; blocks read before the rest is bounded; blocks named in a filter rather than joined; changed paths that are broadcast.
BLOCK_ROWS, FIRST, LISTED, FEW = 32, 64, 4096, 100_000
KEYS = ["path", "chunk_no"]
_STATE = "version long, next int, segments array<struct<no:int,rows:long,words:long,stored:long>>, fates long"
_ROWS = "path string, chunk_no int, dl int, t array<string>, block long"
_DOCS = "path string, rows long, words long, blocks array<long>"
_HELD = "array<struct<path:string,chunk_no:int,dl:int,f:int,at:array<int>>>"
_POSTINGS = f"token string, block long, n long, points array<struct<f:int,dl:int>>, held {_HELD}"


@dataclass(frozen=True)
class Segment:
    """rows and words are those alive, stored all rows that were written."""

    no: int
    rows: int
    words: int
    stored: int


def _impact(f: Column, dl: Column, avg: float) -> Column:
    f = f.cast("double")
    return f * (bm25.K1 + 1) / (f + bm25.K1 * (1 - bm25.B + bm25.B * dl / F.lit(avg)))


def _run(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of some rows, in the order of token and block."""
    e = entries(rows.column("t"))
    row = pa.array(e.row)
    lengths, own = (rows.column(c).to_numpy()[e.row] for c in ("dl", "block"))
    held = pa.StructArray.from_arrays([rows.column("path").take(row), rows.column("chunk_no").take(row), pa.array(lengths), pa.array(e.f), e.at], ["path", "chunk_no", "dl", "f", "at"])
    group = starts(e.token, own) if len(own) else np.zeros(1, np.int32)  # a token of a block
    n = np.diff(group)
    number = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((lengths, e.f, number))
    first = starts(number[by], e.f[by])[:-1] if len(by) else np.zeros(0, np.int32)
    point = pa.StructArray.from_arrays([pa.array(e.f[by][first]), pa.array(lengths[by][first])], ["f", "dl"])
    edges = np.searchsorted(number[by][first], np.arange(len(n) + 1)).astype(np.int32)
    columns = [
        e.words.take(pa.array(e.token[group[:-1]])), pa.array(own[group[:-1]]), pa.array(n.astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(edges), point), pa.ListArray.from_arrays(pa.array(group), held),
    ]
    return pa.RecordBatch.from_arrays(columns, ["token", "block", "n", "points", "held"])


@dataclass
class Segments:
    """One state of an index in a folder that all executors share. Methods that change it return the next state."""

    spark: SparkSession
    folder: str
    version: int = 0
    next: int = 0
    segments: list[Segment] = field(default_factory=list)
    fated: int = 0
    #: (blocks read, blocks that hold a word) of the last best().
    read: tuple[int, int] | None = None

    @staticmethod
    def create(spark: SparkSession, folder: str) -> Segments:
        return Segments(spark, folder)._next([], 0, 0)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Segments:
        r = spark.read.schema(_STATE).parquet(f"{folder}/manifest").orderBy(F.desc("version")).first()
        return Segments(spark, folder, r["version"], r["next"], [Segment(*s) for s in r["segments"]], r["fates"])

    def _next(self, segments: list[Segment], taken: int, fates: int) -> Segments:
        """The next state, written as a version that must not exist yet. Segments without a row are left out."""
        made = Segments(self.spark, self.folder, self.version + 1, self.next + taken, [s for s in segments if s.rows], fates)
        row = (made.version, made.next, [(s.no, s.rows, s.words, s.stored) for s in made.segments], made.fated)
        self.spark.createDataFrame([row], _STATE).coalesce(1).write.parquet(f"{self.folder}/manifest/version={made.version}")
        return made

    def _table(self, name: str, schema: str, numbers: list[int] | None = None) -> DataFrame:
        """The rows of the live segments, or of those named."""
        numbers = [s.no for s in self.segments] if numbers is None else numbers
        if not numbers:
            return self.spark.createDataFrame([], f"{schema}, seg int")
        return self.spark.read.schema(f"{schema}, seg int").parquet(f"{self.folder}/{name}").where(F.col("seg").isin(numbers))

    def _rows(self, numbers: list[int] | None = None) -> DataFrame:
        return self._table("rows", _ROWS, numbers)

    def _postings(self) -> DataFrame:
        return self._table("postings", _POSTINGS)

    def held(self) -> DataFrame:
        """seg, block, token, path, chunk_no, dl, f: each row of the corpus by its tokens."""
        p = self._postings().select("seg", "block", "token", F.explode("held").alias("h"))
        return p.select("seg", "block", "token", "h.path", "h.chunk_no", "h.dl", "h.f")

    def places(self) -> DataFrame:
        """seg, path, chunk_no, dl, token, at: each word of the corpus."""
        p = self._postings().select("seg", "token", F.explode("held").alias("h"))
        return p.select("seg", "h.path", "h.chunk_no", "h.dl", "token", F.explode("h.at").alias("at"))

    def blocks(self) -> DataFrame:
        return self._postings().select("seg", "token", "block", "n", "points")

    def docs(self) -> DataFrame:
        return self._table("docs", _DOCS)

    def fates(self) -> DataFrame:
        """(seg, path, now): the latest of each changed path of the live segments; now is null for what is gone."""
        if not self.fated:
            return self.spark.createDataFrame([], "seg int, path string, now string")
        f = self.spark.read.schema("seg int, path string, now string, version long").parquet(f"{self.folder}/fates")
        f = f.where((F.col("version") <= self.version) & F.col("seg").isin([s.no for s in self.segments]))
        last = f.groupBy("seg", "path").agg(F.max(F.struct("version", "now"))["now"].alias("now"))
        return F.broadcast(last) if self.fated <= FEW else last

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows (seg, path, ...) under their present names, without what is gone."""
        if not self.fated:
            return rows
        f = self.fates().select("seg", "path", "now", F.lit(True).alias("_changed"))
        met = rows.join(f, ["seg", "path"], "left").where(F.col("_changed").isNull() | F.col("now").isNotNull())
        return met.withColumn("path", F.coalesce("now", "path")).select(rows.columns)

    # --- changes

    def _saved(self, no: int, rows: DataFrame) -> DataFrame:
        """The rows (path, chunk_no, t) of a segment, written; neighbours share a block."""
        block = F.floor(F.monotonically_increasing_id() / BLOCK_ROWS)
        own = rows.select("path", F.col("chunk_no").cast("int").alias("chunk_no"), F.size("t").alias("dl"), "t", block.alias("block"))
        own.write.mode("overwrite").parquet(f"{self.folder}/rows/seg={no}")
        return self._rows([no])

    def _written(self, no: int) -> Segment:
        """The postings and docs of a segment whose rows are saved."""
        rows = self._rows([no])
        made = rows.drop("seg").mapInArrow(runs(_run), _POSTINGS)
        made.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{self.folder}/postings/seg={no}")
        by_path = rows.groupBy("path").agg(F.count("*").alias("rows"), F.sum("dl").alias("words"), F.collect_set("block").alias("blocks"))
        by_path.write.mode("overwrite").parquet(f"{self.folder}/docs/seg={no}")
        total = self._table("docs", _DOCS, [no]).agg(F.sum("rows"), F.sum("words")).first()
        return Segment(no, total[0] or 0, total[1] or 0, total[0] or 0)

    def upserted(self, chunks: DataFrame) -> Segments:
        """With the rows (path, chunk_no, content) in place of all rows that their paths had. Paths must not be null."""
        saved = self._saved(self.next, chunks.select("path", "chunk_no", tokens(F.coalesce(F.col("content"), F.lit(""))).alias("t")))
        if saved.isEmpty():
            return self
        state = self.deleted(saved.select("path").distinct()) if self.segments else self
        return state._next([*state.segments, state._written(self.next)], 1, state.fated)

    def _changed(self, now: DataFrame) -> Segments:
        """now (path, now): what becomes of present paths."""
        known = self.docs()
        f = self.fates().select("seg", "path", "now", F.lit(True).alias("_changed"))
        known = known.join(f, ["seg", "path"], "left").where(F.col("_changed").isNull() | F.col("now").isNotNull())
        present = known.select("seg", F.col("path").alias("stored"), F.coalesce("now", "path").alias("path"), "rows", "words", "blocks")
        met = present.join(now, "path").select("seg", F.col("stored").alias("path"), "now", "rows", "words", "blocks")
        where = f"{self.folder}/fates/version={self.version + 1}"
        met.write.mode("overwrite").parquet(where)
        met = self.spark.read.schema("seg int, path string, now string, rows long, words long").parquet(where)
        gone = {r["seg"]: r for r in met.groupBy("seg").agg(F.count("*").alias("n"), *(F.sum(F.when(F.col("now").isNull(), F.col(c)).otherwise(0)).alias(c) for c in ("rows", "words"))).collect()}
        if not gone:
            return self
        left = [Segment(s.no, s.rows - gone[s.no]["rows"], s.words - gone[s.no]["words"], s.stored) if s.no in gone else s for s in self.segments]
        return self._next(left, 0, self.fated + sum(r["n"] for r in gone.values()))

    def deleted(self, paths: DataFrame) -> Segments:
        return self._changed(paths.select("path", F.lit(None).cast("string").alias("now")).distinct())

    def renamed(self, pairs: DataFrame) -> Segments:
        """Under new names (old, new); what had such a name, and isn't renamed itself, is replaced. An old name must occur once."""
        pairs = pairs.where("old <> new")
        over = pairs.join(self._alive(self.docs()).select(F.col("path").alias("old")).distinct(), "old", "left_semi").select(F.col("new").alias("path"))
        over = over.join(pairs.select(F.col("old").alias("path")), "path", "left_anti").distinct()
        return self._changed(pairs.select(F.col("old").alias("path"), F.col("new").alias("now")).union(over.select("path", F.lit(None).cast("string"))))

    def pruned(self, live: DataFrame) -> Segments:
        """Without the paths that aren't live."""
        return self.deleted(self._alive(self.docs()).select("path").distinct().join(live.select("path"), "path", "left_anti"))

    def reset(self) -> Segments:
        return self._next([], 0, 0)

    def compacted(self, fan: int = 4) -> Segments:
        """With segments merged until no tier of size (powers of fan, rows that are gone included) holds fan of them."""
        state = self
        while True:
            tiers: dict[int, list[Segment]] = {}
            for s in state.segments:
                tiers.setdefault(int(math.log(s.stored, fan) + 1e-9), []).append(s)
            full = [own for _, own in sorted(tiers.items()) if len(own) >= fan]
            if not full:
                return state
            merged = full[0]
            numbers = [s.no for s in merged]
            state._saved(state.next, state._alive(state._rows(numbers).select("seg", "path", "chunk_no", "t")))
            made = state._written(state.next)
            left = [s for s in state.segments if s.no not in numbers]
            rest = state.fates().where(F.col("seg").isin([s.no for s in left])).count() if state.fated and left else 0
            state = state._next([*left, made], 1, rest)

    # --- searches

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)

    @property
    def average(self) -> float:
        return sum(s.words for s in self.segments) / self.rows if self.rows else 0.0

    def live(self) -> bm25.Index:
        """The whole index as one, for channels of any kind. A search reads the row groups that hold its words."""
        figures = self.spark.createDataFrame([(self.rows, self.average)], "n long, avgdl double")
        return bm25.Index(self._alive(self.places()).drop("seg"), figures)

    def _dirty(self) -> DataFrame:
        """(seg, block) with a changed path."""
        f = self.spark.read.schema("seg int, path string, blocks array<long>, version long").parquet(f"{self.folder}/fates")
        f = f.where((F.col("version") <= self.version) & F.col("seg").isin([s.no for s in self.segments]))
        return f.select("seg", F.explode("blocks").alias("block")).distinct()

    def _holding(self, words: list[str]) -> dict[str, int]:
        """Live rows that hold each word."""
        mine = self.blocks().where(F.col("token").isin(words))
        if not self.fated:
            return {r["token"]: r["n"] for r in mine.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # a row for each word
        dirty = self._dirty()
        clean = mine.join(dirty, ["seg", "block"], "left_anti").select("token", "n")
        again = self._alive(self.held().where(F.col("token").isin(words)).join(dirty, ["seg", "block"], "left_semi"))
        counted = again.groupBy("token").agg(F.count("*").alias("n"))
        return {r["token"]: r["n"] for r in clean.union(counted).groupBy("token").agg(F.sum("n").alias("n")).collect()}

    def _scores(self, weight: dict[str, Column], within: DataFrame) -> DataFrame:
        """Scored rows of some places."""
        names = {w: f"_f{i}" for i, w in enumerate(weight)}
        held = within.groupBy("seg", *KEYS).agg(F.first("dl").alias("_dl"), *(F.sum(F.when(F.col("token") == w, F.col("f")).otherwise(0)).alias(n) for w, n in names.items()))
        held = self._alive(held.select("seg", *KEYS, "_dl", *names.values()))
        total = sum((weight[w] * _impact(F.col(n), F.col("_dl"), self.average) for w, n in list(names.items())[1:]), weight[next(iter(names))] * _impact(F.col(next(iter(names.values()))), F.col("_dl"), self.average))
        return held.select(*KEYS, F.round(total, 9).alias("score"))

    def best(self, words: list[str], limit: int) -> DataFrame:
        """path, chunk_no, score of the limit best rows that hold a word, as a scan of all rows would give them; equal scores by path and number."""
        none = self.spark.createDataFrame([], "path string, chunk_no int, score double")
        times = Counter(words)
        holding = self._holding(sorted(times)) if times and self.segments else {}
        if not holding:
            self.read = (0, 0)
            return none
        idf = {w: F.greatest(F.log(F.lit((self.rows - n + 0.5) / (n + 0.5))), F.lit(bm25.LEAST_IDF)) for w, n in holding.items()}
        weight = {w: F.lit(float(times[w])) * idf[w] for w in holding}
        known = list(holding)
        mine = self.blocks().where(F.col("token").isin(known))
        add = F.lit(0.0)
        for w in known:
            add = F.when(F.col("token") == w, weight[w]).otherwise(add)
        best = F.array_max(F.transform("points", lambda x: _impact(x["f"], x["dl"], self.average)))
        bounds = mine.groupBy("seg", "block").agg(F.sum(add * best).alias("bound"))
        places = self.held().where(F.col("token").isin(known))
        order = (F.desc("score"), *KEYS)

        def named(pairs) -> Column:
            by: dict[int, list[int]] = {}
            for s, b in pairs:
                by.setdefault(s, []).append(b)
            out = F.lit(False)
            for s, own in by.items():
                out = out | (F.col("seg") == s) & F.col("block").isin(own)
            return out

        first = bounds.orderBy(F.desc("bound")).limit(FIRST).collect()  # FIRST blocks
        seen = self._scores(weight, places.where(named((r["seg"], r["block"]) for r in first))).orderBy(*order).limit(limit)
        got = seen.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        need = got["least"] - 1e-8 if got["n"] == limit else -1.0
        left = bounds.where(F.col("bound") >= need)
        listed = left.select("seg", "block").limit(LISTED + 1).collect()
        total = bounds.count()
        if len(listed) <= LISTED:
            self.read = (len(listed), total)
            within = places.where(named((r["seg"], r["block"]) for r in listed))
        else:
            self.read = (left.count(), total)
            within = places.join(left.select("seg", "block"), ["seg", "block"], "left_semi")
        return self._scores(weight, within).orderBy(*order).limit(limit)


class Hits(bm25.Stored):
    """Hits of several channels from segments; the channel of single words is searched by blocks."""

    def __init__(self, index: Segments, channels: dict[str, list[list[str] | str]], by_blocks: str, limit: int):
        words = channels[by_blocks]
        self.best = index.best([w for (w,) in words], limit) if all(len(w) == 1 for w in words) else None
        super().__init__(index.live(), KEYS, {c: own for c, own in channels.items() if c != by_blocks or self.best is None})
        self.by_blocks = by_blocks

    def score(self, channel: str, every: bool = False) -> DataFrame:
        return self.best if channel == self.by_blocks and self.best is not None else super().score(channel, every)
