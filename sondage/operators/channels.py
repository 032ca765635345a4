"""Retrieval channels: each gives (path, rrf), a path's contribution by its rank in the channel.

Ranks are by score, then path; every channel takes its limit before ranking, so
that ranking sees a bounded number of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import ACCENTED, PLAIN

from . import bm25, segments
from .path_index import PathIndex

K = 60.0
PATH_LIMIT, SUBSTRING_LIMIT, KEYWORD_LIMIT, PHRASE_LIMIT, FUZZY_LIMIT, TEXT_LIMIT, IMAGE_LIMIT, BEST = 20, 30, 400, 500, 50, 200, 50, 3


def query_tokens(text: str) -> list[str]:
    """The query's words as the tokens of an index."""
    return [t for t in re.split(r"[\W_]+", text.lower().translate(str.maketrans(ACCENTED, PLAIN))) if t]


def phrases(text: str) -> list[list[str]]:
    """One phrase for each blank-separated word."""
    return [p for p in (query_tokens(w) for w in text.split()) if p]


def _counts(text: str) -> list:
    return [c for p in phrases(text) for c in bm25.phrase_count(p)]


def top(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    return rows.orderBy(F.desc("score"), *(order or ("path",))).limit(limit)


def rrf(rows: DataFrame, boost: float, k: float = K, by: Column | None = None) -> DataFrame:
    """(path, rrf) of ranked rows; rows must be few."""
    rank = F.row_number().over(Window.orderBy(F.desc("score") if by is None else by, "path"))
    return rows.select("path", (boost / (k + rank)).alias("rrf"))


def _all_counts(text: str) -> list:
    return _counts(text) if len(text.split()) > 1 else []


def _prefixes(text: str) -> list[str]:
    return [t for w in text.split() if len(w.encode()) >= 2 for t in query_tokens(w)]


def _short_prefixes(text: str) -> list[str]:
    return [w.lower()[:4] for w in text.split() if len(w.encode()) >= 4]


def _prefix_counts(text: str) -> list:
    return bm25.prefix_counts(_prefixes(text))


def _short_counts(text: str) -> list:
    return bm25.prefix_counts(_short_prefixes(text))


def _phrase_counts(text: str) -> list:
    return bm25.phrase_count(query_tokens(text)) if query_tokens(text) else []


def _fuzzy_counts(text: str) -> list:
    return bm25.prefix_counts(_fuzzy_prefixes(text))


def prepared_paths(paths: DataFrame | PathIndex, text: str) -> bm25.Prepared:
    """What the path channels count, in one reading or from an index; they take it in place of the paths."""
    if isinstance(paths, PathIndex):
        every = phrases(text) if len(text.split()) > 1 else []
        return bm25.Stored(paths.words, ["path"], {"any": phrases(text), "all": every, "prefix": _prefixes(text), "short": _short_prefixes(text)})
    return bm25.Prepared(paths, "path", ["path"], {"any": _counts(text), "all": _all_counts(text), "prefix": _prefix_counts(text), "short": _short_counts(text)})


def prepared_chunks(chunks: DataFrame | bm25.Index | segments.Segments, text: str) -> bm25.Prepared:
    """What the content channels count, in one reading or from an index; they take it in place of the chunks."""
    if isinstance(chunks, bm25.Index | segments.Segments):
        whole = query_tokens(text)
        sought = {"keyword": phrases(text), "phrase": [whole] if whole else [], "fuzzy": _fuzzy_prefixes(text)}
        if isinstance(chunks, segments.Segments):
            return segments.Hits(chunks, sought, "keyword", KEYWORD_LIMIT)
        return bm25.Stored(chunks, ["path", "chunk_no"], sought)
    return bm25.Prepared(chunks, "content", ["path", "chunk_no"], {"keyword": _counts(text), "phrase": _phrase_counts(text), "fuzzy": _fuzzy_counts(text)})


def _score(rows: DataFrame | bm25.Prepared, channel: str, column: str, counts: list, every: bool = False) -> DataFrame:
    if isinstance(rows, bm25.Prepared):
        return rows.score(channel, every)
    return bm25.score(rows.select("path") if column == "path" else rows.select("path", "chunk_no", column), column, counts, every)


def path_any(paths: DataFrame | bm25.Prepared, text: str, boost: float = 3.0) -> DataFrame:
    return rrf(top(_score(paths, "any", "path", _counts(text)), PATH_LIMIT), boost)


def path_all(paths: DataFrame | bm25.Prepared, text: str, boost: float = 4.0) -> DataFrame:
    return rrf(top(_score(paths, "all", "path", _all_counts(text), every=True), PATH_LIMIT), boost)


def path_prefix(paths: DataFrame | bm25.Prepared, text: str, boost: float = 1.5) -> DataFrame:
    return rrf(top(_score(paths, "prefix", "path", _prefix_counts(text)), PATH_LIMIT), boost)


def path_short_prefix(paths: DataFrame | bm25.Prepared, text: str, boost: float = 1.0) -> DataFrame:
    return rrf(top(_score(paths, "short", "path", _short_counts(text), every=True), PATH_LIMIT), boost)


def substring_match(paths: DataFrame | PathIndex, text: str, limit: int = SUBSTRING_LIMIT) -> DataFrame:
    """Paths that contain a word of two bytes or more, in path order."""
    words = [w.lower() for w in text.split() if len(w.encode()) >= 2]
    if isinstance(paths, PathIndex):
        return paths.holding(words).orderBy("path").limit(limit)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("path"), F.lit(w))
    return paths.where(hit).select("path").distinct().orderBy("path").limit(limit)


def path_substring(paths: DataFrame | PathIndex, text: str, before: DataFrame, boost: float = 0.75, gate: int = PATH_LIMIT) -> DataFrame:
    """Substring hits, if the channels before found fewer than gate paths."""
    found = before.select("path").distinct().agg(F.count("*").alias("_found"))
    hits = substring_match(paths, text).crossJoin(F.broadcast(found)).where(F.col("_found") < gate)
    return rrf(hits.withColumn("score", F.lit(0.0)), boost)


def best_average(chunks: DataFrame, best: int = BEST) -> DataFrame:
    """(path, score): the mean of a path's best chunks."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "chunk_no"))
    return chunks.withColumn("_r", rank).where(F.col("_r") <= best).groupBy("path").agg(F.round(F.avg("score"), 9).alias("score"))


def _chunk_channel(scored: DataFrame, limit: int, boost: float) -> DataFrame:
    return rrf(best_average(top(scored, limit, "path", "chunk_no")), boost)


def content_keyword(chunks: DataFrame | bm25.Prepared, text: str, boost: float = 10.0) -> DataFrame:
    return _chunk_channel(_score(chunks, "keyword", "content", _counts(text)), KEYWORD_LIMIT, boost)


def phrase_chunks(chunks: DataFrame | bm25.Prepared, text: str) -> DataFrame:
    return top(_score(chunks, "phrase", "content", _phrase_counts(text)), PHRASE_LIMIT, "path", "chunk_no")


def content_phrase(chunks: DataFrame | bm25.Prepared, text: str, boost: float = 50.0) -> DataFrame:
    """Paths with the whole text as a phrase; a single word earns no score here."""
    found = phrase_chunks(chunks, text)
    return rrf(best_average(found if len(text.split()) > 1 else found.limit(0)), boost)


def _fuzzy_prefixes(text: str) -> list[str]:
    return [w.lower()[: 3 if len(w) == 3 else 4] for w in text.split() if len(w.encode()) >= 3]


def fuzzy_chunks(chunks: DataFrame | bm25.Prepared, text: str) -> DataFrame:
    return top(_score(chunks, "fuzzy", "content", _fuzzy_counts(text), every=True), FUZZY_LIMIT, "path", "chunk_no")


def content_fuzzy(chunks: DataFrame | bm25.Prepared, text: str, before: DataFrame, boost: float = 0.8, gate: int = 5) -> DataFrame:
    """Prefix hits in content, if the channels before found fewer than gate paths and the query has three bytes."""
    if len(text.encode()) < 3:
        return before.limit(0).select("path", F.lit(0.0).alias("rrf"))
    found = before.select("path").distinct().agg(F.count("*").alias("_found"))
    hits = fuzzy_chunks(chunks, text).crossJoin(F.broadcast(found)).where(F.col("_found") < gate).drop("_found")
    return rrf(best_average(hits), boost)


def match_set(*found: DataFrame) -> DataFrame:
    """Distinct paths of several channels."""
    out = found[0].select("path")
    for f in found[1:]:
        out = out.union(f.select("path"))
    return out.distinct()


def best_chunks(chunks: DataFrame, text: str, paths: DataFrame, per_path: int = 1) -> DataFrame:
    """The chunks of each path that match best, for reranking. paths are few."""
    mine = bm25.score(chunks.select("path", "chunk_no", "content"), "content", _counts(text)).join(F.broadcast(paths.select("path").distinct()), "path", "left_semi")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "chunk_no"))
    return mine.where("content <> ''").withColumn("rank", rank).where(F.col("rank") <= per_path)
