"""The composite search: channels, fusion, boosts, cap, penalties, recency, reranking, filters, order."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.functions.lists import WEIGHTS
from sondage.operators import bm25, channels, filters, ranking, segments, vectors
from sondage.operators.parser import parse
from sondage.operators.path_index import PathIndex


def channel_list(files: DataFrame | PathIndex, chunks: DataFrame | bm25.Index | segments.Segments, vecs: DataFrame | None, text: str, vector: list[float] | None, w: dict[str, float]) -> tuple[list[tuple[DataFrame, float]], list[DataFrame], DataFrame]:
    """(weighted channels, content channels, paths whose content matched)."""
    paths, chunks = channels.prepared_paths(files, text), channels.prepared_chunks(chunks, text)
    path_any = channels.path_any(paths, text, w["w_path_fts"])
    path_all = channels.path_all(paths, text, w["w_path_fts"] * 4 / 3)
    prefix = channels.path_prefix(paths, text, w["w_path_prefix"])
    short = channels.path_short_prefix(paths, text, w["w_path_prefix"] * 2 / 3)
    before = channels.match_set(path_any, path_all, prefix, short)
    by_path = [path_any, path_all, prefix, short, channels.path_substring(files, text, before, w["w_path_prefix"] * 0.5)]
    phrase, keyword = channels.content_phrase(chunks, text), channels.content_keyword(chunks, text)
    fuzzy = channels.content_fuzzy(chunks, text, channels.match_set(phrase, keyword))
    content = [(c, w["w_content_fts"]) for c in (phrase, keyword, fuzzy)]
    near = []
    if vecs is not None and vector:
        for collection, weight in (("text", w["w_semantic_text"]), ("image", w["w_semantic_image"])):
            near.append((vectors.knn_channel(vecs, vector, collection, weight, w["rrf_k"]), 1.0))
    matched = channels.match_set(channels.phrase_chunks(chunks, text), fuzzy)
    return [*((c, 1.0) for c in by_path), *content, *near], [c for c, _ in [*content, *near]], matched


def search(files: DataFrame, chunks: DataFrame | bm25.Index | segments.Segments, raw: str, now_ns: int, vecs: DataFrame | None = None, vector: list[float] | None = None, weights: dict[str, float] | None = None, logits: DataFrame | None = None, prefilter: bool = False, paths: PathIndex | None = None) -> DataFrame:
    """path, score, size, modified, mtime, ctime in the order asked for.

    Filters come after ranking, so that a narrow one may leave few rows; with prefilter they come first, which
    changes the figures of the corpus and so needs the chunks themselves. Otherwise an index of them will do, and
    one of the paths of files.
    """
    w = WEIGHTS | (weights or {})
    q = parse(raw, datetime.fromtimestamp(now_ns / 1e9, timezone.utc))
    files = files.select("path", "size", "mtime", "ctime", "atime")
    keep = filters.matching(q, *(F.col(c) for c in ("path", "size", "mtime", "ctime", "atime")))
    if prefilter:
        if paths is not None or isinstance(chunks, bm25.Index | segments.Segments):
            raise ValueError("prefilter needs the chunks and files, not their indexes")
        files = files.where(keep)
        chunks = chunks.join(files.select("path"), "path", "left_semi")
    weighted, content, matched = channel_list(files if paths is None else paths, chunks, vecs, q.text, vector, w)
    scores = ranking.boosted(ranking.merge(weighted), q.text, w["w_filename"])
    scores = ranking.capped(scores, channels.match_set(*content), w["path_only_cap"])
    scores = scores.select("path", (F.col("score") * ranking.noise_factor(F.col("path"))).alias("score"))
    meta = files.join(F.broadcast(scores.select("path")), "path", "left_semi")
    rows = scores.join(meta, "path", "left")
    if w["use_new_pipeline"]:
        rows = rows.withColumn("score", F.round(F.col("score") + w["w_recency"] * ranking.recency(F.col("mtime"), now_ns, w["recency_half_life"]), 9))
    if logits is not None:
        rows = ranking.reranked(rows, logits, int(w["rerank_top_n"]), w["w_reranker_blend"])
    rows = ranking.code_penalised(rows, q.text, matched).where(keep)
    rows = rows.withColumn("modified", F.coalesce(ranking.rfc3339(F.col("mtime")), F.lit(""))).withColumn("size", F.coalesce("size", F.lit(0)))
    return filters.ordered(rows.select("path", "score", "size", "modified", "mtime", "ctime"), q.sort)


def text_search(files: DataFrame, chunks: DataFrame, text: str, vecs: DataFrame | None = None, vector: list[float] | None = None) -> DataFrame:
    """Three channels and the name's boosts, without substrings, cap, penalties or recency."""
    paths = bm25.Prepared(files, "path", ["path"], {"any": channels._counts(text)})
    content = bm25.Prepared(chunks, "content", ["path", "chunk_no"], {"keyword": channels._counts(text)})
    found = [(channels.path_any(paths, text), 1.0), (channels.content_keyword(content, text), 1.0)]
    if vecs is not None and vector:
        found.append((vectors.knn_channel(vecs, vector, "text", 1.0), 1.0))
    return ranking.boosted(ranking.merge(found), text).select("path", "score").orderBy(F.desc("score"), "path")
