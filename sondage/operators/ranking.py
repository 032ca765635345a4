"""Fusion of channels, boosts, caps, penalties, recency and reranking. Scores are few rows: (path, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions import lists
from sondage.functions.text import basename, extension, fold, percent_decode, rfc3339, stem, word_similarity, words

EXACT, PREFIX, SUBSTRING, EACH_MORE = 0.30, 0.10, 0.04, 0.60
FUZZY, LEAST_SIMILARITY = 0.15, 0.55
BINARY_FACTOR, SYSTEM_FACTOR, CODE_FACTOR = 0.1, 0.05, 0.12
DAY_NS = 86_400 * 1_000_000_000


def merge(channels: list[tuple[DataFrame, float]]) -> DataFrame:
    """Sum of the channels' contributions by path, each times its weight."""
    rows = [c.select("path", (F.col("rrf") * w).alias("rrf")) for c, w in channels]
    return reduce(DataFrame.union, rows).groupBy("path").agg(F.round(F.sum("rrf"), 9).alias("score"))


def _query_words(query: str) -> list[str]:
    import re

    return [w for w in re.split(r"[-_. /]+", query.lower()) if w]


def _tier(asked: str):
    """What a word of a name is worth for a query word; null if it doesn't fit."""
    q = F.lit(asked)

    def worth(n: Column) -> Column:
        near = n.startswith(q) | F.startswith(q, n)
        return F.when(n == q, EXACT).when(near, PREFIX).when(F.contains(n, q) | F.contains(q, n), SUBSTRING)

    return worth


def _closest(names: Column, asked: str) -> Column:
    return F.coalesce(F.array_max(F.transform(names, lambda n: word_similarity(fold(F.lit(asked)), fold(n)))), F.lit(0.0))


def _found(names: Column, asked: str) -> Column:
    """Whether a word of a name is the query word or, for four bytes or more, nearly so."""
    close = lambda n: word_similarity(fold(F.lit(asked)), fold(n)) >= 0.8 if len(asked.encode()) >= 4 else F.lit(False)
    return F.exists(names, lambda n: (n == asked) | close(n))


def filename_boost(path: Column, query: str) -> Column:
    """Each query word of two bytes or more takes the first word of the name that fits in any way."""
    name = words(stem(percent_decode(basename(path))))

    def boost(names: Column) -> Column:
        total, matched = F.lit(0.0), F.lit(0)
        for q in (w for w in _query_words(query) if len(w.encode()) >= 2):
            kind = _tier(q)
            first = F.get(F.filter(names, lambda n: kind(n).isNotNull()), F.lit(0))
            total = total + F.coalesce(kind(first), F.lit(0.0))
            matched = matched + F.when(first.isNull(), 0).otherwise(1)
        return total + F.when(matched >= 2, EACH_MORE * (matched - 1)).otherwise(0.0)

    return F.element_at(F.transform(F.array(name), boost), 1)


def fuzzy_boost(path: Column, query: str) -> Column:
    """Closeness of the query's words to the name's, shared among all query words."""
    base = basename(path)
    asked = _query_words(query)
    used = [w for w in asked if len(w.encode()) >= 3]
    if not used:
        return F.lit(0.0)

    def boost(names: Column) -> Column:
        best = [_closest(names, w) for w in used]
        mean = reduce(lambda a, b: a + b, best) / len(asked)
        cover = F.least(F.lit(1.0), F.lit(float(sum(len(w.encode()) for w in used))) / F.octet_length(base))
        return F.when(mean < LEAST_SIMILARITY, 0.0).otherwise(FUZZY * mean * cover)

    names = F.filter(words(base), lambda n: F.octet_length(n) >= 3)
    return F.element_at(F.transform(F.array(names), boost), 1)


def _asked(query: Column, least: int) -> Column:
    """Words of a query of so many bytes or more."""
    return F.filter(F.split(F.lower(query), r"[-_. /]+"), lambda w: F.octet_length(w) >= least)


def filename_boost_of(path: Column, query: Column) -> Column:
    """filename_boost() for a column of queries."""
    name = words(stem(percent_decode(basename(path))))

    def worth(n: Column, q: Column) -> Column:
        near = n.startswith(q) | F.startswith(q, n)
        return F.when(n == q, EXACT).when(near, PREFIX).when(F.contains(n, q) | F.contains(q, n), SUBSTRING)

    def boost(names: Column) -> Column:
        kinds = F.filter(F.transform(_asked(query, 2), lambda q: worth(F.get(F.filter(names, lambda n: worth(n, q).isNotNull()), F.lit(0)), q)), lambda x: x.isNotNull())
        more = lambda ks: F.aggregate(ks, F.lit(0.0), lambda a, x: a + x) + F.when(F.size(ks) >= 2, EACH_MORE * (F.size(ks) - 1)).otherwise(0.0)
        return F.element_at(F.transform(F.array(kinds), more), 1)

    return F.element_at(F.transform(F.array(name), boost), 1)


def fuzzy_boost_of(path: Column, query: Column) -> Column:
    """fuzzy_boost() for a column of queries."""
    base = basename(path)
    used = F.transform(_asked(query, 3), fold)
    size = F.aggregate(_asked(query, 3), F.lit(0), lambda a, w: a + F.octet_length(w)).cast("double")
    closest = lambda names, w: F.coalesce(F.array_max(F.transform(names, lambda n: word_similarity(w, n))), F.lit(0.0))

    def boost(names: Column) -> Column:
        mean = F.aggregate(F.transform(used, lambda w: closest(names, w)), F.lit(0.0), lambda a, x: a + x) / F.size(_asked(query, 1))
        cover = F.least(F.lit(1.0), size / F.octet_length(base))
        return F.element_at(F.transform(F.array(mean), lambda m: F.when(m < LEAST_SIMILARITY, 0.0).otherwise(FUZZY * m * cover)), 1)

    names = F.transform(F.filter(words(base), lambda n: F.octet_length(n) >= 3), fold)
    return F.when(F.size(used) > 0, F.element_at(F.transform(F.array(names), boost), 1)).otherwise(0.0)


def boosted(scores: DataFrame, query: str, weight: float = 1.0) -> DataFrame:
    """scores with the name's boosts added, times the weight, and kept in delta."""
    delta = filename_boost(F.col("path"), query) + fuzzy_boost(F.col("path"), query)
    return scores.withColumn("delta", F.round(delta * weight, 9)).withColumn("score", F.round(F.col("score") + F.col("delta"), 9))


def capped(scores: DataFrame, content: DataFrame, cap: float = 0.12, least_delta: float = 0.10) -> DataFrame:
    """Paths that no content channel found and whose name says little are held to the cap. content is few rows."""
    mark = F.broadcast(content.select("path").distinct().withColumn("_content", F.lit(True)))
    held = F.col("_content").isNull() & (F.col("score") > cap) & (F.col("delta") < least_delta)
    return scores.join(mark, "path", "left").withColumn("score", F.when(held, F.lit(cap)).otherwise(F.col("score"))).drop("_content")


def noise_factor(path: Column) -> Column:
    low = F.lower(path)
    system = reduce(lambda a, p: a | low.startswith(p), lists.SYSTEM_PREFIXES, F.lit(False))
    return F.when(extension(path).isin(lists.BINARY), BINARY_FACTOR).when(system, SYSTEM_FACTOR).otherwise(1.0)


def recency(mtime_ns: Column, now_ns: int, days: float = 30.0) -> Column:
    """exp(-age / days); future times count as now, missing ones as 0."""
    age = F.greatest((F.lit(now_ns) - mtime_ns) / F.lit(float(DAY_NS)), F.lit(0.0))
    return F.when(mtime_ns.isNull(), 0.0).otherwise(F.exp(-age / days))


def near_query(path: Column, query: str) -> Column:
    """Whether a file's name is, holds, or nearly is the query."""
    q = query.lower().strip()
    if "." in q and q[q.rindex(".") :] in lists.CODE:
        q = q[: q.rindex(".")]
    name = stem(basename(path))
    asked = _query_words(q)
    if not q or not asked:
        return F.lit(False)
    whole = (name == q) | (F.contains(name, F.lit(q)) if len(q.encode()) >= 4 else F.lit(False))

    def share(names: Column) -> Column:
        hits = [_found(names, w) for w in asked]
        return reduce(lambda a, b: a + b, (h.cast("int") for h in hits)) * 5 >= len(asked) * 4

    return (name != "") & (whole | F.element_at(F.transform(F.array(words(name)), share), 1))


def code_penalised(scores: DataFrame, query: str, matched: DataFrame) -> DataFrame:
    """Source files lose most of their score unless their content matched or their name is near the query."""
    mark = F.broadcast(matched.select("path").distinct().withColumn("_matched", F.lit(True)))
    code = extension(F.col("path")).isin(lists.CODE) & ~near_query(F.col("path"), query)
    rows = scores.join(mark, "path", "left")
    return rows.withColumn("score", F.round(F.when(code & F.col("_matched").isNull(), F.col("score") * CODE_FACTOR).otherwise(F.col("score")), 9)).drop("_matched")


def attached(scores: DataFrame, files: DataFrame) -> DataFrame:
    """scores with size, mtime and modified; files that are unknown have size 0 and an empty time."""
    meta = files.select("path", "size", "mtime").join(F.broadcast(scores.select("path")), "path", "left_semi")
    rows = scores.join(meta, "path", "left")
    return rows.withColumn("size", F.coalesce("size", F.lit(0))).withColumn("modified", F.coalesce(rfc3339(F.col("mtime")), F.lit("")))


def reranked(scores: DataFrame, logits: DataFrame, top: int = 8, blend: float = 0.5) -> DataFrame:
    """Blend of the top rows' scores, relative to the best, with the sigmoid of their best logit. scores are few rows."""
    b = min(1.0, max(0.0, blend))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "path"))
    p = logits.groupBy("path").agg(F.max(1 / (1 + F.exp(-F.col("logit")))).alias("_p"))
    rows = scores.withColumn("_rank", rank).join(F.broadcast(p), "path", "left")
    best = F.max("score").over(Window.partitionBy(F.lit(1)))
    new = F.when((F.col("_rank") <= top) & F.col("_p").isNotNull(), b * F.col("_p") + (1 - b) * F.col("score") / best).otherwise(F.col("score"))
    return rows.withColumn("score", F.round(new, 9)).drop("_rank", "_p")


def interleaved(ranked: DataFrame, rescored: DataFrame, top: int = 8) -> DataFrame:
    """Among the top slots images keep theirs; the others fill the rest by their new scores. ranked: path, score; few rows."""
    slot = F.row_number().over(Window.orderBy(F.desc("score"), "path"))
    image = extension(F.col("path")).isin(lists.IMAGE_SOURCE)
    slots = ranked.withColumn("slot", slot).where(F.col("slot") <= top).withColumn("image", image)
    order = F.row_number().over(Window.orderBy("slot"))
    free = slots.where("not image").select(order.alias("_n"), "slot")
    moved = slots.where("not image").select("path").join(rescored.select("path", F.col("score").alias("_s")), "path")
    moved = moved.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("_s"), "path"))).join(free, "_n").select("path", "slot")
    return moved.union(slots.where("image").select("path", "slot"))
