"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed into a fixed number of buckets. Two smoothed
multinomials over the buckets, one of the trusted documents and one of all
documents, give each bucket a log ratio; a document's score is the sum over its
n-grams divided by their number, and the document is kept if the score is not below
the threshold and no base rule fails. Everything runs on built-in functions.

The raw counts cover every row, and the trusted counts every row whose id is labelled good. The threshold is drawn from every labelled document of
LEAST_WORDS or more: labelled ids are dealt by hash in FOLDS folds, and each is scored by the counts without the good of its own fold. The threshold is
the middle of the range in which the share of the good that is rejected, KEEP times, and the share
of the bad that is kept have the least sum. Where a fold has no good document, or no bad one is labelled, nothing can be drawn, and it is THRESHOLD.
Labelled ids are broadcast up to FEW of them, and joined by shuffle beyond.

Null or empty texts have no words: they fail the base rules and score null.
Repeated rows are scored alike, and a label of an id holds for all its rows; ids
labelled both ways count as bad. Very long texts are judged whole. An empty
table gives an empty one. A result column whose name the table has already is
given an underscore more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, words_of

#: Buckets of the multinomials, pseudo-count of a bucket, labelled ids that are broadcast, threshold of the score where none can be drawn.
BUCKETS, SMOOTHING, FEW, THRESHOLD = 4096, 1.0, 2_000_000, -0.05
#: Folds of the labelled ids, weight of rejecting a good document, steps of a score of one.
FOLDS, KEEP, STEPS = 4, 4, 1000
#: Words that a document must have by the base rules.
LEAST_WORDS = 20
#: Characters that count as symbols; words of a window (a power of two).
SYMBOLS, WINDOW = "#*$%&|<>", 8


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """The counts of the base rules; words must be a column of its own, so that it is computed once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def joined(hashes: Column, by: int) -> Column:
    """Hashes of twice the reach: each is joined with that of the words by places later."""
    return F.zip_with(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - by, F.lit(0))), F.slice(hashes, by + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b)
    )


def repeated_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words covered by windows whose hash is found twice or more.

    Hashes are sorted with their starts; equal neighbours mark starts, and the
    sorted starts give the covered length. Texts without an equal pair skip this.
    """

    def neighbours(s: Column) -> Column:
        two = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(two, lambda x: x.isNotNull()))))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    covered = F.aggregate(
        _let(ordered, neighbours),
        F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum")),
        lambda a, s: F.struct(s.alias("last"), (a["sum"] + F.least(F.lit(n), s - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("long")


def _hashed(docs: DataFrame, text: str, *keep: Column | str) -> DataFrame:
    """keep, the words, and 64-bit hashes of words (_h1) and word pairs (_h2)."""
    words = docs.select(*keep, words_of(F.col(text)).alias("_words"))
    return words.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_h2", joined(F.col("_h1"), 1))


def labelled(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, good) of each labelled id: good is quality 1 and not toxic, bad is quality 0."""
    by = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return by.where((F.col("quality") == 0) | ((F.col("quality") == 1) & (F.col("toxic") == 0))).select(key, (F.col("quality") == 1).alias("good"))


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every id labelled good."""
    return labelled(labels, key).where("good").select(key)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= FEW else ids


def drawn(scores: list[tuple[int, bool, int]]) -> float | None:
    """The threshold for (score in steps, good, how many); None without good or bad ones."""
    total = {kind: sum(n for _, good, n in scores if good == kind) for kind in (True, False)}
    if not all(total.values()):
        return None
    change: dict[int, float] = {}
    for step, good, n in scores:
        change[step] = change.get(step, 0) + (KEEP * n / total[True] if good else -n / total[False])
    cuts, costs, cost = sorted(change), [], 1.0
    for step in cuts:  # what a threshold costs that is above all lower steps and not above this one
        costs.append(cost)
        cost += change[step]
    cuts.append(cuts[-1] + 1)
    costs.append(cost)
    best = min(range(len(costs)), key=lambda i: round(costs[i], 9))
    return (cuts[best] + (cuts[best - 1] + 1 if best else cuts[0])) / 2 / STEPS


def fits(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", n: int = BUCKETS) -> list[list[float]]:
    """Log ratio of each bucket: of all trusted documents, then without those of each fold. trusted: key, _fold."""
    mark = trusted.select(F.col(key).alias("_key"), F.col("_fold").alias("f"))
    grams = (
        _hashed(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(_small(mark), "_key", "left"), "_text", "f")
        .select("f", F.explode(F.concat("_h1", "_h2")).alias("h"))
        .select("f", F.pmod("h", F.lit(n)).cast("int").alias("b"))
    )
    raw, good = [0] * n, [[0] * n for _ in range(FOLDS)]
    for r in grams.groupBy("b").agg(F.count("*").alias("n"), *(F.count_if(F.col("f") == k).alias(f"t{k}") for k in range(FOLDS))).collect():  # n rows at most
        raw[r["b"]] = r["n"]
        for k in range(FOLDS):
            good[k][r["b"]] = r[f"t{k}"]
    every = [sum(g) for g in zip(*good, strict=True)]

    def ratios(counts: list[int]) -> list[float]:
        all_raw, all_good = sum(raw) + SMOOTHING * n, sum(counts) + SMOOTHING * n
        return [math.log((g + SMOOTHING) / all_good) - math.log((r + SMOOTHING) / all_raw) for g, r in zip(counts, raw, strict=True)]

    return [ratios(every), *(ratios([a - b for a, b in zip(every, g, strict=True)]) for g in good)]


def fit(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", n: int = BUCKETS) -> list[float]:
    """Log ratio of each bucket. trusted: one column key."""
    return fits(docs, trusted.withColumn("_fold", F.lit(0)), text, key, n)[0]


def _total(hashes: Column, ratios: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    return F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(table, F.pmod(h, F.lit(len(ratios))).cast("int")))


def log_ratio(words: Column, ratios: list[float], least: int = 0) -> Column:
    """The score of words (null where there are fewer than least, or none); bound within one expression, so that each part is computed once."""
    mean = lambda h1, h2: F.when(F.size(h1) >= least, (_total(h1, ratios) + _total(h2, ratios)) / F.nullif(F.size(h1) + F.size(h2), F.lit(0)))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h1: _let(joined(h1, 1), lambda h2: mean(h1, h2)))


def score(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, the base counts, base_failed, llr (null without words) and kept."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    rest = [f"`{c}`" for c in docs.columns]
    verdict_, *names = unused(docs.columns, "verdict", *own)
    def figures(words: Column, h1: Column, h2: Column, h8: Column) -> Column:
        counts = {k: c.alias(k) for k, c in base_counts(F.col(text), words).items()}
        llr = (_total(h1, ratios) + _total(h2, ratios)) / F.nullif(F.size(h1) + F.size(h2), F.lit(0))
        return F.struct(*counts.values(), repeated_words(h8).alias("n_repeat_words"), llr.alias("llr"))

    def verdict(f: Column) -> Column:
        failed = (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > 30 * f["n_words"])
        kept = ~failed & F.coalesce(f["llr"] >= threshold, F.lit(False))
        return F.struct(*(f[c].alias(c) for c in own if c not in ("base_failed", "kept")), failed.alias("base_failed"), kept.alias("kept"))

    # Words and hashes are bound within one expression: a filter on a verdict that is pushed below the
    # projection then evaluates it once more, where chained columns would be computed again for every word.
    def judged(words: Column) -> Column:
        h1 = F.transform(words, lambda w: F.xxhash64(w))
        by_pair = lambda h: _let(joined(h, 1), lambda h2: _let(joined(joined(h2, 2), 4), lambda h8: figures(words, h, h2, h8)))
        return _let(_let(h1, by_pair), verdict)

    made = docs.select(*rest, _let(words_of(F.col(text)), judged).alias(verdict_))
    return made.select(*rest, *(F.col(verdict_).getField(c).alias(name) for c, name in zip(own, names, strict=True)))


def model(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[list[float], float]:
    """(log ratio of each bucket, threshold)."""
    known = labelled(labels, key).withColumn("_fold", F.pmod(F.xxhash64(F.lit("held"), key), F.lit(FOLDS)).cast("int"))
    whole, *without = fits(docs, known.where("good"), text, key)
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(_small(known.withColumnRenamed(key, "id")), "id")
    score_of = F.lit(None).cast("double")
    for k, ratios in enumerate(without):
        score_of = F.when(F.col("_fold") == k, log_ratio(words_of(F.col("text")), ratios, LEAST_WORDS)).otherwise(score_of)
    seen = own.groupBy("good", "_fold", F.floor(score_of * STEPS).cast("int").alias("step")).count()
    scores = [r for r in seen.collect() if r["step"] is not None]  # scores lie within the range of the log ratios, some ten thousand steps
    if len({r["_fold"] for r in scores if r["good"]}) < FOLDS:
        return whole, THRESHOLD
    threshold = drawn([(r["step"], r["good"], r["count"]) for r in scores])
    return whole, THRESHOLD if threshold is None else threshold


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """model() of docs and labels, then score()."""
    ratios, threshold = model(docs, labels, text, key)
    return score(docs, ratios, text, threshold)
