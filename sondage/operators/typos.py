"""Words that are alike but for typos, found by join keys in place of an edit distance for each pair.

Words of lengths m and n with a similarity (1 - distance / the longer length) of s or more differ by at most k = (1 - s) * max(m, n) edits. Cut
one of them into k + 1 pieces: k edits leave one piece whole, and it stands in the other at most k places from where it was. So a known word is
filed under each of its pieces, for each k that it can meet, and an asked word looks up its substrings of the pieces' lengths near their
places. Pairs that meet are decided by their edit distance. Words are compared folded (lower case, without accents).

Spark's estimates of tables of words and names lie far below what they hold, so no join is left to them: what is asked is written, measured, and
broadcast up to BROADCAST bytes; beyond, both sides are shuffled. Known words and paths are never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import basename, fold, word_similarity, words
from sondage.sources.files import written

from .ranking import FUZZY, LEAST_SIMILARITY

#: Bytes (as JSON) of a table that is broadcast.
BROADCAST = 8 << 20


def _sent(df: DataFrame) -> DataFrame:
    """df, a written table, to be broadcast in a join if it is small; else both sides of the join are shuffled."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST else df.hint("merge")


def _edits(longest: Column, least: float) -> Column:
    """Edits that leave a similarity of least; the small addition is for products such as 0.45 * 20."""
    return F.floor((1 - least) * longest + F.lit(1e-9)).cast("int")


def _pieces(known: DataFrame, least: float) -> DataFrame:
    """known, n, k, i, piece: of each word, for each number of edits that it can meet."""
    n = F.length("known")
    rows = known.select("known", n.alias("n"), F.explode(F.sequence(_edits(n, least), _edits(F.floor(n / least + F.lit(1e-9)), least))).alias("k"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    at = lambda i: F.floor(i * F.col("n") / (F.col("k") + 1)).cast("int")
    return rows.select("known", "n", "k", "i", F.substr("known", at(F.col("i")) + 1, at(F.col("i") + 1) - at(F.col("i"))).alias("piece"))


def _lookups(asked: DataFrame, least: float) -> DataFrame:
    """asked, n, k, i, piece: what a word looks up, for each length of a known word."""
    m = F.col("m")
    rows = asked.select("asked", F.length("asked").alias("m"))
    rows = rows.select("*", F.explode(F.sequence(F.ceil(m * least - F.lit(1e-9)).cast("int"), F.floor(m / least + F.lit(1e-9)).cast("int"))).alias("n")).where("n > 0")
    rows = rows.withColumn("k", _edits(F.greatest("m", "n"), least)).where(F.abs(m - F.col("n")) <= F.col("k"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    edge = lambda i: F.floor(i * F.col("n") / (F.col("k") + 1)).cast("int")
    rows = rows.withColumn("at", edge(F.col("i"))).withColumn("size", edge(F.col("i") + 1) - F.col("at"))
    lo, hi = F.greatest(F.lit(0), F.col("at") - F.col("k")), F.least(m - F.col("size"), F.col("at") + F.col("k"))
    places = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    found = F.array_distinct(F.transform(places, lambda p: F.substr("asked", p + 1, F.col("size"))))
    return rows.select("asked", "n", "k", "i", F.explode(found).alias("piece"))


def close_words(asked: DataFrame, known: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(asked, known, similarity) of the pairs of distinct folded words with at least so much of it. Each table has one column word."""
    if not 0.5 < least <= 1:
        raise ValueError("the least similarity must lie above one half")
    one, other = (t.select(fold(F.col("word")).alias(name)).where(F.length(name) > 0).distinct() for t, name in ((asked, "asked"), (known, "known")))
    asks = _sent(written(_lookups(one, least), "lookups"))
    pairs = _pieces(other, least).join(asks, ["n", "k", "i", "piece"]).select("asked", "known").distinct()
    return pairs.withColumn("similarity", word_similarity(F.col("asked"), F.col("known"))).where(F.col("similarity") >= least)


def fuzzy_boosts(queries: DataFrame, paths: DataFrame) -> DataFrame:
    """(query, path, boost) where a name comes close enough to a query to be boosted, for tables of distinct queries and paths.

    A boost needs a mean similarity of LEAST_SIMILARITY, and so one word with as much; the names that have such a word are then scored in full, where the
    path is read, at the first of its words that is as close to one of the query's."""
    asked = F.filter(F.split(F.lower("query"), r"[-_. /]+"), lambda w: w != "")
    long = lambda ws: F.transform(F.filter(ws, lambda w: F.octet_length(w) >= 3), fold)
    sizes = F.aggregate(F.filter(asked, lambda w: F.octet_length(w) >= 3), F.lit(0), lambda a, w: a + F.octet_length(w))
    q = written(queries.select("query", long(asked).alias("_asked"), F.size(asked).alias("_n"), sizes.alias("_size")), "queries")
    base = basename(F.col("path"))
    p = paths.select("path", F.octet_length(base).alias("_base"), long(words(base)).alias("_names"))
    of_query = q.select("query", F.explode(F.array_distinct("_asked")).alias("asked"))
    of_path = p.select("*", F.explode(F.array_distinct("_names")).alias("known"))
    near = close_words(of_query.select(F.col("asked").alias("word")), of_path.select(F.col("known").alias("word")))
    wanted = near.join(_sent(of_query), "asked").select("query", "known").distinct().join(_sent(q), "query")
    pairs = of_path.join(_sent(written(wanted, "wanted")), "known")
    closest = lambda w: F.coalesce(F.array_max(F.transform("_names", lambda n: word_similarity(w, n))), F.lit(0.0))
    mean = F.aggregate("_asked", F.lit(0.0), lambda a, w: a + closest(w)) / F.col("_n")
    cover = F.least(F.lit(1.0), F.col("_size").cast("double") / F.col("_base"))
    close = F.filter("_names", lambda n: F.exists("_asked", lambda w: word_similarity(w, n) >= LEAST_SIMILARITY))
    scored = pairs.where(mean >= LEAST_SIMILARITY).where(F.col("known") == F.get(close, F.lit(0)))
    return scored.select("query", "path", (FUZZY * mean * cover).alias("boost"))
