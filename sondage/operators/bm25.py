"""BM25 over token arrays.

A query's phrases are few, so their frequencies are counted in each row's token
array; the corpus figures (rows, mean length, rows with each phrase) are one
aggregation with partial sums. Nothing is shuffled but one row. Each of the two
reads a row's text and makes its tokens once, however many phrases there are.
Prepared counts the phrases of several channels in the same two readings.
For many queries over one corpus postings() gives the exploded index. An Index
is written once, in runs that are in the order of their tokens; a search by Stored then reads the
pages that hold its words and prefixes instead of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.text import tokens

from .postings import GROUP_BYTES, by_token, runs

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def word_counts(words: list[str]):
    """Frequency of each word in a token array."""
    return [lambda t, w=w: F.size(F.filter(t, lambda x: x == w)) for w in words]


def prefix_counts(prefixes: list[str]):
    return [lambda t, p=p: F.size(F.filter(t, lambda x: x.startswith(p))) for p in prefixes]


def phrase_count(words: list[str]):
    """How often the words stand next to each other in this order."""
    if len(words) == 1:
        return word_counts(words)

    def count(t: Column) -> Column:
        n = len(words)
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(starts, lambda i: F.slice(t, i, n) == F.array(*map(F.lit, words))))

    return [count]


def _figures(text: Column, counts: list) -> Column:
    """An array of one: the length and the counts of a text, whose tokens are made once."""
    names = [f"_f{i}" for i in range(len(counts))]
    return F.transform(F.array(tokens(text)), lambda t: F.struct(F.size(t).alias("_dl"), *(c(t).alias(n) for c, n in zip(counts, names, strict=True))))


def _corpus(each: DataFrame, names: list[str]) -> DataFrame:
    return each.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *(F.sum((F.col(n) > 0).cast("long")).alias(f"{n}_n") for n in names))


def _counted(rows: DataFrame, text: str, counts: list) -> tuple[DataFrame, DataFrame]:
    """(rows with a phrase: columns of rows, _dl and _f0, _f1, ...; one row of corpus figures)."""
    names, figures = [f"_f{i}" for i in range(len(counts))], _figures(F.col(text), counts)
    # Rows without a phrase go as empty arrays: a filter would be pushed below and make the tokens anew for each of its terms.
    some = F.filter(figures, lambda c: F.greatest(F.lit(0), F.lit(0), *(c[n] for n in names)) > 0)
    found = rows.select(*rows.columns, F.explode(some).alias("_c")).select(*rows.columns, "_c.*")
    return found, _corpus(rows.select(F.explode(figures).alias("_c")).select("_c.*"), names)


def _scored(found: DataFrame, corpus: DataFrame, columns: list[str], names: list[str], every: bool) -> DataFrame:
    found = found.where(" and ".join(f"{n} > 0" for n in names) if every else " or ".join(f"{n} > 0" for n in names))
    joined = found.crossJoin(F.broadcast(corpus))  # one row

    def part(n: str) -> Column:
        idf = F.log((F.col("_n") - F.col(f"{n}_n") + 0.5) / (F.col(f"{n}_n") + 0.5))
        f = F.col(n).cast("double")
        return F.greatest(idf, F.lit(LEAST_IDF)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))

    total = sum((part(n) for n in names[1:]), part(names[0]))
    return joined.select(*columns, F.round(total, 9).alias("score"))


def score(rows: DataFrame, text: str, counts: list, every: bool = False) -> DataFrame:
    """rows that hold one (or, with every, each) of the counted phrases, with their score rounded to 9 places."""
    if not counts:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    found, corpus = _counted(rows, text, counts)
    return _scored(found, corpus, rows.columns, [f"_f{i}" for i in range(len(counts))], every)


class Prepared:
    """One reading of a corpus for several channels of a search: lengths and counts of its rows are kept with their keys, and the corpus figures.

    close() frees them."""

    def __init__(self, rows: DataFrame, text: str, keys: list[str], channels: dict[str, list]):
        self.rows, self.keys, self.names = rows, keys, {}
        counts: list = []
        for channel, own in channels.items():
            self.names[channel] = [f"_f{len(counts) + i}" for i in range(len(own))]
            counts += own
        self.kept, self.made = [], []
        if counts:
            names = [f"_f{i}" for i in range(len(counts))]
            each = rows.select(*keys, F.explode(_figures(F.col(text), counts)).alias("_c")).select(*keys, "_c.*").persist(StorageLevel.MEMORY_AND_DISK)
            corpus = _corpus(each, names).persist()
            self.kept, self.made = [each, corpus], [each, corpus]

    def score(self, channel: str, every: bool = False) -> DataFrame:
        names = self.names[channel]
        if not names:
            return self.rows.select(*self.keys, F.lit(0.0).alias("score")).limit(0)
        return _scored(*self.kept, self.keys, names, every)

    def close(self) -> None:
        for t in self.made:
            t.unpersist()


@dataclass
class Index:
    """places: keys, dl, token, at (one row for each word of a corpus); corpus: one row (n, avgdl). posted: both, as they are written."""

    places: DataFrame
    corpus: DataFrame
    posted: DataFrame | None = None

    @staticmethod
    def of(posted: DataFrame) -> Index:
        """From runs of postings (token, n, words, held), of which those without a token count rows and words."""
        rows = posted.select("token", F.explode("held").alias("_h")).select("token", "_h.*")
        places = rows.select(*(c for c in rows.columns if c not in ("token", "at")), "token", F.explode("at").alias("at"))
        figures = posted.where("token is null").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
        return Index(places, figures, posted)

    def save(self, folder: str) -> None:
        """The runs of each task, written where they are made."""
        if self.posted is None:
            raise ValueError("only an index of a corpus is written")
        self.posted.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/places")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        return Index.of(spark.read.parquet(f"{folder}/places"))


def indexed(rows: DataFrame, text: str, keys: list[str]) -> Index:
    """The index of a corpus whose keys are distinct. Rows without a word count in its figures only."""
    t = rows.select(*keys, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).select(*keys, F.size("t").alias("dl"), "t")
    own = T.StructType([f for f in t.schema.fields if f.name != "t"]).add("at", T.ArrayType(T.IntegerType()))
    schema = T.StructType().add("token", "string").add("n", "long").add("words", "long").add("held", T.ArrayType(own))
    return Index.of(t.mapInArrow(runs(by_token), schema))


class Stored(Prepared):
    """Hits and figures of several channels as Prepared keeps them, from an index. A channel is a list of phrases (lists of words) and prefixes (strings)."""

    def __init__(self, index: Index, keys: list[str], channels: dict[str, list[list[str] | str]]):
        self.rows, self.keys, self.names, self.kept, self.made = index.places, keys, {}, [], []
        sought: list[list[str] | str] = []
        for channel, own in channels.items():
            self.names[channel] = [f"_f{len(sought) + i}" for i in range(len(own))]
            sought += own
        if not sought:
            return
        token, names = F.col("token"), [f"_f{i}" for i in range(len(sought))]
        wanted = token.isin(sorted({w for s in sought if not isinstance(s, str) for w in s}))
        for s in sought:
            wanted = wanted | token.startswith(s) if isinstance(s, str) else wanted

        def count(s: list[str] | str) -> Column:
            if isinstance(s, str):
                return F.count_if(token.startswith(s))
            if len(s) == 1:
                return F.count_if(token == s[0])
            # Where the phrase would begin by each of its words.
            begins = [F.collect_list(F.when(token == w, F.col("at") - i)) for i, w in enumerate(s)]
            both = begins[0]
            for b in begins[1:]:
                both = F.array_intersect(both, b)
            return F.size(both)

        found = index.places.where(wanted).groupBy(*keys).agg(F.first("dl").alias("_dl"), *(count(s).alias(n) for s, n in zip(sought, names, strict=True))).persist()
        figures = found.agg(*(F.coalesce(F.sum((F.col(n) > 0).cast("long")), F.lit(0).cast("long")).alias(f"{n}_n") for n in names))
        corpus = index.corpus.select(F.col("n").alias("_n"), F.col("avgdl").alias("_avg"))
        self.kept = self.made = [found, corpus.crossJoin(F.broadcast(figures)).persist()]  # one row each


def postings(rows: DataFrame, key: str, text: str, words: DataFrame | None = None) -> DataFrame:
    """(key, token, f, dl): the index of a corpus, one row for each row and distinct token; with words (token; few rows: broadcast) of these only."""
    t = rows.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("token"))
    if words is not None:
        t = t.join(F.broadcast(words.select("token").distinct()), "token", "left_semi")
    return t.groupBy(key, "dl", "token").agg(F.count("*").alias("f"))


def score_batch(index: DataFrame, corpus: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Scores of many keyword queries at once from postings. queries: query, token (few rows: broadcast). corpus: one row (n, avgdl)."""
    wanted = F.broadcast(queries.select("token").distinct())
    hits = index.join(wanted, "token")
    n = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weight = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(F.broadcast(n), "token").crossJoin(F.broadcast(corpus)).select(key, "token", weight.alias("w"))
    return scored.join(F.broadcast(queries), "token").groupBy("query", key).agg(F.round(F.sum("w"), 9).alias("score"))
