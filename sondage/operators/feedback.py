"""Votes, retrieval metrics and the search for better weights."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.functions import lists
from sondage.sources.files import written

HALF_LIFE_DAYS, LEAST_VOTES, GAIN = 7.0, 10, 7.0
FACTORS, BLENDS = [0.7, 0.9, 1.0, 1.1, 1.3], [-0.15, 0.0, 0.15]
#: In the order of the grid: of equal objectives the first candidate wins.
SIGNALS = ["w_path_fts", "w_path_prefix", "w_content_fts", "w_semantic_text", "w_semantic_image"]
#: Candidates that one group of a query ranks.
CHUNK = 625
NDCG, MRR, RECALL, DOWN = 0.45, 0.30, 0.20, 1.25


def vote_weight(created_at: Column, now: int) -> Column:
    """Half after each HALF_LIFE_DAYS; future votes count in full."""
    age = F.greatest(F.lit(now) - created_at, F.lit(0))
    return F.pow(F.lit(2.0), -age / F.lit(HALF_LIFE_DAYS * 86_400))


def latest_votes(votes: DataFrame, now: int) -> DataFrame:
    """The newest vote on each query and path, with its weight; a newest vote of zero takes the others back."""
    w = Window.partitionBy("query", "path").orderBy(F.desc("created_at"), F.desc("id"))
    newest = votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return newest.where("feedback <> 0").withColumn("weight", F.round(vote_weight(F.col("created_at"), now), 9)).where("weight > 0")


def enough(votes: DataFrame, least: int = LEAST_VOTES) -> DataFrame:
    """One row: whether there are votes enough for a search."""
    return votes.agg((F.count("*") >= least).alias("enough"), F.count("*").alias("votes"))


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query, ndcg, recall, mrr. ranked: query, path, rank; relevant: query, path, gain. A query without relevant paths counts 1 in all."""
    discount = lambda r: F.log2(r + 1)
    gain = F.pow(F.lit(2.0), F.col("gain")) - 1
    good = relevant.where("gain > 0")
    ideal = good.withColumn("_i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "path")))
    best = ideal.groupBy("query").agg(F.sum(F.when(F.col("_i") <= k, gain / discount(F.col("_i"))).otherwise(0.0)).alias("_best"), F.count("*").alias("_n"))
    hits = ranked.where(F.col("rank") <= k).join(good, ["query", "path"]).groupBy("query").agg(F.sum(gain / discount(F.col("rank"))).alias("_dcg"), F.count("*").alias("_hits"), F.min("rank").alias("_first"))
    rows = ranked.select("query").distinct().join(best, "query", "left").join(hits, "query", "left")
    share = lambda c: F.round(F.when(F.col("_n").isNull(), 1.0).otherwise(F.coalesce(c, F.lit(0.0))), 6)
    return rows.select("query", share(F.col("_dcg") / F.col("_best")).alias("ndcg"), share(F.col("_hits") / F.col("_n")).alias("recall"), share(1 / F.col("_first")).alias("mrr"))


def positive_metrics(ranked: DataFrame, votes: DataFrame, depth: int = 8, k: int = 10) -> DataFrame:
    """Metrics of upvoted paths, weighted by their votes; constant gain. ranked: query, path, rank."""
    up = votes.where("feedback > 0").select("query", "path", "weight")
    ideal = up.withColumn("_i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "path")))
    best = ideal.groupBy("query").agg(F.sum(F.when(F.col("_i") <= k, GAIN * F.col("weight") / F.log2(F.col("_i") + 1)).otherwise(0.0)).alias("_ideal"), F.max("weight").alias("_top"), F.sum("weight").alias("_all"))
    at = up.join(ranked.select("query", "path", "rank"), ["query", "path"], "left").join(best, "query")
    near = F.when(F.col("rank") <= k, GAIN * F.col("weight") / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return at.groupBy("query").agg(
        F.round(F.sum(near) / F.first("_ideal"), 6).alias("ndcg"),
        F.round(F.coalesce(F.max(F.col("weight") / F.col("rank") / F.col("_top")), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.sum(F.when(F.col("rank") <= depth, F.col("weight")).otherwise(0.0)) / F.first("_all"), 6).alias("recall"),
    )


def candidates(spark: SparkSession, current: dict[str, float], factors: list[float] = FACTORS, blends: list[float] = BLENDS) -> DataFrame:
    """The grid: id, a weight for each signal, blend; the first is the least id."""
    rows = []
    for i, (*f, b) in enumerate(product(*[factors] * len(SIGNALS), blends)):
        rows.append((i, *(float(current[s] * x) for s, x in zip(SIGNALS, f, strict=True)), min(1.0, max(0.0, current["w_reranker_blend"] + b))))
    return spark.createDataFrame(rows, "candidate int, " + ", ".join(f"{s} double" for s in SIGNALS) + ", blend double")


def current_candidate(factors: list[float] = FACTORS, blends: list[float] = BLENDS) -> int:
    """The candidate that changes nothing."""
    at = 0
    for _ in SIGNALS:
        at = at * len(factors) + factors.index(1.0)
    return at * len(blends) + blends.index(0.0)


def _scores(values: np.ndarray, reranker: np.ndarray, code: np.ndarray, weights: np.ndarray, blend: np.ndarray) -> np.ndarray:
    """Score of each path (row) by each candidate (column)."""
    total = values[:, :1] * weights[0]
    for i in range(1, len(weights)):
        total = total + values[:, i : i + 1] * weights[i]
    known = ~np.isnan(reranker)
    if known.any():
        share = total / np.maximum(total.max(axis=0), 1e-9)
        total = np.where(blend > 0, (1 - blend) * share + blend * np.where(known, reranker, 0.0)[:, None], total)
    return np.round(total * code[:, None], 9)


def ranked_by(signals: DataFrame, grid: DataFrame, k: int = 10) -> DataFrame:
    """candidate, query, path, rank of the first k.

    signals: query, path, a column for each signal, reranker (between 0 and 1,
    null where there is none) and code (what a path's score is multiplied by).
    Channels bound the paths of a query and the grid has a fixed size, so a query
    and a chunk of the grid are a group, ranked as one matrix."""
    rows = grid.orderBy("candidate").collect()
    ids = np.array([r["candidate"] for r in rows], np.int32)
    weights, blend = np.array([[r[s] for r in rows] for s in SIGNALS]), np.array([r["blend"] for r in rows])
    chunks = -(-len(rows) // CHUNK)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("path")
        at = int(t.column("chunk")[0].as_py())
        own = slice(at * CHUNK, (at + 1) * CHUNK)
        column = lambda name: t.column(name).to_numpy().astype(np.float64)
        score = _scores(np.stack([column(s) for s in SIGNALS], axis=1), column("reranker"), column("code"), weights[:, own], blend[own])
        best = np.argsort(-score, axis=0, kind="stable")[:k]
        paths = t.column("path").combine_chunks().take(pa.array(best.T.ravel()))
        found = len(ids[own]) * len(best)
        query = pa.array([t.column("query")[0].as_py()] * found, pa.string())
        return pa.table([pa.array(np.repeat(ids[own], len(best))), query, paths, pa.array(np.tile(np.arange(1, len(best) + 1, dtype=np.int32), len(ids[own])))], ["candidate", "query", "path", "rank"])

    dealt = signals.select("query", "path", *SIGNALS, "reranker", "code", F.explode(F.sequence(F.lit(0), F.lit(max(0, chunks - 1)))).alias("chunk"))
    return dealt.groupBy("query", "chunk").applyInArrow(run, "candidate int, query string, path string, rank int")


def objective(ranked: DataFrame, votes: DataFrame, k: int = 10) -> DataFrame:
    """candidate, objective: votes' weighted NDCG, MRR and recall less the downvotes near the top."""
    v = votes.select("query", "path", "feedback", "weight")
    up = v.where("feedback > 0")
    best = up.withColumn("_i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "path"))).groupBy("query").agg(
        F.sum(F.when(F.col("_i") <= k, F.col("weight") / F.log2(F.col("_i") + 1)).otherwise(0.0)).alias("_ideal"), F.max("weight").alias("_top"), F.sum("weight").alias("_up")
    )
    weights = v.groupBy("query").agg(F.sum("weight").alias("_w")).join(best, "query", "left")
    met = ranked.join(v, ["query", "path"], "left")
    by = met.groupBy("candidate", "query").agg(
        F.sum(F.when(F.col("feedback") > 0, F.col("weight") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"),
        F.max(F.when(F.col("feedback") > 0, F.col("weight") / F.col("rank"))).alias("_rr"),
        F.sum(F.when((F.col("feedback") > 0) & (F.col("rank") <= 8), F.col("weight")).otherwise(0.0)).alias("_found"),
        F.sum(F.when(F.col("feedback") < 0, F.col("weight") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_down"),
    ).join(weights, "query")
    part = lambda c: F.coalesce(c, F.lit(0.0))
    value = NDCG * part(F.col("_dcg") / F.col("_ideal")) + MRR * part(F.col("_rr") / F.col("_top")) + RECALL * part(F.col("_found") / F.col("_up")) - DOWN * F.col("_down") / F.col("_w")
    return by.groupBy("candidate").agg(F.round(F.sum(value * F.col("_w")) / F.sum("_w"), 9).alias("objective"))


def best_candidate(objectives: DataFrame) -> DataFrame:
    return objectives.orderBy(F.desc("objective"), "candidate").limit(1)


def published(config: DataFrame, grid: DataFrame, best: DataFrame, current: int) -> DataFrame:
    """key, value of the configuration with the best candidate's weights; it stays as it is if that is the current one."""
    keys = [*SIGNALS, "w_reranker_blend"]
    won = grid.join(best.where(F.col("candidate") != current).select("candidate"), "candidate").withColumnRenamed("blend", "w_reranker_blend")
    new = won.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("new")) for c in keys))).alias("x")).select("x.*")
    return config.join(new, "key", "full").select("key", F.coalesce("new", "value").alias("value"))


def loaded(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """Stored weights over the defaults; a stored value that makes no sense is left out, the blend is held between 0 and 1."""
    v = F.col("_v")
    sound = (~F.col("key").isin("rrf_k", "rerank_top_n")) | ((F.col("key") == "rrf_k") & (v > 0)) | ((F.col("key") == "rerank_top_n") & (v >= 1))
    held = F.when(F.col("key") == "w_reranker_blend", F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).otherwise(v)
    rows = defaults.join(stored.select("key", F.col("value").alias("_v")), "key", "left")
    return rows.select("key", F.coalesce(F.when(v.isNotNull() & sound, held), "value").alias("value"))


def deltas(current: DataFrame, defaults: DataFrame) -> DataFrame:
    rows = current.join(defaults.select("key", F.col("value").alias("_d")), "key")
    return rows.select("key", F.round(F.col("value") - F.col("_d"), 9).alias("delta")).where("delta <> 0")


def migrated(stored: DataFrame, key: str, old: float, new: float) -> DataFrame:
    """An old default becomes the new one; a value that was chosen stays."""
    return stored.withColumn("value", F.when((F.col("key") == key) & (F.col("value") == old), new).otherwise(F.col("value")))


def nearest_rank(values: DataFrame, by: str, value: str, percent: list[int], buckets: int = 1024) -> DataFrame:
    """Percentiles by nearest rank: the element at n * p // 100 of the sorted values; nulls aren't counted.

    Each round counts the values between two bounds in a histogram and goes on within the bucket that holds the rank, until its values are
    equal. No group's values are sorted or brought together. Infinite values come first and last, and NaN after them."""
    kind = values.schema[value].dataType
    rows = values.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(value).cast("double").alias("v"))
    low, high, nan = F.col("v") == float("-inf"), F.col("v") == float("inf"), F.isnan("v")
    finite = F.when(~(low | high | nan), F.col("v"))
    sizes = rows.groupBy("by").agg(F.count("*").alias("n"), F.count_if(low).alias("below"), F.count(finite).alias("between"), F.count_if(high).alias("above"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    ranked = sizes.select("*", F.explode(F.array(*map(F.lit, percent))).alias("p")).withColumn("rank", F.floor(F.col("n") * F.col("p") / 100) + 1 - F.col("below"))
    edge = F.when(F.col("rank") <= 0, float("-inf")).when(F.col("rank") > F.col("between") + F.col("above"), float("nan")).when(F.col("rank") > F.col("between"), float("inf"))
    state = written(ranked.select("by", "p", "rank", F.coalesce(edge, "lo").alias("lo"), F.coalesce(edge, "hi").alias("hi")), "ranks")
    while True:
        open_ = state.where("lo < hi")
        if not open_.limit(1).count():
            break
        met = rows.withColumnRenamed("by", "_by").join(open_, F.col("_by").eqNullSafe(F.col("by"))).where(F.col("v").between(F.col("lo"), F.col("hi")))
        # By logarithm, so that values of any size are told apart within a few rounds; bounds of nearly the same logarithm by their difference.
        log = lambda x: F.when(F.col("lo") > 0, F.log(x)).when(F.col("hi") < 0, -F.log(-x)).otherwise(F.signum(x) * F.log1p(F.abs(x)))
        wide, width = log(F.col("hi")) - log(F.col("lo")), F.col("hi") / 2 - F.col("lo") / 2
        share = F.when(wide > 1e-9, (log(F.col("v")) - log(F.col("lo"))) / wide).when(width > 0, (F.col("v") / 2 - F.col("lo") / 2) / width).otherwise((F.col("v") > F.col("lo")).cast("double"))
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        counts = met.groupBy("by", "p", "rank", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        below = F.sum("n").over(Window.partitionBy("by", "p").orderBy("bucket")) - F.col("n")  # over the buckets of a histogram
        chosen = counts.withColumn("below", below).where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n")))
        state = written(chosen.select("by", "p", (F.col("rank") - F.col("below")).alias("rank"), "lo", "hi").union(state.where("NOT lo < hi")), "ranks")
    return state.groupBy(F.col("by").alias(by)).agg(*(F.max(F.when(F.col("p") == p, F.col("lo"))).cast(kind).alias(f"p{p}") for p in percent))


DEFAULTS = lists.WEIGHTS
