"""Runs labelled queries through a search function and reports quality: one by one with their times, or a table of them in one job."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batch, feedback


def evaluate(spark: SparkSession, search: Callable[[str], DataFrame], queries: list[tuple[int, str, str, dict[str, float]]], k: int = 10, runs: int = 1) -> tuple[DataFrame, DataFrame]:
    """(by query, by category) of queries (id, text, category, gains). search gives ranked paths with scores."""
    ranked, relevant, meta = [], [], []
    for number, text, category, gains in queries:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            found = [r["path"] for r in search(text).limit(k).collect()]
            took.append((time.perf_counter() - began) * 1000)
        ranked += [(str(number), p, i + 1) for i, p in enumerate(found)] or [(str(number), "", 1)]
        relevant += [(str(number), p, float(g)) for p, g in gains.items()]
        meta += [(str(number), category, t) for t in took]
    scores = feedback.metrics(spark.createDataFrame(ranked, "query string, path string, rank int"), spark.createDataFrame(relevant, "query string, path string, gain double"), k)
    times = spark.createDataFrame(meta, "query string, category string, ms double")
    by_query = times.groupBy("query", "category").agg(F.avg("ms").alias("ms")).join(scores, "query")
    by_category = by_query.groupBy("category").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("ndcg", "recall", "mrr", "ms")), F.count("*").alias("queries"))
    return by_query, by_category


def evaluate_batch(search: Callable[[DataFrame], DataFrame], queries: DataFrame, relevant: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(by query, by category) of queries (query, category), all in one search. search gives (query, path, score); relevant: query, path, gain.

    A query without a result counts as one with a wrong one. Nothing is collected."""
    found = batch.ranked(search(queries.select("query")), k)
    ranked = queries.select("query").join(found, "query", "left").select("query", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("rank", F.lit(1)).alias("rank"))
    by_query = queries.select("query", "category").join(feedback.metrics(ranked, relevant, k), "query")
    by_category = by_query.groupBy("category").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("ndcg", "recall", "mrr")), F.count("*").alias("queries"))
    return by_query, by_category
