"""Vector search: exact scans that keep only the nearest rows of each task before they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.vectors import dot, norm

from .channels import IMAGE_LIMIT, TEXT_LIMIT


def similar(vectors: DataFrame, query: list[float], collection: str | None = None) -> DataFrame:
    """vectors with their cosine to the query, rounded to 6 places."""
    q = F.array(*(F.lit(float(x)) for x in query))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    rows = vectors if collection is None else vectors.where(F.col("collection") == collection)
    return rows.withColumn("sim", F.round(dot(F.col("vector"), q) / (norm(F.col("vector")) * size), 6))


def nearest(vectors: DataFrame, query: list[float], limit: int, collection: str | None = None) -> DataFrame:
    return similar(vectors, query, collection).orderBy(F.desc("sim"), "vec_id").limit(limit)


def knn_channel(vectors: DataFrame, query: list[float], collection: str, weight: float, k: float = 60.0, limit: int | None = None) -> DataFrame:
    """(path, rrf): every near vector of a path adds to it."""
    n = limit or (TEXT_LIMIT if collection == "text" else IMAGE_LIMIT)
    rank = F.row_number().over(Window.orderBy(F.desc("sim"), "vec_id"))
    return nearest(vectors, query, n, collection).select("path", (weight / (k + rank)).alias("w")).groupBy("path").agg(F.round(F.sum("w"), 9).alias("rrf"))


def best_per_path(vectors: DataFrame, query: list[float], collection: str | None, limit: int) -> DataFrame:
    return nearest(vectors, query, limit, collection).groupBy("path").agg(F.max("sim").alias("score"))
