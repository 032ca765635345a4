"""Weights that change while a stream runs: versions of a table in a folder, read anew for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sondage.functions import lists
from sondage.operators import feedback

SCHEMA = "key string, value double, version long"


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("basePath", folder).parquet(f"{folder}/version=*")


def latest(spark: SparkSession, folder: str) -> int:
    """The number of the newest version, 0 if there is none. A version counts once it is complete."""
    from pyspark.errors import AnalysisException

    try:
        return _versions(spark, folder).agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def publish(weights: DataFrame, folder: str) -> int:
    """Writes weights (key, value) as the next version. Of two writers at once one fails."""
    version = latest(weights.sparkSession, folder) + 1
    weights.select("key", F.col("value").cast("double")).coalesce(1).write.parquet(f"{folder}/version={version}")
    return version


def current(spark: SparkSession, folder: str, defaults: dict[str, float] | None = None) -> DataFrame:
    """(key, value): the newest version over the defaults; values that make no sense are left out."""
    known = spark.createDataFrame(list((defaults or lists.WEIGHTS).items()), "key string, value double")
    version = latest(spark, folder)
    return feedback.loaded(_versions(spark, folder).where(F.col("version") == version), known) if version else known


def fused(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """(query, path, score) of hits (query, path, channel, rrf): contributions times the weight of their channel; unknown channels count once."""
    w = F.broadcast(weights.select(F.col("key").alias("channel"), "value"))  # a row for each weight
    return hits.join(w, "channel", "left").groupBy("query", "path").agg(F.round(F.sum(F.col("rrf") * F.coalesce("value", F.lit(1.0))), 9).alias("score"))


def rescored(hits: DataFrame, folder: str, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """A stream of hits, each micro-batch fused with the weights that are current when it begins. Without seconds it takes what there is and ends."""

    def batch(rows: DataFrame, number: int) -> None:
        write(fused(rows, current(rows.sparkSession, folder)), number)

    writer = hits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
