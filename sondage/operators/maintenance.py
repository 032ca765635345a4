"""Index maintenance: changes to the tables of files and chunks as joins whose result replaces the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import _any, under


def inserted(files: DataFrame, found: DataFrame) -> DataFrame:
    """files and those found whose path is new."""
    return files.unionByName(found.join(files.select("path"), "path", "left_anti").select(files.columns))


def upserted(files: DataFrame, written: DataFrame) -> DataFrame:
    """files after content was written: hash, times, size and extension are replaced, the creation time is kept, content is not complete."""
    new = written.select("path", *(F.col(c).alias(f"_{c}") for c in ("hash", "mtime", "size", "ext", "ctime", "atime"))).withColumn("_new", F.lit(True))
    rows = files.join(new, "path", "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(
        "path", pick("hash"), pick("mtime"), pick("size"), F.when(F.col("_new"), 0).otherwise(F.col("content_indexed")).alias("content_indexed"),
        pick("ext"), F.coalesce("ctime", "_ctime").alias("ctime"), pick("atime"),
    )


def replaced(chunks: DataFrame, rewritten: DataFrame, new: DataFrame) -> DataFrame:
    """chunks without those of the rewritten paths, and the new ones."""
    return chunks.join(rewritten.select("path").distinct(), "path", "left_anti").select(chunks.columns).unionByName(new.select(chunks.columns))


def completed(files: DataFrame, batch: DataFrame) -> DataFrame:
    """files marked complete where the batch (path, last) holds their last chunk."""
    done = batch.groupBy("path").agg(F.max(F.col("last").cast("int")).alias("_last"))
    return files.join(done, "path", "left").withColumn("content_indexed", F.when(F.col("_last") == 1, 1).otherwise(F.col("content_indexed"))).drop("_last")


def without_content(files: DataFrame, empty: DataFrame) -> DataFrame:
    """files whose content is empty: marked complete; their figures are refreshed unless all are zero. Unknown paths are not added."""
    new = empty.select("path", *(F.col(c).alias(f"_{c}") for c in ("mtime", "size"))).withColumn("_new", F.lit(True))
    refresh = F.col("_new") & ((F.col("_mtime") != 0) | (F.col("_size") != 0))
    rows = files.join(new, "path", "left")
    for c in ("mtime", "size"):
        rows = rows.withColumn(c, F.when(refresh, F.col(f"_{c}")).otherwise(F.col(c)))
    return rows.withColumn("content_indexed", F.when(F.col("_new"), 1).otherwise(F.col("content_indexed"))).select(files.columns)


def deleted(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("path"), "path", "left_anti").select(table.columns)


def renamed(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """table with old paths replaced by new ones; nothing is embedded anew."""
    rows = table.join(pairs.select(F.col("old").alias("path"), "new"), "path", "left")
    return rows.withColumn("path", F.coalesce("new", "path")).select(table.columns)


def stale(files: DataFrame, live: DataFrame) -> DataFrame:
    return files.join(live.select("path"), "path", "left_anti")


def outside(files: DataFrame, roots: list[str]) -> DataFrame:
    return files.where(~_any([under(F.col("path"), r) for r in roots]))


def reset(files: DataFrame, folder: str | None = None) -> DataFrame:
    here = F.lit(True) if folder is None else under(F.col("path"), folder)
    return files.withColumn("hash", F.when(here, "0").otherwise(F.col("hash"))).withColumn("content_indexed", F.when(here, 0).otherwise(F.col("content_indexed")))


def reset_all(files: DataFrame, *contents: DataFrame) -> list[DataFrame]:
    """files with their content waiting again, and the tables of texts and vectors empty."""
    return [reset(files), *(c.limit(0) for c in contents)]


def unindexed(files: DataFrame) -> DataFrame:
    """Files whose content waits to be indexed, the newest first."""
    return files.where("content_indexed = 0").orderBy(F.desc("mtime"), "path")


def hash_of(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, hash) of paths; '0' if unknown."""
    return paths.select("path").join(files.select("path", "hash"), "path", "left").select("path", F.coalesce("hash", F.lit("0")).alias("hash"))


def changed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths seen whose hash differs from that on record."""
    return seen.select("path", F.col("hash").alias("seen")).join(files.select("path", "hash"), "path", "left").where(~F.col("seen").eqNullSafe(F.col("hash"))).select("path")


def sub_batches(files: DataFrame, name) -> DataFrame:
    """A batch number for each file, so that no batch holds a name twice."""
    return files.withColumn("batch", F.row_number().over(Window.partitionBy(name).orderBy("path")) - 1)
