"""Files as tables: a scan of metadata, whole texts, images, and saved indexes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import lists
from sondage.functions.text import extension
from sondage.operators import filters


def scan(spark: SparkSession, root: str, included: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Metadata of every file below root that isn't junk, skipped or out of scope. The contents aren't read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    ns = F.unix_micros("modificationTime") * 1000
    rows = raw.select(path.alias("path"), F.lit("0").alias("hash"), ns.alias("mtime"), F.col("length").alias("size"), F.lit(0).alias("content_indexed"), ns.alias("ctime"), ns.alias("atime"))
    p = F.col("path")
    # Folders above the root don't count.
    below = F.substr("path", F.lit(len(re.sub("^file:/+", "/", root).rstrip("/")) + 1))
    rows = rows.where(~filters.junk(p) & ~filters.skipped_by_scan(below) & filters.in_scope(p, included or [], excluded or []))
    return rows.withColumn("ext", extension(p)).select("path", "hash", "mtime", "size", "content_indexed", "ext", "ctime", "atime")


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of plain text files up to the size limit; other files have an empty content, aren't opened, and only their names are searched."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = extension(F.col("path")).isin(lists.PLAIN_TEXT) & ~filters.too_large(F.col("length"))
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")
    return raw.where(plain).select(path, F.decode("content", "UTF-8").alias("content")).union(raw.where(~plain).select(path, F.lit("")))


def html_body(html: Column) -> Column:
    """Text of a page without its tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the images that are embedded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.where(extension(F.col("path")).isin(lists.IMAGE_SOURCE)).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def full_hash(content: Column) -> Column:
    """A digest of all bytes of a file, to tell whether it changed."""
    return F.xxhash64(content).cast("string")


def save_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes the tables of an index as a snapshot; postings are clustered by token, so that a query reads few files."""
    for name, df in tables.items():
        rows = df.repartition("token").sortWithinPartitions("token") if "token" in df.columns else df
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; where it is unset and all runs in one process, a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sondage-")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_feedback(votes: DataFrame, folder: str) -> None:
    """Appends the valid votes of a batch."""
    filters.valid_feedback(votes).write.mode("append").parquet(folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new shared folder and read back: its lineage ends there."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
