"""Views that bind the operators to the tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import lists
from sondage.functions.text import basename, epoch_seconds, extension

EXTENSIONS = [".pdf", ".txt", ".md", ".docx", ".go", ".py", ".png", ".dat"]
#: The clock of the queries: 2024-02-01 00:00:00 UTC in seconds.
NOW = 1_706_745_600
START = 1_704_067_200
NS = 1_000_000_000
WINDOW, STEP = 512, 410


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if one of its splits holds more than twice an even share of the rows (files of few row groups); others are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("split")).count().collect()]  # a row for each split; no column is read
    return df.repartition(cores) if held and max(held) * cores > 2 * sum(held) else df


def _ext(key):
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (key % 8).cast("int") + 1)


def _path():
    return F.concat(F.lit("corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), _ext(F.col("doc_id")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    mtime = (F.lit(START) + (F.col("doc_id") % 720) * 3600) * NS
    return d.select(
        "doc_id", _path().alias("path"), F.md5("text").alias("hash"), mtime.cast("long").alias("mtime"), F.col("n_chars").alias("size"),
        F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("content_indexed"), _ext(F.col("doc_id")).alias("ext"), mtime.cast("long").alias("ctime"),
        (mtime + (F.col("doc_id") % 48) * 3600 * NS).cast("long").alias("atime"),
    )


def chunks(spark: SparkSession, sf_dir: str, size: int = WINDOW, step: int = STEP) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"), "text"))
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / step).cast("int")
    return d.select("doc_id", "path", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")).select(
        "doc_id", "path", "chunk_no", F.substr("text", F.col("chunk_no") * step + 1, F.lit(size)).alias("content")
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"))
    path = F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), _ext(F.col("p_partkey")))
    return p.select("p_partkey", path.alias("path"), (F.col("p_size").cast("long") * 100_000).alias("size")).withColumn("name", basename(F.col("path"))).withColumn("ext", extension(F.col("path")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("doc_id", "path")
    count = table(spark, sf_dir, "documents").agg(F.count("*").alias("_n"))
    e = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(count)).select("vec_id", (F.col("vec_id") % F.col("_n")).alias("doc_id"), F.when(F.col("label") == 0, "image").otherwise("text").alias("collection"), F.col("embedding").cast("array<double>").alias("vector"))
    return e.join(f, "doc_id").select("vec_id", "path", "collection", "vector")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    vote = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("q"), (F.col("user_id") % 20).cast("string")).alias("query"), F.concat(F.lit("doc_"), (F.col("event_id") % 200).cast("string")).alias("path"),
        vote.alias("feedback"), epoch_seconds(F.col("ts")).alias("created_at"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "view", "rename").otherwise("modified")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), action.alias("action"), "ts")


def config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(lists.WEIGHTS.items()), "key string, value double")


STORED = [*lists.WEIGHTS, "unknown"]


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as they may be stored: the latest value for each key, some of them invalid."""
    e = table(spark, sf_dir, "events")
    key = F.element_at(F.array(*map(F.lit, STORED)), (F.col("event_id") % len(STORED)).cast("int") + 1)
    return e.groupBy(key.alias("key")).agg((F.floor(F.max_by("value", "event_id")) % 25 - 2).cast("double").alias("value"))


_EXT_SQL = "[" + ", ".join(f"'{x}'" for x in EXTENSIONS) + "]"
_PATH_SQL = f"'corpus/' || source || '/' || lang || '/doc_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || {_EXT_SQL}[doc_id % 8 + 1]"
#: Definitions of the views for the oracle, in the order in which they depend on each other.
SQL = {
    "files_v": f"""SELECT doc_id, {_PATH_SQL} AS path, md5(text) AS hash, ({START} + doc_id % 720 * 3600) * {NS} AS mtime, n_chars AS size,
        CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS content_indexed, {_EXT_SQL}[doc_id % 8 + 1] AS ext, ({START} + doc_id % 720 * 3600) * {NS} AS ctime,
        ({START} + doc_id % 720 * 3600 + doc_id % 48 * 3600) * {NS} AS atime FROM documents""",
    "chunks_v": f"""SELECT doc_id, {_PATH_SQL} AS path, CAST(i AS INTEGER) AS chunk_no, substr(text, i * {STEP} + 1, {WINDOW}) AS content
        FROM documents, unnest(range(0, greatest(length(text) - 1, 0) // {STEP} + 1)) t(i)""",
    "parts_v": f"""SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_extract(lower(path), '(\\.[^./]*)$', 1) AS ext FROM (SELECT p_partkey,
        p_brand || '/' || p_type || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || {_EXT_SQL}[p_partkey % 8 + 1] AS path, CAST(p_size AS BIGINT) * 100000 AS size FROM part)""",
    "vec_v": f"""SELECT vec_id, path, CASE WHEN label = 0 THEN 'image' ELSE 'text' END AS collection, CAST(embedding AS DOUBLE[]) AS vector
        FROM embeddings JOIN (SELECT doc_id, {_PATH_SQL} AS path FROM documents) f ON f.doc_id = vec_id % (SELECT count(*) FROM documents)""",
    "feedback_v": """SELECT event_id AS id, 'q' || (user_id % 20) AS query, 'doc_' || (event_id % 200) AS path,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS feedback, CAST(floor(epoch(ts)) AS BIGINT) AS created_at FROM events""",
    "changes_v": """SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'view' THEN 'rename' ELSE 'modified' END AS action, ts FROM events""",
    "stored_v": f"SELECT [{', '.join(repr(k) for k in STORED)}][event_id % {len(STORED)} + 1] AS key, CAST(floor(max_by(value, event_id)) % 25 - 2 AS DOUBLE) AS value FROM events GROUP BY 1",
    "config_v": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in lists.WEIGHTS.items()) + ") t(key, value)",
}


def with_views(sql: str, *names: str, more: dict[str, str] | None = None) -> str:
    """sql with the named views, and further ones, in front."""
    views = {n: SQL[n] for n in names} | (more or {})
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in views.items()) + "\n" + sql if views else sql
