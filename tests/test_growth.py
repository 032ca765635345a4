"""Work that must not grow faster than the tables: no index is shuffled as it is written, no file is read by one task, tables of queries hand on few rows,
no table of paths goes through the driver, a passage that many documents quote brings none of them together,
no vector is written for every tile that it is compared in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import near_vectors, set_join
from sondage.operators import batch, bm25, path_index, ranking, segments, typos
from sondage.sources import views as V


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_indexes_are_written_without_a_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "red fox red"), ("b", 0, ""), ("b", 1, None), ("c", 0, "Fox")], "path string, chunk_no int, content string")
    index = bm25.indexed(rows, "content", ["path", "chunk_no"])
    assert exchanges(index.posted) == 0
    assert sorted(map(tuple, index.places.collect())) == [("a", 0, 3, "fox", 1), ("a", 0, 3, "red", 0), ("a", 0, 3, "red", 2), ("c", 0, 1, "fox", 0)]
    assert index.corpus.collect()[0].asDict() == {"n": 4, "avgdl": 1.0}
    made = segments.Segments.create(spark, str(tmp_path / "s")).upserted(rows)
    assert sorted((r["token"], r["path"], r["f"]) for r in made.held().collect()) == [("fox", "a", 1), ("fox", "c", 1), ("red", "a", 2)]
    paths = path_index.indexed(spark.createDataFrame([("Ab",), ("b",)], "path string"))
    assert sorted(map(tuple, paths.postings.collect())) == sorted([("ab", "Ab"), ("b\n", "Ab"), ("ab\n", "Ab"), ("b\n", "b")])


def test_a_file_of_one_row_group_is_dealt_over_all_cores(spark, tmp_path):
    """Its splits are several, but one of them holds all rows."""
    folder = str(tmp_path / "t")
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        df = V.spread(spark.read.parquet(folder))
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 200_000 and max(sizes) < 100_000


def test_best_rows_of_many_queries_by_small_steps(spark, monkeypatch):
    """Ties, limits and groups of queries; tasks hand on what may be among the best and no more."""
    monkeypatch.setattr(batch, "ASKED", 3)
    texts = {i: "a " * (i % 3 + 1) + "b-c " * (i % 2) + "x " * (i % 5) for i in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "path int, content string").repartition(3)
    queries = ["a", "b-c", "a b-c", "x x a", "none", "c"]
    got = batch.best(rows, "content", ["path"], batch.phrases(spark.createDataFrame([(q,) for q in queries], "query string")), 7)
    found = {}
    for r in got.collect():
        found.setdefault(r["query"], []).append((r["path"], r["score"]))
    for q in queries:
        counts = [c for w in q.split() for c in bm25.phrase_count(w.split("-"))]
        want = [(r["path"], r["score"]) for r in bm25.score(rows, "content", counts).orderBy(F.desc("score"), "path").limit(7).collect()]
        assert sorted(found.get(q, []), key=lambda x: (-x[1], x[0])) == want


def test_postings_of_the_words_asked_for(spark):
    rows = spark.createDataFrame([(1, "red fox red"), (2, "blue")], "k int, content string")
    got = bm25.postings(rows, "k", "content", spark.createDataFrame([("red",), ("red",)], "token string")).collect()
    assert [(r["k"], r["token"], r["f"], r["dl"]) for r in got] == [(1, "red", 2, 3)]


def broadcasts(df):
    """What is broadcast, each with what it is made of."""
    found, left = [], [df._jdf.queryExecution().sparkPlan()]
    while left:
        node = left.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "BroadcastHashJoin":
            found.append(children[node.buildSide().toString() == "BuildRight"].toString())
        left += children
    return found


@pytest.mark.parametrize("limit", [typos.BROADCAST, 0])
def test_typos_broadcast_neither_words_nor_paths(spark, tmp_path, monkeypatch, limit):
    """The paths' file is small, so that Spark takes them for a table to broadcast; beyond the limit what is asked is shuffled too."""
    monkeypatch.setattr(typos, "BROADCAST", limit)
    folder = str(tmp_path / "paths")
    names = ["small_ring", "rign-ring_rings", "blue_bolt"]
    spark.range(300).select(F.concat(F.lit("a/"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 3 + 1).cast("int")), F.lit("_"), F.col("id").cast("string"), F.lit(".pdf")).alias("path")).write.parquet(folder)
    paths, queries = spark.read.parquet(folder), ["smal rign", "ring", "bleu bolt 17", "pdf", "none"]
    got = typos.fuzzy_boosts(spark.createDataFrame([(q,) for q in queries], "query string"), paths)
    near = typos.close_words(spark.createDataFrame([("rign",)], "word string"), paths.select(F.col("path").alias("word")))
    sent = broadcasts(got) + broadcasts(near)
    assert len(sent) == (2 if limit else 0) and not any("path#" in x for x in sent)
    rows = [((r["query"], r["path"]), r["boost"]) for r in got.collect()]
    want = {(q, r["path"]): r["b"] for q in queries for r in paths.select("path", ranking.fuzzy_boost(F.col("path"), q).alias("b")).collect() if r["b"] > 0}
    assert len(rows) == len(want) > 300 and dict(rows) == pytest.approx(want)


def test_a_common_passage_makes_no_family(spark, monkeypatch):
    """120 pairs of near copies that all quote one passage are families of two, also where all counts share few bytes."""
    r = np.random.default_rng(8)
    passage, members = r.integers(1, 1 << 63, 12).astype(np.uint64), []
    for pair in range(120):
        own = r.integers(1, 1 << 63, 60).astype(np.uint64)
        members += [(2 * pair + i, bytes(np.unique(np.concatenate([own[i : i + 59], passage])).tobytes())) for i in (0, 1)]
    df = spark.createDataFrame(members, "node long, shingles binary").repartition(3)
    for most in (24, 16):
        monkeypatch.setattr("sondage.llm.sketch.MOST_COUNTS", most)
        found = {x["node"]: x["family"] for x in set_join.families(df, 80).collect()}
        assert found == {n: n - n % 2 for n, _ in members}


def test_vectors_are_written_once_for_all_tiles(spark, monkeypatch):
    """Random vectors, near copies in chains and a dense group, in many small blocks, labels that share blocks; against all pairs."""
    monkeypatch.setattr(near_vectors, "PER_PIVOT", 30)
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 64))
    for i in range(300, 500):
        x[i] = x[i - 1 - i % 3] + 0.12 * r.normal(size=64)
    x[500:620] = x[0] + 0.05 * r.normal(size=(120, 64))
    x = x.astype(np.float32)
    label = [i % 2 if i < 650 else 10 + i // 7 for i in range(700)]
    df = spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(700)], "vec_id long, embedding array<float>, label int").repartition(3)
    written, plain = [], near_vectors.materialise

    def materialise(df, name="table", **options):
        made = plain(df, name, **options)
        where = spark._jvm.org.apache.hadoop.fs.Path(made._written_to)
        written.append(where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength())
        return made

    monkeypatch.setattr(near_vectors, "materialise", materialise)
    got = sorted(tuple(y) for y in near_vectors.link(df).collect())
    assert sum(written) < 3 * x.nbytes
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    links = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(links, False)
    least = np.arange(700)
    while (new := np.minimum(least, np.where(links, least[None], 700).min(axis=1))).tolist() != least.tolist():
        least = new
    assert got == [(i, int(links[i].sum()), int(least[i]), least[i] == i) for i in range(700)]
    assert links.sum() > 5_000
