"""Indexes, settings and votes on disk, tables of queries, approximate search, streams of files, hooks for models."""

import json
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import ann, bm25, channels, chunking, embedding
from sondage.operators.parser import parse, parsed, parts, split
from sondage.plans import catalog
from sondage.sources import config, files
from sondage.streaming import changes, index

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
RAW = ['annual report type:doc size:>2mb -draft', "holiday photos", '"open quote ext:pdf', "a\tb name:x* sort:date year:2020 mod:<7d", "", None, "size:1kb-2kb created:2023 acc:yesterday -", "-x:y un:known"]


def test_tables_of_queries(spark):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(RAW)], "i int, raw string")
    got = {r["i"]: r for r in parsed(rows, "raw", NOW).withColumn("parts", parts(F.col("raw"))).collect()}
    for i, raw in enumerate(RAW):
        q, row = parse(raw or "", NOW), got[i]["query"]
        assert [row["text"], row["name"], row["sort"], row["extensions"], row["excluded"]] == [q.text, q.name, q.sort, q.extensions, q.excluded]
        assert [(row[f"{c}_min"], row[f"{c}_max"]) for c in ("size", "modified", "created", "accessed")] == [q.size, q.modified, q.created, q.accessed]
        assert got[i]["parts"] == (None if raw is None else split(raw))


def exact(vectors: dict[int, list[float]], asked: list[int], limit: int) -> dict[int, set[int]]:
    ids = np.array(list(vectors))
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = {i: n for n, i in enumerate(ids)}
    return {q: set(ids[np.argsort(-(x @ x[at[q]]), kind="stable")[:limit]].tolist()) for q in asked}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_approximate_index(spark, sf):
    folder = f"/root/testdata/{sf}"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    found: dict[int, set[int]] = {}
    for r in catalog.QUERIES["v5_approximate"](spark, folder).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(vectors, [i for i in vectors if i % 100 == 0], 10)
    assert set(found) == set(want) and np.mean([len(found[q] & want[q]) / 10 for q in want]) >= 0.9


def test_approximate_index_on_disk(spark, tmp_path, monkeypatch):
    """Tiles, ties, vectors without a cosine, an empty table, and a filter on cells that skips the others' folders."""
    monkeypatch.setattr(ann, "TILE_ROWS", 7)
    monkeypatch.setattr(ann, "TILE_QUERIES", 2)
    rng = np.random.default_rng(1)
    made = {i: rng.normal(size=8).tolist() for i in range(60)} | {60 + i: [1.0] * 8 for i in range(20)}
    odd = [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [float("inf")] * 8)]
    rows = spark.createDataFrame([*made.items(), *odd], "vec_id long, vector array<double>")
    model = ann.fit(rows)
    ann.save(ann.build(rows, model), str(tmp_path / "index"))
    stored = ann.load(spark, str(tmp_path / "index"))
    assert stored.count() == len(made)
    everywhere = ann.Model(model.centres, len(model.centres))
    asked = rows.where("vec_id in (0, 5, 9, 61, 100, 101, 102)").withColumnRenamed("vec_id", "query_id")
    found: dict[int, list[int]] = {}
    for r in ann.search(stored, rows, asked, everywhere, limit=5, refine=16).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact(made, [0, 5, 9], 5)
    assert set(found) == {0, 5, 9, 61} and all(set(found[q]) == want[q] for q in want) and found[61] == [60, 61, 62, 63, 64]
    none = rows.limit(0)
    empty = ann.fit(none)
    assert ann.search(ann.build(none, empty), none, asked, empty).count() == 0
    assert "PartitionFilters: [isnotnull(cell" in stored.where("cell = 1")._jdf.queryExecution().toString()


def test_settings(tmp_path):
    new, old = str(tmp_path / "new.json"), tmp_path / "old.json"
    assert config.load(new) == config.DEFAULTS
    old.write_text(json.dumps(["b", ".GIT", "a"]))
    want = sorted([*config.DEFAULTS["ExcludedPaths"], "a", "b"])
    assert config.load(new, str(old))["ExcludedPaths"] == want and not old.exists()
    config.save(config.load(new) | {"IncludedDirs": ["/Y", "/y", "/X"], "APIPort": 1}, new)
    got = config.load(new)
    assert (got["IncludedDirs"], got["APIPort"], got["ExcludedPaths"]) == (["/X", "/Y"], 1, want)


def test_index_and_votes_on_disk(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "red fox red"), ("b", 0, "blue fox")], "path string, chunk_no int, content string")
    files.save_index({"chunks": chunks}, str(tmp_path))
    back = files.load_index(spark, str(tmp_path), ["chunks"])["chunks"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, chunks.collect()))
    votes = spark.createDataFrame([("q", "a", 1), ("", "a", 1), ("q", None, 1), ("q", "b", 2), ("q", "b", -1)], "query string, path string, feedback int")
    for _ in range(2):
        files.append_feedback(votes, str(tmp_path / "votes"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "votes")).collect())) == [("q", "a", 1)] * 2 + [("q", "b", -1)] * 2


def test_images_and_hashes(spark, tmp_path):
    for name, data in (("x.PNG", b"\x89" * 100), ("y.txt", b"t"), ("z.gif", b"\x89" * 99 + b"\x88")):
        (tmp_path / name).write_bytes(data)
    rows = files.images(spark, str(tmp_path)).select("path", files.full_hash(F.col("content")).alias("hash")).collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in rows) == ["x.PNG", "z.gif"] and len({r["hash"] for r in rows}) == 2


def test_hooks(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(i, None if i % 7 == 3 else "x" * i) for i in range(50)], "i int, content string")
    assert all(r["vector"] == (None if r["content"] is None else [float(r["i"]), 1.0]) for r in embedding.embedded(rows, load).collect())
    raw = spark.createDataFrame([("a.PDF", b"1"), ("b.pdf", b"fail"), ("c.bin", b"3"), ("d.pdf", None), (None, b"5")], "path string, content binary")
    got = embedding.extracted(raw, {".pdf": lambda b: f"text {int(b)}"}).collect()
    assert sorted(((r["path"] or ""), r["content"]) for r in got) == [("", ""), ("a.PDF", "text 1"), ("b.pdf", ""), ("c.bin", ""), ("d.pdf", "")]


def test_ingest(spark, tmp_path):
    schema = "path string, content string, hash string, mtime long, size long, ext string, ctime long, atime long"
    meta = "path string, hash string, mtime long, size long, content_indexed int, ext string, ctime long, atime long"
    spark.createDataFrame([("a", "some text", "1", 1, 1, "", 1, 1), ("b", "", "2", 2, 2, "", 2, 2)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    seen = []

    def write(batch, n):
        done, stored = index.apply_batch(spark.createDataFrame([], meta), spark.createDataFrame([], "path string, chunk_no int, content string"), batch)
        seen.append((sorted((r["path"], r["content_indexed"]) for r in done.collect()), sorted((r["path"], r["content"]) for r in stored.collect())))

    for _ in range(2):  # the second run finds nothing new
        index.ingest(changes.source(spark, str(tmp_path / "in"), schema, files=1), write, str(tmp_path / "checkpoint")).awaitTermination()
    assert seen == [([("a", 1), ("b", 1)], [("a", "some text")])]


def test_hourly_counts_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:00:00", "y")], "ts string, event_type string").write.json(str(tmp_path / "in"))
    counts = changes.hourly(changes.source(spark, str(tmp_path / "in"), "ts timestamp, event_type string"))
    counts.writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start().awaitTermination()
    assert sorted((str(r["window"]["start"]), r["event_type"], r["n"]) for r in spark.table("hourly").collect()) == [("2024-01-01 00:00:00", "x", 2), ("2024-01-01 01:00:00", "y", 1)]


def test_recursive_chunks_hold_every_word(spark):
    rows = catalog.QUERIES["m11_recursive_chunks"](spark, "/root/testdata/sf0.001").collect()
    words: dict[str, set[str]] = {}
    for r in rows:
        words.setdefault(r["path"], set()).update(r["content"].split())
        assert 0 < len(r["content"]) <= 512
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sum(r["last"] for r in rows) == len(words) == sum(bool(r["text"]) for r in docs)
    by_number = {p.split("doc_")[1][:6]: w for p, w in words.items()}
    assert all(set(w for w in r["text"].split() if len(w) < 512) <= by_number[f"{r['doc_id']:06d}"] for r in docs if r["text"])
    assert chunking.split_text("a b", 2) == ["a", "b"]




def test_stored_index_finds_what_the_corpus_holds(spark, tmp_path):
    """Words, repeated words, phrases, prefixes, accents, empty and null contents; filters on tokens reach the files."""
    rows = [("a", 0, "red fox red fox, red"), ("a", 1, "fox red"), ("b", 0, ""), ("b", 1, None), ("c", 0, "Föx réd red-fox foxes"), ("d", 0, "blue"), ("e", 0, "red red fox red red fox")]
    chunks = spark.createDataFrame(rows, "path string, chunk_no int, content string")
    bm25.indexed(chunks, "content", ["path", "chunk_no"]).save(str(tmp_path))
    stored = bm25.Index.load(spark, str(tmp_path))
    for text in ("red fox", "red red fox", "foxes nothing", "absent", "", "Réd", "red-fox blue", "fo re"):
        mine, plain = channels.prepared_chunks(stored, text), channels.prepared_chunks(chunks.fillna("", "content"), text)
        for found in (channels.content_keyword, channels.phrase_chunks, channels.fuzzy_chunks):
            got, want = (sorted(tuple(r) for r in found(x, text).collect()) for x in (mine, plain))
            assert [g[:2] for g in got] == [w[:2] for w in want] and [g[-1] for g in got] == pytest.approx([w[-1] for w in want])
        mine.close()
        plain.close()
    assert "PushedFilters: [Or(In(token" in str(stored.places.where(F.col("token").isin("a", "b") | F.col("token").startswith("c"))._jdf.queryExecution().toString())
