"""The index of paths, the join of words with typos, percentiles by selection, JSON, snippets, vectors of the views."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sondage.functions.json import json_set, json_value
from sondage.operators import channels, chunking, feedback, path_index, ranking, typos
from sondage.sources import files

PATHS = ["corpus/Small_Ring_12.md", "corpus/Größe/ring-small.txt", "a/b", "x/Ünïcode Ring.txt", "smallring", "a\tb/ring", "é", "corpus/small/ring/small_ring.go", "a%b/c_d.txt", "İzmir/ring.pdf"]


@pytest.fixture(scope="module")
def paths(spark):
    return spark.createDataFrame([(p,) for p in PATHS] + [("a/b",)], "path string")


@pytest.fixture(scope="module")
def stored(spark, paths, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("paths"))
    path_index.indexed(paths).save(folder)
    return path_index.PathIndex.load(spark, folder)


@pytest.mark.parametrize("text", ["SMALL rin", "sma nowhere b/", "é", "a%b c_d", "zzzz", "ring.pdf small_ring.go", "x"])
def test_substrings(paths, stored, text):
    want = [r["path"] for r in channels.substring_match(paths, text).collect()]
    found = channels.substring_match(stored, text)
    assert [r["path"] for r in found.collect()] == want
    if text:
        own = [w.lower() for w in text.split() if len(w.encode()) >= 2]
        assert want == sorted({p for p in PATHS if any(w in p.lower() for w in own)})


def test_channels_from_the_index_do_not_read_the_paths(paths, stored):
    text = "small ring"
    one, other = channels.prepared_paths(stored, text), channels.prepared_paths(paths.distinct(), text)
    for channel in (channels.path_any, channels.path_all, channels.path_prefix, channels.path_short_prefix):
        assert sorted(channel(one, text).collect()) == sorted(channel(other, text).collect())
    plan = channels.substring_match(stored, "ring")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "LogicalRDD" not in plan and len(re.findall(r"FileScan parquet", plan)) == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [0.51, 0.8])
def test_close_words(spark, least):
    r = random.Random(int(least * 100))
    word = lambda: "".join(r.choices("abc", k=r.choice([1, 2, 3, 4, 5, 6, 7, 9, 12])))
    asked, known = {word() for _ in range(60)} | {"résumé"}, {word() for _ in range(120)} | {"Resume"}
    rows = typos.close_words(*(spark.createDataFrame([(w,) for w in ws] + [("",), (None,)], "word string") for ws in (asked, known)), least)
    got = {(x["asked"], x["known"]) for x in rows.collect()}
    fold = {"résumé": "resume", "Resume": "resume"}
    want = {(fold.get(a, a), fold.get(b, b)) for a in asked for b in known if 1 - edits(fold.get(a, a), fold.get(b, b)) / max(len(a), len(b)) >= least}
    assert got == want and rows.count() == len(got)


def test_boosts_of_a_table_of_queries(spark, paths):
    queries = ["smal rign", "ring", "x", "small rnig twelve", "", "unicode ring", "größe", "a b"]
    got = {(r["query"], r["path"]): r["boost"] for r in typos.fuzzy_boosts(spark.createDataFrame([(q,) for q in queries], "query string"), paths.distinct()).collect()}
    for q in queries:
        own = {r["path"]: r["b"] for r in paths.distinct().select("path", ranking.fuzzy_boost(F.col("path"), q).alias("b")).collect()}
        assert {p: b for (a, p), b in got.items() if a == q} == pytest.approx({p: b for p, b in own.items() if b > 0})
    plan = typos.close_words(paths.select(F.col("path").alias("word")), paths.select(F.col("path").alias("word")))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_percentiles_by_selection(spark):
    r = random.Random(2)
    inf, nan = float("inf"), float("nan")
    groups = {"a": [r.gauss(0, 1) for _ in range(500)], "b": [1.0] * 7, "c": [10.0**r.randrange(-300, 300) for _ in range(90)], "d": [-inf, inf, 3.0, inf, nan], "e": [5e-324, 1e-323, 0.0, -1e308, 1e308], None: [2.0, 1.0], "f": [inf]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("g", None)]
    got = feedback.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v", [0, 50, 95, 99], buckets=32)
    want = {}
    for k, vs in groups.items():
        own = sorted(vs, key=lambda v: (v != v, v))
        want[k] = [repr(own[len(own) * p // 100]) for p in (0, 50, 95, 99)]
    assert {x["k"]: [repr(x[f"p{p}"]) for p in (0, 50, 95, 99)] for x in got.collect()} == want


def test_json(spark):
    rows = [(1, '{"b": {"z": [1, "x"]}, "path": "old", "n": 1.50}'), (2, "{}"), (3, "[1]"), (4, "no"), (5, None), (6, '{"path": null}')]
    made = spark.createDataFrame(rows, "i int, t string").select("i", json_value(F.col("t"), "$.b.z[1]").alias("v"), json_set(F.col("t"), "path", F.lit('a"b')).alias("s"))
    assert [tuple(r) for r in made.orderBy("i").collect()] == [
        (1, "x", '{"b":{"z":[1,"x"]},"n":1.5,"path":"a\\"b"}'), (2, None, '{"path":"a\\"b"}'), (3, None, None), (4, None, None), (5, None, None), (6, None, '{"path":"a\\"b"}'),
    ]


def test_snippets_of_letters_that_grow_in_lower_case():
    text = "İ" * 300 + " here is the word " + "x" * 500
    assert all("word" in s for s in chunking.snippets(text, "word", 1, 60))


def test_texts_open_plain_files_only(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.png").write_bytes(b"\x89PNG")
    got = files.texts(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["content"]) for r in got.collect()) == [("a.txt", "plain"), ("b.png", "")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"decode\(content", plan)) == 1
