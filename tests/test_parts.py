import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.functions import weights
from sondage.functions.text import glob_regex
from sondage.operators import chunking, filters
from sondage.operators.evaluation import evaluate
from sondage.sources import files
from sondage.streaming.index import apply_batch


def test_sixteen_bit_numbers():
    assert weights.decode(bytes.fromhex("003c00c00100007c"), "F16").tolist() == [1.0, -2.0, 2.0**-24, float("inf")]
    assert weights.decode(bytes.fromhex("803f00c00100807f"), "BF16").tolist() == [1.0, -2.0, float(np.uint32(0x10000).view(np.float32)), float("inf")]
    for data, kind in ((b"abc", "F16"), (b"12345678", "F64")):
        with pytest.raises(ValueError):
            weights.decode(data, kind)


def test_tensor_file(tmp_path):
    data = np.arange(6, dtype="<f4")
    header = json.dumps({"other": {"dtype": "F32", "shape": [6], "data_offsets": [0, 24]}, "embeddings": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "t").write_bytes(len(header).to_bytes(8, "little") + header + data.tobytes())
    assert weights.table(str(tmp_path / "t")).tolist() == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "u").write_bytes((1 << 40).to_bytes(8, "little") + b"{}")
    with pytest.raises(ValueError):
        weights.table(str(tmp_path / "u"))


def test_chunks_fit_and_overlap():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(60)) for i in range(8))
    own = chunking.split_text(text, 200, 40)
    assert all(len(c) <= 200 for c in own) and all(w in " ".join(own) for w in text.split())
    assert chunking.split_text("", 10) == [] and chunking.split_text("short", 10) == ["short"]
    assert all(len(c) <= 10 for c in chunking.split_text("x" * 35, 10, 2))


def test_snippets():
    text = "a" * 2000 + " needle " + "b" * 3000 + " needle"
    two = chunking.snippets(text, "needle x", 3)
    assert len(two) == 2 and all("needle" in s and len(s) == 800 for s in two)
    assert chunking.snippets(text, "absent", 2) == [text[:800]] and chunking.snippets("short", "q", 1) == ["short"] and chunking.snippets("", "q", 1) == []


def test_globs():
    import re

    for glob, name, hit in (("inv*", "invoice.pdf", True), ("inv*", "my_invoice.pdf", False), ("voice", "invoice.pdf", True), ("a?c.[tm]*", "abc.txt", True), ("a.b", "axb", False)):
        assert bool(re.match(glob_regex(glob), name)) is hit


def test_scan_reads_metadata_only(spark, tmp_path):
    for name in ("a/x.txt", "a/node_modules/y.js", "b/z.tmp", "b/notes.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text of " + name)
    rows = files.scan(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in rows.collect()) == ["notes.md", "x.txt"]
    assert sorted(r["content"] for r in files.texts(spark, str(tmp_path)).where("content <> ''").collect()) == ["text of a/node_modules/y.js", "text of a/x.txt", "text of b/notes.md"]


def test_batches_are_idempotent(spark):
    meta = "path string, hash string, mtime long, size long, content_indexed int, ext string, ctime long, atime long"
    old = spark.createDataFrame([("a", "1", 1, 1, 1, "", 5, 1), ("b", "2", 1, 1, 1, "", 6, 1)], meta)
    stored = spark.createDataFrame([("a", 0, "old"), ("a", 1, "old"), ("b", 0, "keep")], "path string, chunk_no int, content string")
    batch = spark.createDataFrame([("a", "new text", "9", 2, 2, "", 7, 2), ("c", "", "0", 3, 3, "", 8, 3)], "path string, content string, hash string, mtime long, size long, ext string, ctime long, atime long")
    once = apply_batch(old, stored, batch)
    twice = apply_batch(*once, batch)
    for got in (once, twice):
        assert sorted((r["path"], r["hash"], r["ctime"], r["content_indexed"]) for r in got[0].collect()) == [("a", "9", 5, 1), ("b", "2", 6, 1), ("c", "0", 8, 1)]
        assert sorted((r["path"], r["content"]) for r in got[1].collect()) == [("a", "new text"), ("b", "keep")]


def test_scope_is_a_folder_not_a_prefix(spark):
    rows = spark.createDataFrame([("C:\\Data\\Cache\\x",), ("c:/data/CacheBackup/x",), ("c:/data/cache",)], "path string")
    assert [r[0] for r in rows.select(filters.under(F.col("path"), "c:/Data/Cache/")).collect()] == [True, False, True]


def test_evaluation(spark):
    def search(text):
        return spark.createDataFrame([(p, 1.0) for p in {"x": ["a", "b"], "y": ["c"]}[text]], "path string, score double")

    by_query, _ = evaluate(spark, search, [(1, "x", "k", {"b": 3.0}), (2, "y", "k", {"c": 1.0})])
    got = {r["query"]: (round(r["ndcg"], 4), r["recall"], r["mrr"]) for r in by_query.collect()}
    assert got == {"1": (0.6309, 1.0, 0.5), "2": (1.0, 1.0, 1.0)}


def test_every_accent_is_folded(spark):
    from sondage.functions.text import tokens
    from sondage.operators.channels import query_tokens

    text = "Voilà l'Ångström, ÉTUDE šťastný ệ ø Ærø straße plain"
    want = ["voila", "l", "angstrom", "etude", "stastny", "e", "ø", "ærø", "straße", "plain"]
    assert spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0] == want == query_tokens(text)
