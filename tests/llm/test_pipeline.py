"""The pipeline on a small table against plain versions of its stages."""

import itertools
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sondage.llm import quality

sys.path.insert(0, str(Path(__file__).parent))
from test_llm import SCHEMA, corpus, families_of_copies, plain_removed, plain_sets, prose  # noqa: E402


def plain_lines(rows, percent=7, least=3):
    pages, holds = Counter(), Counter()
    for _, t, _, host, _ in rows:
        if t is not None:
            pages[host] += 1
            holds.update((host, x) for x in {y.strip(" \t\x0b\x0c\r") for y in t.split("\n")} - {""})
    gone = {k for k, n in holds.items() if n >= least and 100 * n >= percent * pages[k[0]]}
    cut = lambda t, host: "\n".join(y for y in t.split("\n") if (host, y.strip(" \t\x0b\x0c\r")) not in gone)
    return [(d, None if t is None else cut(t, host), lang, host, n) for d, t, lang, host, n in rows]


def test_run(spark, tmp_path):
    rows = [(i + 1000 if d is not None else d, t, *rest) for i, (d, t, *rest) in enumerate(corpus() + families_of_copies()) if d is not None]
    rows += [(5000 + i, f"{prose(60, 500 + i)}\nshared footer line\n{prose(30, 900)}", "en", "s0", 1) for i in range(12)]
    rows += [(6000 + i, " ".join(f"{w}###" for w in prose(60, 700 + i).split()), "en", "s1", 1) for i in range(12)]
    labels = [(r[0], int(not 6000 <= r[0] < 6012), 0) for r in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    verdicts = quality.judge(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    kept = {r["doc_id"] for r in verdicts if r["kept"]}
    assert not kept & set(range(6000, 6012)) and set(range(5000, 5012)) <= kept
    left = plain_lines([r for r in rows if r[0] in kept])
    assert not any("shared footer" in r[1] for r in left)
    left = [r for r, (d, n, c) in zip(left, plain_sets(left, 5, 80), strict=True) if n == 0 or d == c]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = {d: kept_words for d, _, _, kept_words in plain_removed(left, 13)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(plain)
    # Texts keep their own white space, so pieces are held against the last stage's input.
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {d: " ".join(t.split()) for d, t in texts.items()} == plain
    want = []
    for d, t in texts.items():
        ids = own.encode(t, add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        want += [(d, i, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for i, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, 1024)]))]
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)


def test_run_on_odd_tables(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows, a very long text, columns with names of the operators' own; then no rows at all."""
    rows = [(None, prose(60, 1), "en", "s0", 1), (None, prose(60, 1), "en", "s0", 1), (1, None, None, None, None), (2, "", "en", "s0", 0), (3, prose(50, 3), "en", None, 1), (3, prose(50, 3), "en", None, 1)]
    rows += [(4, prose(30_000, 4), "en", "s1", 1), (5, "x " * 40_000, "en", "s1", 1)] + [(10 + i, prose(60, 10 + i), "en", "s0", 1) for i in range(20)]
    names = SCHEMA + ", row string, kept string, mark long, Starts int, piece int"
    docs = spark.createDataFrame([(*r, "r", "k", 1, 2, 3) for r in rows], names)
    for name, df in (("some", docs), ("none", docs.limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(10 + i, 1, 0) for i in range(20)] if name == "some" else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    ids = [r["doc_id"] for r in got]
    # Base rules reject what has no or few words or repeats itself; rows without an id have no copy of theirs to yield to.
    assert set(ids) == {None, 3, 4, *range(10, 30)} and ids.count(3) == 1 and sum(r["doc_id"] == 4 for r in got) > 20
    assert ids.count(None) == 2
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
