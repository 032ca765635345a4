"""Ranked search against a scan of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, queries, k):
    held = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(queries), key=str):
        scores = []
        for i, c in held:
            m = 75 + 25 * c.total() * n // length
            own = TERM.findall((text or "").translate(UPPER))
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in own if t in c)
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(*args, **more):
    return sorted((tuple(r) for r in ranked.search(*args, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def texts(n, seed):
    r = random.Random(seed)
    words = ["the"] * 20 + [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "中文", "A1b2", "x_y", "don't"]
    return [" ".join(r.choices(words, k=r.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("part", [7])
def test_search_is_a_full_scan(spark, monkeypatch, part):
    """Groups of copies with equal scores across shards, frequent words, nulls, repeated ids, a very long text, clashing columns."""
    monkeypatch.setattr(ranked, "PART", part)
    monkeypatch.setattr(ranked, "SAMPLE", 100)
    monkeypatch.setattr(ranked, "ROUNDS", (2, 3))
    monkeypatch.setattr(ranked, "PORTION", 1000)
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts(300, 1))] + [(2000 + i, "w1 the W2 copy") for i in range(150)]
    docs += [(5, None), (None, "w1 w2 lonely"), (6, ""), (7, "-- ,,"), (3000, "long w3 " * 5000), docs[3], docs[3]]
    queries = [(i, t) for i, t in enumerate(texts(12, 2))] + [(50, "w1 w2 w1 copy"), (50, "w1 w2 w1 copy"), (51, None), (52, "zzz"), (None, "lonely"), (53, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("q", F.lit(1)).repartition(3)
    qs = spark.createDataFrame(queries, "item_id long, text string").withColumn("rank", F.lit(1))
    visits = spark.sparkContext.accumulator(0)
    assert got(df, qs, k=6, visits=visits) == plain(docs, queries, 6)
    assert visits.value > 0


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranked, "QUERIES", 4)
    docs = list(enumerate(texts(80, 3)))
    queries = list(enumerate(texts(9, 4)))
    assert got(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id int, text string"), k=3) == plain(docs, queries, 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert got(docs.limit(0), queries) == [] == got(docs, queries.limit(0))
    # A term that all documents hold still weighs something.
    assert [r[:3] for r in got(docs, queries)] == [(1, 1, 1)]


def test_bisection_brings_like_documents_together():
    """Documents of eight topics, dealt at random: most places at the end of the tree hold one topic."""
    r = random.Random(1)
    docs = [np.unique([t * 40 + r.randrange(40) for _ in range(25)]) for t in range(8) for _ in range(60)]
    order = list(range(len(docs)))
    r.shuffle(order)
    tree = ranked.Bisection([docs[i] for i in order], 320)
    leaf = tree.leaves(np.concatenate(docs), np.array([len(d) for d in docs]))
    pure = sum(Counter((np.arange(len(docs)) // 60)[leaf == x].tolist()).most_common(1)[0][1] for x in set(leaf.tolist()))
    assert pure > 0.9 * len(docs)


def test_portions_end_between_terms(monkeypatch):
    text = " ".join(texts(20, 9)).encode()
    want = ranked.terms_of(text)
    monkeypatch.setattr(ranked, "PORTION", 3)
    assert ranked.terms_of(text) == want == Counter(t.encode() for t in TERM.findall(text.decode().translate(UPPER)))
