"""The index in segments: after any changes a search is that of an index built anew; blocks are skipped without loss."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sondage.operators import bm25, channels, segments
from sondage.operators.segments import Segments

WORDS = [f"w{i}" for i in range(40)]


def text(r):
    return " ".join(r.choices(WORDS, weights=[60 / (i + 1) for i in range(40)], k=r.randrange(0, 30)))


def table(spark, state):
    return spark.createDataFrame([(p, i, t) for p, rows in state.items() for i, t in enumerate(rows)], "path string, chunk_no int, content string")


def whole(index, query, limit):
    counts = [c for w in query for c in bm25.phrase_count([w])]
    rows = bm25.score(index, "content", counts)
    return [(r["path"], r["chunk_no"], r["score"]) for r in rows.orderBy(F.desc("score"), "path", "chunk_no").limit(limit).collect()]


def files_in(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}


def test_changes_and_compactions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_ROWS", 4)
    r = random.Random(1)
    folder = str(tmp_path / "index")
    index, state, compactions = Segments.create(spark, folder), {}, 0
    for step, kind in enumerate(["upsert", "upsert", "delete", "upsert", "rename", "swap", "upsert", "upsert"]):
        before = files_in(folder)
        names = sorted(state)
        if kind == "upsert":
            new = {f"p{r.randrange(40)}": [text(r) for _ in range(r.randrange(1, 4))] for _ in range(12)}
            index, state = index.upserted(table(spark, new)), state | new
        elif kind == "delete":
            gone = r.sample(names, 4)
            index = index.deleted(spark.createDataFrame([(p,) for p in [*gone, "unknown"]], "path string"))
            state = {p: t for p, t in state.items() if p not in gone}
        else:
            a, b, c = r.sample(names, 3)
            pairs = {a: b, b: a} if kind == "swap" else {a: b, c: f"q{step}", "unknown": names[0]}
            index = index.renamed(spark.createDataFrame(list(pairs.items()), "old string, new string"))
            own = {p: t for p, t in state.items() if p not in pairs}
            state = own | {n: state[o] for o, n in pairs.items() if o in state}
        after = files_in(folder)
        # Whatever was written stays as it is.
        assert all(after[f] == t for f, t in before.items() if not f.endswith(".crc"))
        if step in (3, 7):
            old = {s.no for s in index.segments}
            index = index.compacted(fan=2)
            compactions += {s.no for s in index.segments} != old
            assert all(files_in(folder)[f] == t for f, t in after.items() if not f.endswith(".crc"))
        if step in (2, 5, 7):
            anew = table(spark, state)
            assert index.rows == sum(map(len, state.values()))
            for query in (["w30", "w39", "w2"], ["w1", "w1", "nowhere"]):
                got = [(x["path"], x["chunk_no"], x["score"]) for x in index.best(query, 5).collect()]
                assert got == whole(anew, query, 5)
    assert compactions >= 2
    loaded = Segments.load(spark, folder)
    assert loaded == index or (loaded.version, loaded.segments, loaded.fated) == (index.version, index.segments, index.fated)
    # Other channels over the live index.
    one, other = channels.prepared_chunks(loaded, "w1 w2"), channels.prepared_chunks(table(spark, state), "w1 w2")
    for channel in (channels.content_phrase, channels.content_keyword):
        assert sorted(channel(one, "w1 w2").collect()) == sorted(channel(other, "w1 w2").collect())
    left = sorted(state)[:3]
    assert loaded.pruned(spark.createDataFrame([(p,) for p in left], "path string")).rows == sum(len(state[p]) for p in left)


def test_two_writers_and_empty_states(spark, tmp_path):
    folder = str(tmp_path / "index")
    index = Segments.create(spark, folder)
    assert index.best(["a"], 3).count() == 0 and index.upserted(table(spark, {})) is index
    first = index.upserted(table(spark, {"x": ["a b", ""], "y": [None]}))
    assert (first.rows, first.average) == (3, 2 / 3) and [tuple(r)[:2] for r in first.best(["a"], 3).collect()] == [("x", 0)]
    with pytest.raises(Exception, match="(?i)exist"):
        index.upserted(table(spark, {"z": ["a"]}))
    assert first.reset().best(["a"], 3).count() == 0 and Segments.load(spark, folder).segments == []


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """A rare word beside a frequent one: blocks without it can't reach the best rows."""
    monkeypatch.setattr(segments, "BLOCK_ROWS", 4)
    monkeypatch.setattr(segments, "FIRST", 3)
    state = {f"p{i:03d}": [("rare rare " if i % 50 == 0 else "") + "often " * (1 + i % 3) + "x " * 20] for i in range(200)}
    index = Segments.create(spark, str(tmp_path / "i")).upserted(table(spark, state))
    got = [(r["path"], r["chunk_no"], r["score"]) for r in index.best(["often", "rare"], 3).collect()]
    assert got == whole(table(spark, state), ["often", "rare"], 3)
    assert index.read[0] <= 8 < index.read[1]
