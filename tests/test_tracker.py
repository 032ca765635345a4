"""Tracking with state: the flushes are those of one batch wherever the stream is cut; by number and by time."""

import json
import random
import time

import pytest

from sondage.streaming import changes, tracker

SCHEMA = "folder string, seq long, event string, path string, content string"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tracker.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")


def events(seed, n=90):
    r = random.Random(seed)
    out, seq = [], 0
    while len(out) < n:
        folder, a, b = r.choice("xy"), f"d{r.randrange(3)}/f{r.randrange(4)}", f"d{r.randrange(3)}/f{r.randrange(4)}"
        kind = r.choice(["add", "remove", "modified", "modified", "rename", "move"])
        steps = {"rename": [("old_name", a), ("new_name", b)], "move": [("add", a), ("remove", f"e/{a.split('/')[1]}")]}.get(kind, [(kind, a)])
        for event, path in steps:
            out.append((folder, seq, event, path, r.choice("uvw") if event == "modified" else None))
            seq += 1
    return out


def streamed(spark, tmp_path, name, rows, cuts, count, seconds=1800, wait=0):
    """Flushes of the rows, one batch for each part between the cuts."""
    folder, out = tmp_path / f"{name}-in", str(tmp_path / f"{name}-out")
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    found = tracker.flushes(stream, count, seconds)
    for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        (folder / f"{i:03d}.json").write_text("\n".join(json.dumps(dict(zip(["folder", "seq", "event", "path", "content"], r))) for r in rows[lo:hi]))
        time.sleep(0.01)
    writer = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-c")).option("path", out)
    # With timers of processing time a stream always has another batch to run, unless batches without data are off.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(bool(wait)).lower())
    q = (writer.trigger(processingTime="1 second") if wait else writer.trigger(availableNow=True)).start()
    try:
        assert q.awaitTermination(wait or 120) != bool(wait), "the stream didn't end"
    finally:
        q.stop()
    return sorted(tuple(r) for r in spark.read.schema(tracker.OUTPUT).parquet(out).collect())


def test_cuts_make_no_difference(spark, tmp_path):
    rows = events(3)
    whole = streamed(spark, tmp_path, "a", rows, [], 20)
    r = random.Random(4)
    assert streamed(spark, tmp_path, "b", rows, sorted(r.sample(range(1, len(rows)), 6)), 20) == whole
    assert {x[1] for x in whole if x[0] == "x"} == set(range(sum(e[0] == "x" for e in rows) // 20))
    # The first flush of a folder is the plan of its first twenty events.
    first = [e for e in rows if e[0] == "x"][:20]
    want = changes.tracked(spark.createDataFrame(first, SCHEMA)).select("operation", "path", "old")
    assert sorted(tuple(x[2:]) for x in whole if x[:2] == ("x", 0)) == sorted(map(tuple, want.collect()))


def test_a_rename_over_two_batches_and_the_timer(spark, tmp_path):
    rows = [("x", 0, "modified", "a", "u"), ("x", 1, "old_name", "a", None), ("x", 2, "new_name", "b", None), ("x", 3, "modified", "b", "v"), ("y", 4, "add", "/WhatsApp/msg.db", None), (None, 5, "add", "c", None), ("x", 6, "odd", "c", None)]
    got = streamed(spark, tmp_path, "t", rows, [2, 3], 50, seconds=1, wait=25)
    # The halves of the rename lie in two batches. The timer may end before or after the modification that follows.
    ops = {x[2:] for x in got if x[0] == "x"}
    assert {("rename", "b", "a"), ("delete", "b", ""), ("add", "b", "")} == ops or {("delete", "a", ""), ("add", "b", "")} == ops
    assert [x for x in got if x[0] == "y"] == [("y", 0, "delete", "/WhatsApp/msg.db", "")] and {x[0] for x in got} == {"x", "y"}
