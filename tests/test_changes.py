from pyspark.sql import functions as F

from sondage.streaming.changes import ADD, MODIFIED, NEW_NAME, OLD_NAME, REMOVE, lanes, tracked, watch

EVENTS = "folder string, seq long, event string, path string, content string"
CASES = {
    "an addition that is renamed is an addition": ([(ADD, "a/x"), (OLD_NAME, "a/x"), (NEW_NAME, "a/y")], [("add", "a/y", "")]),
    "renames chain to the first path": ([(OLD_NAME, "a"), (NEW_NAME, "b"), (OLD_NAME, "b"), (NEW_NAME, "c")], [("rename", "c", "a")]),
    "a removal clears what came before": ([(ADD, "a"), (MODIFIED, "b", "1"), (REMOVE, "a")], [("delete", "a", "")]),
    "the first action after a removal is the removal": ([(REMOVE, "a"), (ADD, "a"), (MODIFIED, "a", "1")], [("delete", "a", "")]),
    "a removal after an addition of the same name is a move": ([(ADD, "new/x"), (REMOVE, "old/x")], [("add", "old/x", "")]),
    "a removal after an addition of another name isn't": ([(ADD, "new/x"), (REMOVE, "old/y")], [("add", "new/x", ""), ("delete", "old/y", "")]),
    "a touched file isn't modified": ([(MODIFIED, "a", "1"), (MODIFIED, "a", "1")], []),
    "a changed file is": ([(MODIFIED, "a", "1"), (MODIFIED, "a", "2")], [("add", "a", ""), ("delete", "a", "")]),
    "a renamed and changed file is written anew": ([(OLD_NAME, "a"), (NEW_NAME, "b"), (MODIFIED, "b", "1"), (MODIFIED, "b", "2")], [("add", "b", ""), ("delete", "a", "")]),
    "content hashes move along": ([(MODIFIED, "a", "1"), (OLD_NAME, "a"), (NEW_NAME, "b"), (MODIFIED, "b", "1")], [("rename", "b", "a")]),
    "a path can be used again": ([(OLD_NAME, "a"), (NEW_NAME, "b"), (ADD, "a")], [("add", "a", ""), ("rename", "b", "a")]),
    "two files can change names": ([(OLD_NAME, "a"), (NEW_NAME, "t"), (OLD_NAME, "b"), (NEW_NAME, "a"), (OLD_NAME, "t"), (NEW_NAME, "b")], [("rename", "a", "b"), ("rename", "b", "a")]),
    "a private database is always removed": ([(ADD, "/x/whatsapp/a.db"), (MODIFIED, "/x/msgstore.db", "1")], [("delete", "/x/msgstore.db", ""), ("delete", "/x/whatsapp/a.db", "")]),
}


def test_rules(spark):
    rows = [(case, i, e[0], e[1], e[2] if len(e) > 2 else None) for case, (events, _) in CASES.items() for i, e in enumerate(events)]
    got = {case: [] for case in CASES}
    for r in tracked(spark.createDataFrame(rows, EVENTS).repartition(3)).collect():
        got[r["folder"]].append((r["operation"], r["path"], r["old"]))
    assert {case: sorted(plan) for case, plan in got.items()} == {case: plan for case, (_, plan) in CASES.items()}
    assert tracked(spark.createDataFrame([], EVENTS)).count() == 0


def test_hashes_go_from_batch_to_batch(spark):
    first = lanes(spark.createDataFrame([("f", 1, MODIFIED, "a", "1"), ("f", 2, OLD_NAME, "a", None), ("f", 3, NEW_NAME, "b", None)], EVENTS))
    known = first.where("not moved").select("path", F.col("state.content").alias("content"))
    second = spark.createDataFrame([("f", 4, MODIFIED, "b", "2")], EVENTS)
    assert sorted(tuple(r) for r in tracked(second, known=known).collect()) == [("f", "add", "b", ""), ("f", "delete", "b", "")]
    assert tracked(second).count() == 0


def test_watch(spark, tmp_path):
    changes = [("a", "add", 1), ("b", "remove", 2), ("b", "add", 3), ("c", "modified", 4)]
    spark.createDataFrame(changes, "key string, action string, seq long").write.json(str(tmp_path / "in"))
    flushed = []
    stream = spark.readStream.schema("key string, action string, seq long").json(str(tmp_path / "in"))
    watch(stream, lambda plan, n: flushed.extend(tuple(r) for r in plan.select("key", "plan").collect()), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(flushed) == [("a", "add"), ("b", "delete"), ("c", "delete and add")]
