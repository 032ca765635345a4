"""The walk as a data source: folders entered, files opened, times, streams."""

import os
import time

from sondage.sources import walk
from sondage.sources.walk import Walk


def tree(root, files):
    for name in files:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())


FILES = ["a.txt", "b.PNG", "src/c.md", "src/deep/er/d.txt", "node_modules/e.txt", "src/.git/f.txt", "go/pkg/mod/g.txt", "go/pkg/h.txt", "src/big.txt", "Steam/i.txt"]
KEPT = ["a.txt", "b.PNG", "src/c.md", "src/deep/er/d.txt", "go/pkg/h.txt", "src/big.txt"]


def test_folders_entered_and_files_opened(tmp_path):
    tree(tmp_path, FILES)
    entered, opened = [], []

    def entries(folder):
        entered.append(os.path.relpath(folder, tmp_path))
        return walk._entries(folder)

    def opener(path, mode):
        opened.append(os.path.relpath(path, tmp_path))
        return open(path, mode)

    for folders in (1, 2, 3, 100):
        entered.clear()
        opened.clear()
        parts = walk.frontier(str(tmp_path), folders, entries=entries)
        rows = [r for p in parts for r in walk.walked(p, frozenset([".txt"]), 9, entries=entries, opened=opener)]
        assert sorted(os.path.relpath(r[0], tmp_path) for r in rows) == sorted(KEPT)
        assert set(entered) == {".", "src", "src/deep", "src/deep/er", "go", "go/pkg"}
        # By extension and size.
        assert opened == ["a.txt"] and [r[-1] for r in rows if r[-1] is not None] == [b"a.txt"]
    assert [p.path for p in walk.frontier(str(tmp_path / "none"))] == [str(tmp_path / "none")]


def test_reading(spark, tmp_path):
    tree(tmp_path, FILES)
    os.utime(tmp_path / "a.txt", ns=(5_000_000_000, 7_000_000_007))
    spark.dataSource.register(Walk)
    read = lambda **o: spark.read.format("walk").options(root=str(tmp_path), **o).load()
    got = {os.path.relpath(r["path"], tmp_path): r for r in read(contents=".txt, .md", folders="2").collect()}
    assert set(got) == set(KEPT)
    assert (got["a.txt"]["mtime"], got["a.txt"]["atime"], bytes(got["a.txt"]["content"])) == (7_000_000_007, 5_000_000_000, b"a.txt")
    assert got["b.PNG"]["content"] is None and got["b.PNG"]["size"] == 5
    assert read().where("content is not null").count() == 0


def test_stream_of_changes(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "root", str(tmp_path / "out")
    tree(root, ["a.txt", "b.txt"])
    spark.dataSource.register(Walk)
    seen = []
    for step in range(2):
        time.sleep(2.5)  # beyond the margin
        stream = spark.readStream.format("walk").option("root", str(root)).load()
        q = stream.select("path").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(60)
        finally:
            q.stop()
        seen.append(sorted(os.path.basename(r["path"]) for r in spark.read.schema("path string").parquet(out).collect()))
        (root / "b.txt").write_text("changed")
        tree(root, ["new/c.txt"])
    assert seen == [["a.txt", "b.txt"], ["a.txt", "b.txt", "b.txt", "c.txt"]]
