"""A walk of folders as a data source of Spark's, for batches and streams.

Folders whose names are skipped aren't entered. The driver lists from the root down until there are `folders` of them (or none further down); each of
these is a partition, walked by a task, so that a tree is listed in parallel. A file is opened only if its extension is asked for and its size is
within the limit. The root must be a path that all executors see. Links to folders aren't followed; what vanishes or can't be
read meanwhile is left out.

    spark.dataSource.register(Walk)
    spark.read.format("walk").option("root", folder).option("contents", ".txt,.md").load()

As a stream it gives the files changed since the last batch, by the later of the times of content and of metadata, in nanoseconds. A
file that changes in the very moment of a listing may come again in the next batch, and is never missed.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sondage.functions import lists

SCHEMA = "path string, size long, mtime long, ctime long, atime long, content binary"
FOLDERS, DEPTH = 64, 4
#: What a listing may be behind its clock: times of files may be coarser than it.
MARGIN_NS = 2_000_000_000
SKIPPED = frozenset(lists.SKIPPED_FOLDERS + lists.SCAN_ONLY)


@dataclass
class Folder(InputPartition):
    """A folder to be walked, with or without what lies below it, and the times of change (above, up to) that are asked for."""

    path: str
    below: bool
    after: int = -1
    until: int = 1 << 62


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _enters(entry: os.DirEntry, skipped: frozenset[str]) -> bool:
    inside = (entry.path.replace("\\", "/") + "/").lower()
    return entry.is_dir(follow_symlinks=False) and entry.name.lower() not in skipped and not inside.endswith(lists.MODULE_CACHE)


def frontier(root: str, folders: int = FOLDERS, depth: int = DEPTH, skipped: frozenset[str] = SKIPPED, entries: Callable = _entries) -> list[Folder]:
    """Folders that together make the tree below root: those above the frontier without, those on it with what lies below."""
    done, edge = [], [root]
    for _ in range(depth):
        if not edge or len(edge) >= folders:
            break
        done += [Folder(f, False) for f in edge]
        edge = [e.path for f in edge for e in entries(f) if _enters(e, skipped)]
    return done + [Folder(f, True) for f in edge]


def walked(part: Folder, contents: frozenset[str], limit: int, skipped: frozenset[str] = SKIPPED, entries: Callable = _entries, opened: Callable = open) -> Iterator[tuple]:
    """Rows of a partition."""
    todo = [part.path]
    while todo:
        for e in entries(todo.pop()):
            try:
                if part.below and _enters(e, skipped):
                    todo.append(e.path)
                if not e.is_file(follow_symlinks=False):
                    continue
                s = e.stat(follow_symlinks=False)
                if not part.after < max(s.st_mtime_ns, s.st_ctime_ns) <= part.until:
                    continue
                data = None
                if os.path.splitext(e.name)[1].lower() in contents and s.st_size <= limit:
                    with opened(e.path, "rb") as f:
                        data = f.read()
            except OSError:
                continue
            yield e.path, s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_atime_ns, data


class _Options:
    def __init__(self, options):
        self.root = options["root"]
        self.contents = frozenset(x.strip().lower() for x in options.get("contents", "").split(",") if x.strip())
        self.limit = int(options.get("limit", lists.MAX_CONTENT_BYTES))
        self.folders = int(options.get("folders", FOLDERS))

    def read(self, partition: Folder) -> Iterator[tuple]:
        return walked(partition, self.contents, self.limit)


class WalkReader(_Options, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return frontier(self.root, self.folders)


class WalkStream(_Options, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": time.time_ns() - MARGIN_NS}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(f.path, f.below, start["changed"], end["changed"]) for f in frontier(self.root, self.folders)]


class Walk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalkReader:
        return WalkReader(self.options)

    def streamReader(self, schema) -> WalkStream:
        return WalkStream(self.options)
