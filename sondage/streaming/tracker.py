"""Tracking of change events over micro-batches, with state.

Each folder keeps, from batch to batch, what is pending for its paths (first action, first old path, whether content was modified), the content
hashes it has seen, the event before, so that a rename whose halves lie in two batches is one, and how many events are pending. They are
flushed when there are `events` of them, in the middle of a batch or not, and `seconds` after the first of them at the latest. So
the flushes are the same wherever the stream is cut into batches. The rules are those of changes.tracked().

A folder is a watched root: its events depend on each other's order and go to one state. Pending paths and hashes are rows of a state
store, so a folder's size is bounded by its executor's disk. Rows of a batch are taken in the order of seq; a batch's bound is its source's.
The session needs spark.sql.streaming.stateStore.providerClass set to that of RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import private_database
from .changes import ADD, MODIFIED, NEW_NAME, OLD_NAME, REMOVE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Pending events, and seconds since the first of them, at which a folder is flushed.
EVENTS, SECONDS = 50, 1800
OUTPUT = "folder string, flush long, operation string, path string, old string"
RENAME = "rename"


class Tracker(StatefulProcessor):
    def __init__(self, events: int = EVENTS, seconds: int = SECONDS):
        self.events, self.milliseconds = events, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "first string, old string, modified boolean")
        self.contents = handle.getMapState("contents", "path string", "content string")
        self.folder = handle.getValueState("folder", "count int, flushes long, event string, path string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, flushes, event_before, before = self.folder.get() if self.folder.exists() else (0, 0, None, None)
        out: list[tuple] = []
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable").astype(object)
        batch = batch.where(batch.notna(), None)
        for path, event, content, private in zip(batch["path"], batch["event"], batch["content"], batch["private"], strict=True):
            if not count:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.milliseconds)
            self._record(path, REMOVE if private else event, content, private, event_before, before)
            count, event_before, before = count + 1, REMOVE if private else event, path
            if count >= self.events:
                out += self._flush(key[0], flushes)
                count, flushes = 0, flushes + 1
        self.folder.update((count, flushes, event_before, before))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        count, flushes, event_before, before = self.folder.get()
        # A timer whose events were flushed by number has nothing to do, unless new ones have come; those flush with their own timer.
        later = [t for t in self.handle.listTimers() if t > expiredTimerInfo.getExpiryTimeInMs()]
        out: list[tuple] = []
        if count and not later:
            out = self._flush(key[0], flushes)
            self.folder.update((0, flushes + 1, event_before, before))
        yield self._frame(out)

    def _state(self, path: str) -> tuple:
        return self.pending.getValue((path,)) if self.pending.containsKey((path,)) else (None, None, False)

    def _record(self, path: str, event: str, content: str | None, private: bool, event_before: str | None, before: str | None) -> None:
        name = lambda p: p.rsplit("/", 1)[-1]
        moved = event == NEW_NAME or (event == REMOVE and not private and event_before == ADD and name(before) == name(path))
        if moved and before not in (None, path):
            self._move(before, path)
        elif event == REMOVE:
            self.pending.updateValue((path,), (REMOVE, None, False))
        elif event == ADD:
            first, old, modified = self._state(path)
            self.pending.updateValue((path,), (first or ADD, old, modified))
        elif event == MODIFIED:
            first, old, _ = self._state(path)
            known = self.contents.getValue((path,))[0] if self.contents.containsKey((path,)) else None
            differs = known is not None and content is not None and known != content
            self.pending.updateValue((path,), (first, old, differs))
            if content is not None:
                self.contents.updateValue((path,), (content,))

    def _move(self, source: str, path: str) -> None:
        """What is pending for the source goes on under the new path: an addition stays one, a rename keeps its first old path."""
        came = self._state(source)
        brought = came if came[0] in (ADD, RENAME) else (RENAME, source, False)
        first, old, modified = self._state(path)
        self.pending.updateValue((path,), (first or brought[0], old if first else brought[1], modified or came[2]))
        if self.pending.containsKey((source,)):
            self.pending.removeKey((source,))
        if self.contents.containsKey((source,)):
            self.contents.updateValue((path,), self.contents.getValue((source,)))
            self.contents.removeKey((source,))

    def _flush(self, folder: str, number: int) -> list[tuple]:
        out = []
        for (path,), (first, old, modified) in list(self.pending.iterator()):
            if first == REMOVE or (first is None and modified):
                out.append((folder, number, "delete", path, ""))
            elif first == RENAME and modified:
                out.append((folder, number, "delete", old, ""))
            if first == ADD or (modified and first in (None, RENAME)):
                out.append((folder, number, "add", path, ""))
            elif first == RENAME:
                out.append((folder, number, "rename", path, old))
        self.pending.clear()
        return out

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["folder", "flush", "operation", "path", "old"])

    def close(self) -> None:
        pass


def flushes(events: DataFrame, count: int = EVENTS, seconds: int = SECONDS) -> DataFrame:
    """Flushes of a stream of events (folder, seq, event, path, content), numbered within each folder. Rows with a null folder, path or event are no events."""
    own = events.select("folder", "seq", "event", "path", "content", F.coalesce(private_database(F.col("path")), F.lit(False)).alias("private"))
    own = own.where(F.col("event").isin(ADD, REMOVE, MODIFIED, OLD_NAME, NEW_NAME)).dropna(subset=["folder", "path"])
    return own.groupBy("folder").transformWithStateInPandas(Tracker(count, seconds), OUTPUT, "Append", "ProcessingTime")
