"""Sessions of events that arrive late, in batches, with every version that a batch gives a session.

After each batch a user's events so far form sessions: neighbours in time at most `gap` seconds apart share one. A session that
holds an event of the batch is a new version; it retracts the standing versions it contains.

Method: the seconds at which a user has events are the bits of one big integer. A batch is OR-ed into it, the integer is dilated
by the gap with doubling shifts, the runs of bits that hold an arrival are cut out, and counts come from prefix sums over the
sorted seconds. Standing versions are the bits at which the runs before the batch begin.

No user goes to one task. Events are first added up by user, second and batch; then a user's time is cut into blocks of `block`
seconds, each with the events up to a gap beyond its edges. What is one session in the end and lies within a block is finished
there. A session that reaches an edge goes on as one interval for each of its runs and batches, to blocks `FAN` times as long
whose edges lie elsewhere, until no session is left: some three rounds, since blocks soon outlast any session. What one
task reads of a session is then a row for each block and batch that touches it, however many events it has.

Rows with a null user, second or batch are no events; a null weight counts as 0. Repeated rows count each time. Other columns
are left out. An empty table gives an empty one. Seconds may be negative; times need not be near their batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Seconds of a block in the first round, and how many times longer the blocks of each further round are.
BLOCK, FAN = 1 << 14, 64
#: An interval in a block: another block's, its own, or its own with an end beyond it.
_GUEST, _OWN, _CROSSING = 0, 1, 2
VERSION = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s"]
_ROW = pa.schema([*((c, pa.int64()) for c in VERSION), ("open", pa.bool_())])


def dilated(bits: int, gap: int) -> int:
    """bits, each with the gap - 1 above it set as well: runs meet where set bits are at most gap apart."""
    have = 1
    while have < gap:
        step = min(have, gap - have)
        bits |= bits << step
        have += step
    return bits


def versions(starts: list[int], ends: list[int], batches: list[int], counts: list[int], weights: list[int], gap: int) -> list[list]:
    """Versions of what is one session in the end, from its intervals sorted by start; the columns of VERSION without the user."""
    base = starts[0]
    by_batch: dict[int, list[int]] = {}
    for i, b in enumerate(batches):
        by_batch.setdefault(b, []).append(i)
    occupied = standing = 0
    seen_n, seen_h = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    at = np.asarray(starts) - base
    out: list[list] = []
    last: dict[int, int] = {}
    for b in sorted(by_batch):
        arrived = by_batch[b]
        new = 0
        for i in arrived:
            new |= ((1 << ends[i] - starts[i] + 1) - 1) << starts[i] - base
            seen_n[i], seen_h[i] = counts[i], weights[i]
        occupied |= new
        wide = dilated(occupied, gap)
        begins = wide & ~(wide << 1)
        sum_n, sum_h = np.concatenate([[0], np.cumsum(seen_n)]), np.concatenate([[0], np.cumsum(seen_h)])
        own_n = np.concatenate([[0], np.cumsum([counts[i] for i in arrived])])
        own_at = at[arrived]
        while new:
            first = (new & -new).bit_length() - 1
            start = (begins & (1 << first + 1) - 1).bit_length() - 1
            rest = wide >> first
            stop = first + (~rest & rest + 1).bit_length() - 1  # one beyond the run
            new = new >> stop << stop
            end = stop - gap
            lo, hi = np.searchsorted(at, [start, end + 1])
            own_lo, own_hi = np.searchsorted(own_at, [start, end + 1])
            gone = standing >> start & (1 << end - start + 1) - 1
            row = [b, start + base, end + base, int(sum_n[hi] - sum_n[lo]), int(own_n[own_hi] - own_n[own_lo]), gone.bit_count(), int(sum_h[hi] - sum_h[lo]), None, None]
            while gone:
                low = gone & -gone
                out[last[start + low.bit_length() - 1]][7:] = [b, start + base]
                gone ^= low
            last[start] = len(out)
            out.append(row)
        standing = begins
    return out


def _rows(held: pa.RecordBatch, gap: int) -> pa.RecordBatch:
    """Versions of sessions that lie within their blocks; one interval for each run and batch of those that reach an edge."""
    user, block, start, end, batch, n, h = (np.asarray(held.column(c)) for c in ("user", "block", "start", "end", "batch", "n", "h"))
    own = np.asarray(held.column("own"))
    turn = np.flatnonzero((user[1:] != user[:-1]) | (block[1:] != block[:-1])) + 1
    # The latest end so far within a user's block: ends are made to rise from block to block.
    group = np.zeros(len(user), np.int64)
    group[turn] = 1
    group = np.cumsum(group)
    low = int(start.min())
    span = int(end.max()) - low + gap + 2
    latest = np.maximum.accumulate(end - low + group * span)
    cuts = np.flatnonzero((start - low + group * span)[1:] > latest[:-1] + gap) + 1
    cuts = np.union1d(cuts, turn)
    columns: list[list] = [[] for _ in _ROW]
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(user)], strict=True):
        mine = own[lo:hi]
        opened = bool((mine != _OWN).any())
        pick = np.flatnonzero(mine != _GUEST) + lo if opened else slice(lo, hi)
        if opened and not len(pick):
            continue
        s = start[pick].tolist()
        if len(s) == 1:
            found = [[int(batch[pick][0]), s[0], int(end[pick][0]), int(n[pick][0]), int(n[pick][0]), 0, int(h[pick][0]), None, None]]
        elif opened:
            found = _parts(start[pick], end[pick], batch[pick], n[pick], h[pick], gap)
        else:
            found = versions(s, end[pick].tolist(), batch[pick].tolist(), n[pick].tolist(), h[pick].tolist(), gap)
        u = int(user[lo])
        for v in found:
            for c, x in zip(columns, [u, *v, opened], strict=True):
                c.append(x)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def _parts(start: np.ndarray, end: np.ndarray, batch: np.ndarray, n: np.ndarray, h: np.ndarray, gap: int) -> list[list]:
    """An open session's own intervals, one for each run and batch, each with what the batch alone added."""
    of_batch = {b: (start[p], np.concatenate([[0], np.cumsum(h[p])])) for b in np.unique(batch).tolist() if len(p := np.flatnonzero(batch == b))}
    found = []
    cuts = (np.flatnonzero(start[1:] > np.maximum.accumulate(end)[:-1] + gap) + 1).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, len(start)], strict=True):
        for v in versions(*(x[lo:hi].tolist() for x in (start, end, batch, n, h)), gap):
            at, sums = of_batch[v[0]]
            a, b = np.searchsorted(at, [v[1], v[2] + 1])
            found.append([v[0], v[1], v[2], v[4], v[4], 0, int(sums[b] - sums[a]), None, None])
    return found


def _tasks(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            user, block = np.asarray(held.column("user")), np.asarray(held.column("block"))
            before = np.flatnonzero((user != user[-1]) | (block != block[-1]))
            if len(before):
                cut = int(before[-1]) + 1
                yield _rows(held.slice(0, cut), gap)
                held = held.slice(cut)
        if held is not None:
            yield _rows(held, gap)

    return run


def merge(events: DataFrame, gap: int = 240, user: str = "user", second: str = "second", batch: str = "batch", weight: str = "h", block: int = BLOCK) -> DataFrame:
    """Every version of every session, with the columns of VERSION: n_events and h_sum are of all events of the session so far,
    n_new of those of its batch; the retracting version is named by its batch and start, null for versions that stand in the end.
    user, second, batch and weight are whole numbers."""
    if gap < 1 or block <= 2 * gap:
        raise ValueError("gap must be positive, and less than half a block")
    names = {"user": user, "start": second, "batch": batch}
    rows = events.select(*(F.col(c).cast("long").alias(a) for a, c in names.items()), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("h"))
    items = rows.dropna(subset=list(names)).groupBy(*names).agg(F.count("*").alias("n"), F.sum("h").alias("h")).withColumn("end", F.col("start"))
    shift, size, done, used = 0, block, None, []
    while True:

        def at(c, shift=shift, size=size):
            return F.floor((c + shift) / size) if size <= 1 << 40 else F.lit(0)

        reach = items.select("*", F.explode(F.sequence(at(F.col("start") - gap), at(F.col("end") + gap))).alias("block"))
        kind = F.when(F.col("block") != at(F.col("start")), _GUEST).when(F.col("block") != at(F.col("end")), _CROSSING).otherwise(_OWN)
        reach = reach.withColumn("own", kind)
        dealt = reach.select("user", "block", "start", "end", "batch", "n", "h", "own").repartition("user", "block").sortWithinPartitions("user", "block", "start", "end", "batch")
        made = materialise(dealt.mapInArrow(_tasks(gap), ", ".join(f"{f.name} {'boolean' if f.name == 'open' else 'long'}" for f in _ROW)), "sessions")
        discard(*used)
        ready = made.where("NOT open").drop("open")
        done = ready if done is None else done.union(ready)
        left = made.where("open")
        if not left.limit(1).count():
            return done
        items = left.select("user", F.col("start_s").alias("start"), "batch", F.col("h_sum").alias("h"), F.col("n_new").alias("n"), F.col("end_s").alias("end"))
        shift, size = size // 2, size * FAN
