"""Late session merging against a plain replay of every batch."""

from __future__ import annotations

import random

import pytest

from sondage.llm import sessions

SCHEMA = "user long, second long, batch long, h long"


def plain(events, gap):
    out = []
    for user in {e[0] for e in events}:
        own, standing = [e for e in events if e[0] == user], []
        for now in sorted({e[2] for e in own}):
            runs = []
            for e in sorted((e for e in own if e[2] <= now), key=lambda e: e[1]):
                if runs and e[1] - runs[-1][-1][1] <= gap:
                    runs[-1].append(e)
                else:
                    runs.append([e])
            for r in runs:
                new, lo, hi = sum(e[2] == now for e in r), r[0][1], r[-1][1]
                if not new:
                    continue
                gone = [v for v in standing if lo <= v[2] and v[3] <= hi]
                standing = [v for v in standing if v not in gone]
                for v in gone:
                    v[8:] = [now, lo]
                v = [user, now, lo, hi, len(r), new, len(gone), sum(e[3] for e in r), None, None]
                out.append(v)
                standing.append(v)
    return sorted((tuple(v) for v in out), key=lambda v: v[:3])


def got(df, gap, **more):
    return sorted((tuple(r) for r in sessions.merge(df, gap, **more).collect()), key=lambda v: v[:3])


def test_dilation_joins_at_the_gap_and_not_beyond():
    for gap in (1, 2, 3, 7, 8, 240):
        for apart in (gap, gap + 1):
            wide = sessions.dilated(1 | 1 << apart, gap)
            assert (bin(wide).count("01") + 1 == 1) == (apart <= gap)


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_arrival(spark, seed):
    """Sessions over many small blocks, users of all densities, repeated rows, negative seconds, arrivals long after their time."""
    r = random.Random(seed)
    gap = [240, 1, 7][seed]
    events = [(r.randrange(6), r.randrange(-30 * gap, [300, 30, 60][seed] * gap), r.randrange(12), r.randrange(1 << 32)) for _ in range(600)]
    events += [(7, t, r.randrange(5), t) for t in range(0, 200 * gap, max(1, gap - 1))] + events[:40]
    df = spark.createDataFrame(events, SCHEMA)
    assert got(df, gap, block=2 * gap + 1 + seed) == plain(events, gap) == got(df, gap)


def test_hot_user_and_long_session(spark):
    """One user has nearly all rows: a session of many blocks, and copies of one event."""
    events = [(1, t, t // 1800, t) for t in range(0, 120_000, 60)] + [(1, 500_000, 3, 9)] * 3000 + [(2, 5, 0, 1)]
    want = plain(events, 240)
    assert got(spark.createDataFrame(events, SCHEMA).repartition(8), 240) == want
    assert max(v[4] for v in want) == 3000


def test_nulls_empty_and_clashing_columns(spark):
    assert got(spark.createDataFrame([], SCHEMA), 5) == []
    rows = [(1, 10, 0, None, 9, True), (None, 1, 0, 1, 9, True), (1, None, 0, 1, 9, True), (1, 1, None, 1, 9, True)]
    df = spark.createDataFrame(rows, SCHEMA + ", block long, open boolean")
    assert got(df, 5) == [(1, 0, 10, 10, 1, 1, 0, 0, None, None)]
    with pytest.raises(ValueError):
        sessions.merge(df, 0)
