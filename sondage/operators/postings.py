"""Postings made where the rows are: a task sorts the words of some rows at a time and writes them as a run, and nothing is shuffled.

A run is in the order of its keys, so a search reads, of each run, the pages that hold its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a task sorts at a time, more only for a longer row; bytes of a row group, so that the keys of rows in it fit a dictionary.
RUN_WORDS, GROUP_BYTES = 1_000_000, 16 << 20


@dataclass
class Entries:
    """By token and row: number of the token in words (sorted), row, how often and where the row holds it."""

    words: pa.Array
    token: np.ndarray
    row: np.ndarray
    f: np.ndarray
    at: pa.ListArray


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where equal values begin, and their end."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.append(np.flatnonzero(new), len(new)).astype(np.int32)


def entries(t: pa.ListArray) -> Entries:
    sizes = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False)
    found = t.flatten().dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    token = rank[found.indices.to_numpy()]
    by = np.argsort(token * len(sizes) + row, kind="stable")
    token, row, place = token[by], row[by], place[by]
    of = starts(token, row)
    at = pa.ListArray.from_arrays(pa.array(of), pa.array(place.astype(np.int32)))
    return Entries(found.dictionary.take(pa.array(order)), token[of[:-1]], row[of[:-1]], np.diff(of), at)


def runs(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """make applied to slices of batches with a column t of tokens."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, start = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("t")), 0).to_numpy(zero_copy_only=False)), 0
            while start < batch.num_rows:
                before = sums[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sums, before + RUN_WORDS, "right")))
                yield make(batch.slice(start, stop - start))
                start = stop

    return each


def by_token(rows: pa.RecordBatch) -> pa.RecordBatch:
    """token, n, words, held (the rows' other columns, and at) of some rows; first the number of rows and of their words, without a token."""
    e = entries(rows.column("t"))
    group = starts(e.token) if len(e.token) else np.zeros(1, np.int32)
    others = [c for c in rows.schema.names if c != "t"]
    at_row = pa.array(e.row)
    held = pa.StructArray.from_arrays([*(rows.column(c).take(at_row) for c in others), e.at], [*others, "at"])
    n = np.diff(group)
    tokens = pa.concat_arrays([pa.nulls(1, pa.string()), e.words.cast(pa.string())])
    counts = pa.array(np.append([rows.num_rows], n).astype(np.int64))
    words = pa.array(np.append([e.f.sum()], np.add.reduceat(e.f, group[:-1]) if len(n) else []).astype(np.int64))
    return pa.RecordBatch.from_arrays([tokens, counts, words, pa.ListArray.from_arrays(pa.array(np.append([0], group).astype(np.int32)), held)], ["token", "n", "words", "held"])
