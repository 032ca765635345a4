"""Chunks of texts, and the passages of a text around a query's words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ["\n\n", "\n", " ", ""]
SNIPPET = 800


def split_text(text: str, size: int = 512, overlap: int | None = None, separators: list[str] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters, cut at the coarsest separator that does, each beginning with up to overlap characters of the one before."""
    overlap = size // 5 if overlap is None else overlap
    if len(text) <= size:
        return [text] if text else []
    mark, *finer = next((separators[i:] for i, s in enumerate(separators) if not s or s in text), [""])
    pieces = text.split(mark) if mark else [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))]
    if not mark:
        return pieces
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held and (joined := mark.join(held).strip()):
            out.append(joined)

    for piece in pieces:
        if len(piece) > size:
            close()
            held.clear()
            out += split_text(piece, size, overlap, finer or [""])
            continue
        if held and len(mark.join([*held, piece])) > size:
            close()
            while held and (len(mark.join(held)) > overlap or len(mark.join([*held, piece])) > size):
                held.pop(0)
        held.append(piece)
    close()
    return out


def chunks(docs: DataFrame, size: int = 512, overlap: int | None = None) -> DataFrame:
    """(path, chunk_no, content, last) of (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in b[["path", "content"]].itertuples(index=False):
                own = split_text(content or "", size, overlap)
                rows += [(path, i, c, i == len(own) - 1) for i, c in enumerate(own)]
            yield pd.DataFrame(rows, columns=["path", "chunk_no", "content", "last"])

    return docs.select("path", "content").mapInPandas(run, "path string, chunk_no int, content string, last boolean")


def snippets(content: str, query: str, most: int, size: int = SNIPPET) -> list[str]:
    """Up to most windows of size bytes, each around a word of the query that no earlier window covers; the head of the text if no word is found.

    A character that an edge of a window cuts is left out of it."""
    data = content.encode()
    if not data or most <= 0:
        return []
    if len(data) <= size:
        return [content]
    low = content.lower().encode()
    places = []
    for word in (w.encode() for w in query.lower().split()):
        at = low.find(word) if len(word) > 1 else -1
        while at >= 0:
            places.append(at)
            at = low.find(word, at + len(word))
    if len(low) != len(data):
        # Some letters change their length in lower case: places are those of the text itself.
        sizes = [(len(c.encode()), len(c.lower().encode())) for c in content]
        starts = [0, *accumulate(n for n, _ in sizes)]
        of_low = [starts[i] for i, (_, n) in enumerate(sizes) for _ in range(n)]
        places = [of_low[p] if p < len(of_low) else len(data) for p in places]
    found, covered = [], -1
    for place in sorted(places) or [0]:
        if place >= covered and len(found) < most:
            start = max(0, min(place - size // 2, len(data) - size))
            covered = start + size
            found.append(data[start:covered].decode("utf-8", "ignore"))
    return found


def with_snippets(rows: DataFrame, query: str, most: int = 1, content: str = "content") -> DataFrame:
    """rows with an array of snippets."""

    @F.pandas_udf("array<string>")
    def made(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: snippets(t, query, most))

    return rows.withColumn("snippets", made(F.col(content)))
