"""Hooks for a caller's model and a caller's extractors; neither comes with the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that a model gets at once.
BATCH = 16


def embedded(rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], column: str = "content", name: str = "vector") -> DataFrame:
    """rows with a vector of each text, by a model that each task loads once; null for null."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for p in parts:
            texts = p.dropna()
            made = [np.asarray(v, float) for i in range(0, len(texts), BATCH) for v in model(texts.iloc[i : i + BATCH].tolist())]
            yield pd.Series(made, index=texts.index, dtype=object).reindex(p.index).map(lambda v: v if isinstance(v, np.ndarray) else None)

    return rows.withColumn(name, run(F.col(column)))


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """(path, content) of files: path, content as bytes. What no extractor reads, or one fails on, has an empty content and is searched by name."""

    @F.pandas_udf("string")
    def run(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([_text(extractors.get("." + p.rsplit(".", 1)[-1].lower() if p else ""), c) for p, c in zip(paths, contents, strict=True)], dtype=object)

    return files.select("path", run("path", "content").alias("content"))


def _text(extract: Callable[[bytes], str] | None, content: bytes | None) -> str:
    if extract is None or content is None:
        return ""
    try:
        return extract(bytes(content))
    except Exception:  # any failure of a caller's extractor
        return ""
