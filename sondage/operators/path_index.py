"""An index of paths: postings of their words for the ranked channels, and of their grams for substrings.

Grams are the distinct runs of three and of two characters of a lower-cased path with an end mark, so that every word of one character or more
begins a gram. A word of four characters or more is looked up by its rarest grams, of which a table of counts tells; shorter words are a gram or
the beginning of some. The paths that hold all of them are candidates, and the path, which stands in the postings, decides. Tasks write
the postings of the paths that they read as runs in the order of their keys, so that a search reads the pages of its keys, and nothing is shuffled but
counts. The table of paths isn't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25
from .postings import GROUP_BYTES, entries, runs, starts

END, RAREST = "\n", 3
_POSTED = "gram string, n long, paths array<string>"


def grams(lowered: str) -> list[str]:
    """Distinct grams of a lower-cased path."""
    whole = lowered + END
    return list({whole[i : i + n] for n in (2, 3) for i in range(len(whole) - n + 1)})


def _run(rows: pa.RecordBatch) -> pa.RecordBatch:
    e = entries(rows.column("t"))
    group = starts(e.token) if len(e.token) else np.zeros(1, np.int32)
    paths = pa.ListArray.from_arrays(pa.array(group), rows.column("path").take(pa.array(e.row)))
    return pa.RecordBatch.from_arrays([e.words, pa.array(np.diff(group).astype(np.int64)), paths], ["gram", "n", "paths"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = ([b.column("path"), pa.array([grams(p) for p in b.column("low").to_pylist()], pa.list_(pa.string()))] for b in batches)
    yield from runs(_run)(pa.RecordBatch.from_arrays(columns, ["path", "t"]) for columns in own)


@dataclass
class PathIndex:
    """words: the index of the paths' tokens; posted: gram, n, paths of each run; counts: gram, n."""

    words: bm25.Index
    posted: DataFrame
    counts: DataFrame

    def save(self, folder: str) -> None:
        self.words.save(f"{folder}/words")
        self.posted.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{folder}/grams")
        kept = self.posted.sparkSession.read.schema(_POSTED).parquet(f"{folder}/grams")
        kept.groupBy("gram").agg(F.sum("n").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/counts")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> PathIndex:
        return PathIndex(bm25.Index.load(spark, f"{folder}/words"), spark.read.schema(_POSTED).parquet(f"{folder}/grams"), spark.read.parquet(f"{folder}/counts"))

    @property
    def postings(self) -> DataFrame:
        return self.posted.select("gram", F.explode("paths").alias("path"))

    def holding(self, words: list[str]) -> DataFrame:
        """Distinct paths that contain one of the words, lower-cased."""
        words = sorted({w.lower() for w in words if w})
        if not words:
            return self.postings.select("path").limit(0)
        long = {w: sorted({w[i : i + 3] for i in range(len(w) - 2)}) for w in words if len(w) > 3}
        asked = sorted({g for own in long.values() for g in own})
        known = {r["gram"]: r["n"] for r in self.counts.where(F.col("gram").isin(asked)).collect()} if asked else {}  # a row for each gram of the words
        wanted, holds, gram = F.lit(False), F.lit(False), F.col("gram")
        for w in words:
            if len(w) <= 3:
                own = gram == w if len(w) > 1 else gram.startswith(w)
                wanted, needed = wanted | own, [own]
            elif all(g in known for g in long[w]):
                rare = sorted(long[w], key=lambda g: (known[g], g))[:RAREST]
                wanted, needed = wanted | gram.isin(rare), [gram == g for g in rare]
            else:
                continue
            every = F.lit(True)
            for n in needed:
                every = every & F.bool_or(n)
            holds = holds | every & F.contains(F.lower("path"), F.lit(w))
        return self.postings.where(wanted).groupBy("path").agg(holds.alias("_h")).where("_h").select("path")


def indexed(paths: DataFrame) -> PathIndex:
    """The index of the distinct paths of a table."""
    own = paths.select("path").where("path is not null").distinct()
    posted = own.select("path", F.lower("path").alias("low")).mapInArrow(_posted, _POSTED)
    return PathIndex(bm25.indexed(own, "path", ["path"]), posted, posted.groupBy("gram").agg(F.sum("n").alias("n")))
