"""A corpus pipeline of five stages: rejection by quality, removal of boilerplate lines, of near copies and of repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents, whatever their names.
Null and empty texts fail the quality rules and go. Rows without an id are
judged, cut and packed like others, and stay in the n-gram join unless a class
with an id holds them; repeated rows become one there. Very long texts are
handled whole. Empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import line_dedup, packing, quality, set_join, substrings
from sondage.llm.common import discard, materialise, small_batches, table


def _apart(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator reads, the rest in a struct, so that no name of its results meets one of the documents'."""
    return docs.select(*columns, F.struct(*(f"`{c}`" for c in docs.columns if c != "text")).alias("row"))


def _together(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs with the changed text, n_chars counted anew."""

    def column(c: str):
        own = F.col("row").getField(c)
        return F.coalesce(F.char_length("text").cast(docs.schema[c].dataType), own) if c == "n_chars" else own

    return changed.select(*(F.col("text") if c == "text" else column(c).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or score below the threshold go."""
    return _together(quality.judge(_apart(docs, "doc_id", "text"), table(spark, sf_dir, "labels")).where("kept"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats on many of its documents go; the source is the host."""
    return _together(line_dedup.dedup(_apart(docs, "source", "text"), host="source"), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 over five-word shingles, the smallest id stays."""
    small_batches(spark)
    return set_join.dedup(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in a document with a smaller id go; documents stay."""
    small_batches(spark)
    return _together(substrings.dedup(_apart(docs, "doc_id", "text")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 1024."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", pack),
]

#: SQL cannot express the quality score's hashes or the packing; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
