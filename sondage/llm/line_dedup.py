"""Line dedup by site-relative frequency.

Pages are grouped by host. The pages that contain a line are divided by the
host's page total; from percent / 100 on, and on at least min_pages pages, the
line is boilerplate. Boilerplate lines are dropped from every page of the host,
the other lines stay in order. With distinct=True, pages of a host with equal
texts count as one page, in both numbers.

Lines are compared without white space at their ends; lines without a word are
never dropped, and a line repeated on a page counts once. Null hosts are one
host. Null texts stay null and aren't pages, empty ones stay empty; repeated
rows are treated alike; an empty table gives an empty one. Very long texts cost
time in proportion to their lines, and to their boilerplate lines. A result
column whose name the table has already is given an underscore more.

A line is known by 128 bits of hash. Counting shuffles these, not texts, and no
host or line is one group: counts are summed before they are shuffled. A host
has at most 100 / percent times its mean lines per page of such lines, so their
list goes along with the host's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

#: Share of a host's pages from which a line is boilerplate, in percent, and the least number of pages: two may be a copy, three are a habit.
PERCENT, MIN_PAGES = 7, 3
#: Up to this many boilerplate lines (about 24 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 50_000
_SPACE = " \t\x0b\x0c\r"


def _key(line: Column) -> Column:
    own = F.btrim(line, F.lit(_SPACE))
    return F.struct(F.xxhash64(own).alias("a"), F.xxhash64(F.lit(1), own).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE)) != ""


def _name(key: Column) -> Column:
    """A key as a string: array functions find strings by hashing."""
    return F.concat_ws(":", key["a"], key["b"])


def boilerplate(pages: DataFrame, host: str, text: str, percent: int = PERCENT, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """(host, lines): names of the boilerplate lines of each host that has any."""
    page = pages.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("page"), F.col(text).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _has_word), _key))
    hosts, lines = page.select("host", "page"), page.select("host", "page", F.explode(keys).alias("line"))
    if distinct:
        hosts, lines = hosts.distinct(), lines.distinct()
    total = hosts.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "of")
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).join(total, F.col("host").eqNullSafe(F.col("of")))
    return often.where(F.col("n") * 100 >= F.col("pages") * percent).groupBy("host").agg(F.collect_list(_name(F.col("line"))).alias("lines"))


def dedup(pages: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """pages, its text without the boilerplate lines, with n_lines (before) and n_dropped."""
    n_lines, n_dropped, of, drop, own, stays = unused(pages.columns, "n_lines", "n_dropped", "host", "drop", "own", "stays")
    known = materialise(boilerplate(pages, host, text, percent, min_pages, distinct), "boilerplate").toDF(of, drop)
    size = known.agg(F.sum(F.size(drop))).first()[0] or 0
    joined = pages.join(F.broadcast(known) if size <= BROADCAST_ROWS else known, F.col(f"`{host}`").eqNullSafe(F.col(of)), "left")
    lines = _lines(F.col(f"`{text}`"))
    # The page's own boilerplate lines, found by hashing in the host's list, are few; each of its lines is looked up among them.
    made = joined.withColumn(own, F.array_intersect(F.transform(lines, lambda x: _name(_key(x))), F.col(drop)))
    made = made.withColumn(stays, F.when(F.coalesce(F.size(own), F.lit(0)) == 0, lines).otherwise(F.filter(lines, lambda x: ~_has_word(x) | ~F.array_contains(F.col(own), _name(_key(x))))))
    count = lambda c: F.when(F.col(f"`{text}`").isNull(), 0).otherwise(c).cast("long")
    return made.select(
        *(F.array_join(stays, "\n").alias(c) if c == text else f"`{c}`" for c in pages.columns),
        count(F.size(lines)).alias(n_lines),
        count(F.size(lines) - F.size(stays)).alias(n_dropped),
    )
