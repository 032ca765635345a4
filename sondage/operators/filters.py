"""Predicates over files, as columns, and the order a query asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions import lists
from sondage.functions.text import basename, extension, glob_regex

from .parser import Bounds, Query


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def has_extension(path: Column, wanted: list[str]) -> Column:
    return extension(path).isin(wanted)


def name_like(path: Column, glob: str) -> Column:
    return F.lower(basename(path)).rlike(glob_regex(glob.lower()))


def name_lacks(path: Column, terms: list[str]) -> Column:
    return ~_any([F.contains(F.lower(basename(path)), F.lit(t)) for t in terms])


def within(value: Column, bounds: Bounds) -> Column:
    """Both ends count; a file of which nothing is known passes."""
    low, high = bounds
    inside = F.lit(True)
    if low is not None:
        inside = inside & (value >= low)
    if high is not None:
        inside = inside & (value <= high)
    return value.isNull() | inside


def under(path: Column, folder: str) -> Column:
    """The folder itself or anything below it, whatever the case and the slashes."""
    f = folder.replace("\\", "/").rstrip("/").lower()
    p = F.lower(F.translate(path, "\\", "/"))
    return (p == f) | p.startswith(f + "/")


def in_scope(path: Column, included: list[str], excluded: list[str]) -> Column:
    inside = _any([under(path, d) for d in included]) if included else F.lit(True)
    return inside & ~_any([under(path, d) for d in excluded])


def private_database(path: Column) -> Column:
    p = F.lower(F.translate(path, "\\", "/"))
    return basename(p).isin(lists.PRIVATE_NAMES) | ((extension(p) == ".db") & F.contains(p, F.lit(lists.PRIVATE_FOLDER)))


def junk(path: Column) -> Column:
    name = F.lower(basename(path))
    return private_database(path) | name.isin(lists.JUNK_NAMES) | extension(path).isin(lists.JUNK_EXTENSIONS)


def _folders(path: Column) -> Column:
    return F.split(F.lower(F.translate(path, "\\", "/")), "/")


def skipped_by_scan(path: Column) -> Column:
    """In a folder that the scan does not enter, or in a module cache."""
    folders = F.slice(_folders(path), 1, F.size(_folders(path)) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, lists.SKIPPED_FOLDERS + lists.SCAN_ONLY))) | F.contains(F.lower(F.translate(path, "\\", "/")), F.lit(lists.MODULE_CACHE))


def skipped_by_watcher(path: Column) -> Column:
    listed = F.array(*map(F.lit, lists.SKIPPED_FOLDERS + lists.WATCH_ONLY))
    return F.arrays_overlap(_folders(path), listed) | F.exists(_folders(path), lambda s: s.startswith(".") | s.startswith("ntuser"))


def too_large(size: Column) -> Column:
    return size > lists.MAX_CONTENT_BYTES


def offline(attributes: Column) -> Column:
    return attributes.bitwiseAND(lists.OFFLINE_BITS) != 0


def size_facet(size: Column) -> Column:
    mb = size / F.lit(1024.0 * 1024.0)
    return F.when(mb < 1, "< 1 MB").when(mb <= 10, "1 MB - 10 MB").when(mb <= 100, "10 MB - 100 MB").otherwise("> 100 MB")


def matching(q: Query, path: Column, size: Column, mtime: Column, ctime: Column, atime: Column) -> Column:
    """All filters of a query."""
    out = within(size, q.size) & within(mtime, q.modified) & within(ctime, q.created) & within(atime, q.accessed)
    if q.extensions:
        out = out & has_extension(path, q.extensions)
    if q.name:
        out = out & name_like(path, q.name)
    if q.excluded:
        out = out & name_lacks(path, q.excluded)
    return out


def ordered(rows: DataFrame, sort: str) -> DataFrame:
    """rows in the order asked for; by score where none or an unknown one is."""
    keys = {"date": ["mtime"], "modified": ["mtime"], "created": ["ctime"], "size": ["size"]}
    if sort == "name":
        return rows.orderBy(F.lower(basename(F.col("path"))), F.desc("score"), "path")
    return rows.orderBy(*map(F.desc, [*keys.get(sort, []), "score"]), "path")


def valid_feedback(rows: DataFrame) -> DataFrame:
    return rows.where((F.coalesce("query", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != "") & F.col("feedback").isin(-1, 0, 1))


def page(rows: DataFrame, limit: int | None = None, least: float = 0.0, default: int = 20, most: int = 50) -> DataFrame:
    """The first rows by score that reach the least score."""
    n = min(limit if limit and limit > 0 else default, most)
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), "path").limit(n)
