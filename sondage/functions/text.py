"""Column functions over strings and paths. All of them stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _accented() -> tuple[str, str]:
    """Lower-case letters of the basic plane that are one letter with combining marks, and that letter."""
    found = {}
    for c in map(chr, range(0x80, 0x10000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all(map(unicodedata.combining, marks)) and unicodedata.category(c) == "Ll":
            found[c] = base
    return "".join(found), "".join(found.values())


#: Accented letters and what they are compared as.
ACCENTED, PLAIN = _accented()


def fold(s: Column) -> Column:
    """Lower case without accents; ASCII strings are spared the table."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(F.lower(s), ACCENTED, PLAIN))


def tokens(s: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.filter(F.split(fold(s), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def quoted(s: Column) -> Column:
    """A query's words as phrases of a full-text search, any of which may match; a query without a word is one phrase."""
    phrase = lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))
    found = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, phrase), " OR ")).otherwise(phrase(s))


def words(s: Column) -> Column:
    """Lower-cased parts between dashes, underscores, dots, blanks and slashes."""
    return F.filter(F.split(F.lower(s), r"[-_. /]+"), lambda t: t != "")


def percent_decode(s: Column) -> Column:
    """Percent sequences decoded; plus signs and invalid sequences are left alone."""
    return F.when(F.contains(s, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)).otherwise(s)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the last segment on, lower-cased."""
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)


def stem(name: Column) -> Column:
    """A lower-cased name without its extension."""
    return F.regexp_replace(F.lower(name), r"\.[^./]*$", "")


def word_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer; 1 for two empty words. Meant for folded (ASCII) words."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def trigrams(s: Column) -> Column:
    n = F.length(s)
    places = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(s, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if one is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch of a time without zone, read as UTC whatever the session's time zone."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def rfc3339(ns: Column) -> Column:
    """UTC time of nanoseconds since the epoch, in seconds, whatever the session's time zone."""
    at = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.floor(ns / 1_000_000_000).cast("decimal(18,6)"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def human_size(n: Column) -> Column:
    """Bytes in steps of 1024: whole bytes, then one decimal."""
    steps = [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]
    whole = F.concat(n.cast("string"), F.lit(" B"))
    return reduce(lambda rest, s: F.when(n >= s[0], F.format_string("%.1f " + s[1], n / F.lit(float(s[0])))).otherwise(rest), reversed(steps), whole)


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a shell pattern; without special characters it may stand anywhere."""
    import re

    if not any(c in glob for c in "*?["):
        glob = f"*{glob}*"
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            out += glob[i : close + 1]
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"
