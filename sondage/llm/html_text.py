"""HTML extraction: the main text of pages, by differencing each page with the page of the nearest URL, and by markup.

Every page is put in the order of host and URL path and paired with the page
around it whose path has most in common with its own. The text lines of the two,
menus and all, are aligned by longest common subsequence, and the shared lines
are deleted. Copies and near copies say nothing about what a site repeats, so
neighbours with the same longest line are one run, for which its first page
stands, and a page that shares the longest line of the other is passed over for
the next, as far out as the host goes.

Markup is the second judge. It takes from what differencing leaves the lines of
menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
which may differ from page to page, and it stands up for the lines of an article
or main element, which two articles may share (a quotation, a shared passage).
A line is what stands between two block elements. Within an article a part is
ruled out by its element, or by a class or id that is made of STRONG words and
fillers, unless it holds most of the article; of WEAK words, where a third of it
is links. Other parts with such a word in a class leave their lines in doubt,
and differencing decides. Where there is no article or main element,
differencing decides about all lines that markup doesn't rule out. A page left
without any line keeps those in question.

Null and empty pages have an empty text. Null URLs are one host. Repeated rows
are returned alike; pages of equal paths are ordered by a hash of the row. An
empty table gives an empty one. Unclosed elements and tags cut off at the end of
a page are tolerated. Parsing takes time in proportion to a page's length,
whatever is in it; aligning lines that recur very often takes the product of the
two pages' lines, by 64 at a time. Other columns aren't read.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import materialise

# Elements and words of class and id attributes that say what a part of a page is.
DROPPED = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "dialog", "menu"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "tfoot", "thead", "tr", "ul",
}
STRONG = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "respond", "sidebar", "signup",
    "sponsor", "sponsored", "subscribe", "toolbar",
}
WEAK = {"banner", "login", "modal", "notice", "promo", "recommended", "related", "share", "sharing", "social", "widget"}
WORDS = STRONG | WEAK
# Words that say where or how large a part is, and nothing of what it is.
FILLERS = {
    "area", "bar", "block", "body", "bottom", "box", "container", "content", "inner", "item", "left", "list", "main", "outer", "page", "panel", "post", "reader",
    "right", "section", "site", "slot", "top", "unit", "user", "wrap", "wrapper",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"}
MAIN_WORDS = {"articlebody"}

#: Runs of pages of a chunk in which neighbours are compared, runs on either side that are considered in the first round, growth of both from round to round.
CHUNK, REACH, WIDER = 256, 6, 8
#: Matching places of two pages up to which they are aligned by them; beyond, by bits of integers. Bits of a table that is kept whole.
MATCHES, TABLE = 200_000, 1 << 25
#: A named part is furniture if links make up this share of it; if it holds more than half of the main text and this much, it isn't.
LINKED, LARGE = 1 / 3, 500
#: What markup says of a line: in the main text, open, in doubt, ruled out.
MAIN, OPEN, DOUBT, OUT = range(4)

_MARKUP = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/<>]*+)([^<>\"']*+(?:\"[^\"]*+\"[^<>\"']*+|'[^']*+'[^<>\"']*+)*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CUT = re.compile(r"<[a-zA-Z/][^<]*+\Z")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named(value: str) -> str:
    """What a class or id says of a part: 'strong' or 'weak' if one of its names is nothing but such words, 'doubt' if it holds one, else ''."""
    found = ""
    for name in value.split():
        parts = {x for x in _SPLIT.split(_CAMEL.sub("-", name).lower()) if x}
        if met := parts & WORDS:
            if parts <= WORDS | FILLERS:
                if met & STRONG:
                    return "strong"
                found = "weak"
            found = found or "doubt"
    return found


def _kind(tag: str, attributes: str, inside: bool) -> str:
    """'drop', 'main', 'strong', 'weak', 'doubt' or '' for an element; inside: whether it is in the main text."""
    if tag in DROPPED or (tag == "header" and not inside):
        return "drop"
    kind = "main" if tag in ("article", "main") else ""
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value, low = "".join(values), name.lower()
            if low == "role":
                if value.lower() in ROLES:
                    return "drop"
                kind = "main" if value.lower() == "main" else kind
            elif low == "itemprop":
                kind = "main" if value.lower() in MAIN_WORDS else kind
            elif tag not in ("body", "html", "article", "main") and (said := _named(value)):
                if not inside and said in ("strong", "doubt"):
                    return "drop"
                if kind in ("", "doubt", "weak"):
                    kind = said if said == "strong" or kind != "weak" else kind
    return kind


def lines(page: str) -> list[tuple[int, str]]:
    """(what markup says, line) of every line of text, furniture included; scripts, styles and the like have none."""
    found: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    kinds: Counter[str] = Counter()
    at, end = 0, len(page)
    #: Outermost named parts: what the name says, characters and those of links; the part that each line is in; characters of links not yet in a line.
    parts: list[list] = []
    part_of: list[int] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            if line := " ".join(_html.unescape("".join(held)).split()):
                found.append((OUT if kinds["drop"] else OPEN if not kinds["main"] else DOUBT if kinds["doubt"] else MAIN, line))
                named = kinds["strong"] or kinds["weak"]
                part_of.append(len(parts) - 1 if named else -1)
                if named:
                    parts[-1][1] += len(line)
                    parts[-1][2] += min(linked, len(line))
            held.clear()
        linked = 0

    while at < end:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else end
        if not m and (cut := _CUT.search(page, at)):
            stop = cut.start()
        if stop > at:
            held.append(page[at:stop])
            if opened["a"]:
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            close = page.find("-->", m.end()) if m[0] == "<!--" else page.find(">", m.end())
            at = end if close < 0 else close + (3 if m[0] == "<!--" else 1)
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if opened[tag]:
                if any(kind for kind in _closed(stack, tag)):
                    flush()  # what is closed changes what markup says
                while True:
                    name, kind = stack.pop()
                    opened[name] -= 1
                    kinds[kind] -= 1
                    if name == tag:
                        break
            if tag in ("br", "td", "th"):
                held.append(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?![^\s/>])", re.I).search(page, at)
            shut = page.find(">", close.end()) if close else -1
            at = shut + 1 if shut >= 0 else end
            if tag in BLOCKS:
                flush()
            continue
        if tag in ("br", "td", "th"):
            held.append(" ")
        if tag in VOID or m[3].endswith("/"):
            if tag in BLOCKS:
                flush()
            continue
        kind = _kind(tag, m[3], kinds["main"] > 0)
        if tag in BLOCKS or kind:
            flush()
        if kind in ("strong", "weak") and not kinds["strong"] and not kinds["weak"]:
            parts.append([kind, 0, 0])
        stack.append((tag, kind))
        opened[tag] += 1
        kinds[kind] += 1
    flush()
    return _judged(found, parts, part_of) if parts else found


def _closed(stack: list[tuple[str, str]], tag: str) -> Iterator[str]:
    """Kinds of the elements that the end of a tag closes."""
    for name, kind in reversed(stack):
        yield kind
        if name == tag:
            return


def _judged(found: list[tuple[int, str]], parts: list[list], part_of: list[int]) -> list[tuple[int, str]]:
    """Lines of named parts are ruled out or in doubt, by name, share of links and size."""
    inside = sum(len(line) for place, line in found if place in (MAIN, DOUBT)) or sum(len(line) for place, line in found if place == OPEN)
    said = []
    for kind, size, links in parts:
        bound = kind == "strong" or links >= LINKED * size
        said.append(DOUBT if not bound or (2 * size > inside and size >= LARGE and links < LINKED * size) else OUT)
    return [(place if i < 0 or place == OUT else OUT if said[i] == OUT else DOUBT if place != OPEN else OPEN, line) for (place, line), i in zip(found, part_of, strict=True)]


def in_question(places: list[int]) -> int:
    """What differencing decides about: lines in doubt, or open lines where nothing is main text."""
    return DOUBT if MAIN in places or DOUBT in places else OPEN


def main_text(found: list[tuple[int, str]], shared: frozenset[int] = frozenset()) -> str:
    """The lines that differencing (shared: places of shared lines) and markup leave."""
    asked = in_question([place for place, _ in found])
    own = [(i, place, line) for i, (place, line) in enumerate(found) if place in ((MAIN, DOUBT) if asked == DOUBT else (OPEN,))]
    left = [line for i, place, line in own if place == MAIN or i not in shared]
    return "\n".join(left or [line for *_, line in own])


def common_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b (Hunt and Szymanski, after what is equal at both ends)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(a) - tail, len(a))}
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    often = Counter(b)
    if sum(often[x] for x in a) > MATCHES:
        return out.union(i + head for i in _aligned(a, b))
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    nodes: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    node = nodes[-1] if nodes else None
    while node:
        out.add(node[0] + head)
        node = node[1]
    return out


def _rows(a: list, b: list) -> Iterator[int]:
    """For each beginning of a, an integer whose zeros are the places of b at which the longest common subsequence grows."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & full
        yield row


def _lengths(row: int, n: int) -> np.ndarray:
    """Length of the longest common subsequence with each beginning of b."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list, b: list, at: int = 0) -> list[int]:
    """Places in a, counted from at, of a longest common subsequence of a and b: from a table of bits, or by halves of a where that is too large."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [at] if a[0] in b else []
    if len(a) * len(b) > TABLE:
        half = len(a) // 2
        *_, before = _rows(a[:half], b)
        *_, after = _rows(a[half:][::-1], b[::-1])
        cut = int(np.argmax(_lengths(before, len(b)) + _lengths(after, len(b))[::-1]))
        return _aligned(a[:half], b[:cut], at) + _aligned(a[half:], b[cut:], at + half)
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    i, j, out = len(a), len(b), []
    have = j - rows[i].bit_count()
    while have:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif j - (rows[i - 1] & (1 << j) - 1).bit_count() == have:
            i -= 1
        else:
            out.append(at + i - 1)
            i, j, have = i - 1, j - 1, have - 1
    return out


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


_SKELETON = "mark long, host string, path string, lines array<long>, asked array<int>, longest long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of mark, url, html: the page's place, its lines' hashes, the places of those in question and the longest line's hash."""
    for b in batches:
        made = []
        for mark, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            found = lines(page.as_py() or "")
            hashes = [xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63) for _, line in found]
            kind = in_question([place for place, _ in found])
            longest = max(range(len(found)), key=lambda i: len(found[i][1]), default=None)
            made.append((mark, *_place(url), hashes, [i for i, (place, _) in enumerate(found) if place == kind], None if longest is None else hashes[longest]))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], ["mark", "host", "path", "lines", "asked", "longest"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the partition's runs of pages of one host that have the longest line in common; the first page of a run stands for it."""
    part, run, last = TaskContext.get().partitionId(), -1, None
    for b in batches:
        runs, first = [], []
        for own in zip(b.column("host").to_pylist(), b.column("longest").to_pylist(), strict=True):
            first.append(own != last)
            run, last = run + (own != last), own
            runs.append(run)
        added = [pa.array([part] * b.num_rows, pa.int32()), pa.array(runs, pa.int64()), pa.array(first, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, "part", "run", "first"])


def _nearest(reach: int):
    """For each run that is at home in a chunk: the run of the nearest URL that lacks its longest line, and whether one may lie further away."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["at"])
        out = []
        for i, r in enumerate(rows):
            if not r["home"]:
                continue
            lo, hi = max(0, i - reach), min(len(rows) - 1, i + reach)
            around = [j for j in range(lo, hi + 1) if j != i and rows[j]["host"] == r["host"]]
            near = sorted(((_alike(rows[j]["path"], r["path"]), -abs(j - i), j) for j in around), reverse=True)
            found = next((rows[j]["at"] for *_, j in near if r["longest"] not in rows[j]["lines"]), None)
            edge = any(abs(j - i) == reach for j in around)
            out.append((r["at"], found, found is None and edge))
        return pa.table({n: pa.array([x[k] for x in out], kind) for k, (n, kind) in enumerate((("at", pa.int64()), ("other", pa.int64()), ("further", pa.bool_())))})

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of mark, lines, asked, other (the lines of the page of the nearest URL): mark, shared, asked."""
    for b in batches:
        out = []
        for mark, own, asked, other in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = common_lines(own, other)
            out.append((mark, sorted(found), sorted(found.intersection(asked))))
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["mark", "shared", "asked"])


def difference(skeletons: DataFrame) -> DataFrame:
    """(mark, shared, asked) of every page that differs from another of its host: places of the lines it shares with the page of the nearest URL, and
    those of them in question."""
    spark, order = skeletons.sparkSession, ["host", "path", "mark"]
    kept = skeletons.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = materialise(kept.mapInArrow(_numbered, f"{_SKELETON}, part int, run long, first boolean"), "ordered")
    before, total = [], 0
    for r in kept.groupBy("part").agg((F.max("run") + 1).alias("runs")).orderBy("part").collect():  # a row for each partition
        before.append((r["part"], total))
        total += r["runs"]
    starts = spark.createDataFrame(before, "part int, start long")
    placed = kept.join(starts, "part").withColumn("at", F.col("start") + F.col("run"))
    runs = materialise(placed.where("first").select("at", "host", "path", "lines", "longest"), "runs")
    open_, found, reach, size = runs, None, REACH, CHUNK
    while True:
        chunk, rest = F.floor(F.col("at") / size).cast("long"), F.col("at") % size
        home = F.struct(chunk.alias("chunk"), F.lit(True).alias("home"))
        guest = lambda here, where: F.when(here, F.struct(where.alias("chunk"), F.lit(False).alias("home")))
        to = F.filter(F.array(home, guest(rest < reach, chunk - 1), guest(rest >= size - reach, chunk + 1)), lambda x: x.isNotNull())
        dealt = open_.select("*", F.explode(to).alias("to")).select("at", "host", "path", "lines", "longest", "to.*")
        near = materialise(dealt.groupBy("chunk").applyInArrow(_nearest(reach), "at long, other long, further boolean"), "near")
        ready = near.where("other is not null").select("at", "other")
        found = ready if found is None else found.union(ready)
        if reach >= total or not near.where("further").limit(1).count():
            break
        # Copies all around: hosts with such a run are searched again, further out. Runs that have their page find the same one again.
        hosts = near.where("further").join(runs.select("at", "host"), "at").select("host").distinct()
        open_ = runs.join(hosts, "host", "left_semi")
        reach, size = reach * WIDER, size * WIDER
    best = found.dropDuplicates(["at"]) if reach > REACH else found
    lines_of = runs.select(F.col("at").alias("other"), F.col("lines").alias("against"))
    chosen = best.join(lines_of, "other").select("at", "against")
    pairs = placed.select("at", "mark", "lines", "asked").join(chosen, "at").select("mark", "lines", "asked", "against")
    return pairs.mapInArrow(_shared, "mark long, shared array<int>, asked array<int>")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.xxhash64(page_id, url, html).alias("mark"))
    found = materialise(difference(own.select("mark", "url", "html").mapInArrow(_parse, _SKELETON)), "difference")
    # Only pages on which differencing decides are joined with its findings; pages are parsed again rather than written with all their lines.
    decided = materialise(found.where(F.size("asked") > 0).select("mark", "asked").dropDuplicates(["mark"]), "decided")
    hit, rest = sketch.parted(own, "mark", decided.select("mark"))
    both = hit.join(decided, "mark", "left").select("page_id", "url", "html", "asked").union(rest.select("page_id", "url", "html", F.lit(None).cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(lines(h.as_py() or ""), frozenset(gone or ())) for h, gone in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")
