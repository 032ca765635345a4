"""Operators on small fixtures against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import html.parser
import itertools
import math
import os
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sondage.llm import byte_bpe, html_text, line_dedup, lm_score, near_vectors, packing, quality, set_join, substrings, warc
from sondage.llm.common import mix64, word_spans
from sondage.llm.components import components
from sondage.llm.queries import RANKS, op1_packing

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
VOCABULARY = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 5))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(VOCABULARY, k=n))


def corpus():
    base = prose(80, 1)
    words = base.split()
    texts = [
        None, "", " \n\t", "one", base, base, " ".join(words[:40] + ["new"] + words[41:]), prose(30, 2) + "\n" + " ".join(words[10:40]) + "\n" + prose(30, 3),
        prose(12, 4), " ".join(words[20:33]), " ".join(words[20:32]), "same line\n" + prose(20, 5), "same line\n" + prose(20, 6), "a b c d <|endoftext|> 12 'll  x\n\n y ",
        prose(4000, 8), "x " * 30, "The THE the tHe quick", "The THE the tHe Quick",
    ]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, base, None, None, 1), (100, prose(4000, 8), "en", "s0", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names the operators use themselves.
    return spark.createDataFrame(corpus(), SCHEMA).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(1)).withColumn("ids", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall(text or "")


# --- shared parts --------------------------------------------------------------------------


def test_word_spans():
    text = "a bb\tccc\x0b a  é  x " + "z" * 50
    data = text.encode()
    h, s, e = word_spans(data)
    assert [data[i:j].decode() for i, j in zip(s, e)] == WORD.findall(text)
    assert h[0] == h[3] and len(set(h.tolist())) == len(h) - 1
    long = b"q" * 2_500_000 + b" a b"
    h, s, e = word_spans(long)
    assert [(int(i), int(j)) for i, j in zip(s, e)] == [(0, 2_500_000), (2_500_001, 2_500_002), (2_500_003, 2_500_004)]
    assert len(word_spans(b"")[0]) == len(word_spans(b" \n")[0]) == 0


def thue_morse(n, a, b):
    """Two words (or texts) that every polynomial modulo 2 ** 64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


@pytest.mark.parametrize("n", [1024, 4096, 8192])
def test_words_that_polynomials_confuse(n):
    one, other = ("".join(x) for x in thue_morse(n, "a", "b"))
    h, _, _ = word_spans(f"{one} {other} {one}".encode())
    assert h[0] == h[2] != h[1]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)] + [(None, 1), (7, 7)]
    top = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
            top.setdefault(min(a, b), min(a, b))
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for a, b in edges if a is not None and a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 packing -----------------------------------------------------------------------------


def test_packing(docs, none):
    own = Tokenizer.from_file(BPE)
    rows = packing.pack_documents(docs, BPE).collect()
    want = []
    for d, t, *_ in corpus():
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(d, i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for i, (a, b) in enumerate(itertools.pairwise(cuts))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none, BPE).count() == 0


def test_packing_has_the_ids_of_the_tokenizer_as_loaded(spark, tmp_path):
    own = Tokenizer.from_file(BPE)
    texts = [t for _, t, *_ in corpus()] + ["<|endoftext|> x", "a<|endoftext|><|endoftext|>\n b", "<|endoftext", "x " * 2000 + "<|endoftext|>", " " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "q" * 1_000_000 + " <|endoftext|>", " 7" * 300_000]
    assert own.encode("<|endoftext|> x", add_special_tokens=False).ids == [50256, 2124]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        want += [(d, i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for i, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, 1024)]))]
    stage = dict(corpus_pipeline.STAGES)["best_fit_packing"]
    for got in (op1_packing(spark, str(tmp_path)), stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))):
        assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == sorted(want)


def test_plan_uses_every_piece_and_few_sequences():
    r = np.random.default_rng(1)
    histogram = {int(z): int(n) for z, n in zip(*np.unique(np.clip(r.lognormal(5, 1, 20000).astype(int), 1, 1024), return_counts=True))}
    plan, used = packing.plan(histogram), {}
    for own, k in plan:
        assert sum(own) <= 1024
        for z in own:
            used[z] = used.get(z, 0) + k
    assert used == histogram
    assert sum(k for _, k in plan) <= 1.01 * sum(z * n for z, n in histogram.items()) / 1024 + 2


# --- 2 scores ------------------------------------------------------------------------------


def test_lm_scores_match_plain_sums(docs, none):
    ids, counts = lm_score.vocabulary(docs)
    assert counts.sum() == sum(len(words(t)) for _, t, *_ in corpus())
    net = lm_score.train(docs, ids, counts)
    own = lm_score.Ids(ids)
    rows = lm_score.score(docs, net, ids).collect()
    assert len(rows) == len(corpus())
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for d, t, *_ in corpus():
        if d is None:
            continue
        x = [own.id(w.encode()) for w in words(t)]
        total = 0.0
        for i, y in enumerate(x):
            near = [x[j] if 0 <= j < len(x) else lm_score.SIZE for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(net.bias + sum(net.near[o][n] for o, n in enumerate(near)))
            a, b = h @ net.to_class + net.class_bias, h @ net.to_word[y // 64] + net.word_bias[y // 64]
            total += a[y // 64] - np.log(np.exp(a).sum()) + b[y % 64] - np.log(np.exp(b).sum())
        assert by[d]["n_tokens"] == len(x) and math.isclose(by[d]["log_prob"], total, rel_tol=1e-4, abs_tol=1e-6)
    assert by[0]["log_prob"] == 0 and by[0]["mean_log_prob"] is None
    assert lm_score.score_corpus(none).count() == 0


def test_training_helps_on_held_out_text(spark):
    r = random.Random(1)
    pairs = [(f"a{i}", f"b{i}") for i in range(40)]
    text = lambda: " ".join(w for _ in range(60) for w in r.choice(pairs))
    train, held = (spark.createDataFrame([(i, text()) for i in range(n)], "doc_id long, text string").coalesce(1) for n in (800, 50))
    ids, counts = lm_score.vocabulary(train)
    mean = lambda net: lm_score.score(held, net, ids).agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0]
    assert mean(lm_score.train(train, ids, counts)) > mean(lm_score.Network.start(counts)) + 0.2


@pytest.mark.parametrize("known", [lm_score.KNOWN, lm_score.FREQUENT])
def test_words_that_share_an_id_have_their_own_probabilities(spark, monkeypatch, known):
    monkeypatch.setattr(lm_score, "KNOWN", known)
    alike = {}
    for w in (f"w{i}" for i in range(5000)):
        alike.setdefault(lm_score.Ids({}).id(w.encode()), []).append(w)
    often, rare = next(x for x in alike.values() if len(x) > 1)[:2]
    frequent = " ".join(f"f{i} " * 20 for i in range(lm_score.FREQUENT))
    rows = [(1, frequent), (2, f"f1 {often} f2"), (2, f"f1 {often} f2"), (3, f"f1 {rare} f2"), (None, f"f3 {often} {often} {often}"), (None, f"{often} {rare}"), (4, f"{often} " * 4), (5, None), (6, ""), (7, "f1 f2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count = {}
    for _, t in rows:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    ids, counts = lm_score.vocabulary(df)
    own = lm_score.Ids(ids)
    assert own.id(often.encode()) == own.id(rare.encode()) >= lm_score.FREQUENT and count[often] > count[rare]
    # Ids are scored by one network for both, so what is left is the words' shares.
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])
    got = sorted(lm_score.score_corpus(df.coalesce(1)).collect(), key=key)
    plain = sorted(lm_score.score(df, lm_score.train(df.coalesce(1), ids, counts), ids).collect(), key=key)
    share = lambda t: sum(math.log(count[w] / counts[own.id(w.encode())]) for w in words(t))
    want = sorted(({"doc_id": d, "n_tokens": len(words(t)), "share": share(t)} for d, t in rows), key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    for g, p, w in zip(got, plain, want, strict=True):
        assert math.isclose(g["log_prob"], p["log_prob"] + w["share"], rel_tol=1e-4, abs_tol=1e-4)
        assert g["mean_log_prob"] is None if not g["n_tokens"] else math.isclose(g["mean_log_prob"], g["log_prob"] / g["n_tokens"])
    by = {r["doc_id"]: r["log_prob"] for r in got}
    assert by[3] < by[2] - 1


def test_every_word_of_every_document_is_a_target(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a{i} b c"[: 1 + i % 6]) for i in range(20)] + [(99, None)], "doc_id long, text string").coalesce(1)
    ids, counts = lm_score.vocabulary(df)
    start, net = lm_score.Network.start(counts), lm_score.train(df, ids, counts)
    assert (start.flat() != net.flat()).any()
    # The slope of the words' biases within a class is nonzero for each class that a target is in, and no other.
    moved = np.abs(net.class_bias - start.class_bias)
    assert (moved > 0).all()
    long = spark.createDataFrame([(1, " ".join(f"{c}{i}" for i in range(4) for c in "xyzuvwst"))], "doc_id long, text string")
    ids, counts = lm_score.vocabulary(long)
    start, net = lm_score.Network.start(counts), lm_score.train(long, ids, counts)
    near = np.abs(net.near - start.near).max(axis=2)
    # Every word but one at an end is a neighbour of a target on the left as on the right.
    assert all((near[o, [lm_score.Ids(ids).id(w) for w in ids]] > 0).sum() == len(ids) - d for o, d in enumerate((2, 1, 1, 2)))


# --- 3 lines -------------------------------------------------------------------------------


def test_lines(spark):
    rows = [(i, f"boiler \nown {i}\n\nboiler", "h") for i in range(9)] + [(20, "boiler\nx", "other"), (21, None, "h"), (22, "", None), (23, "alone\n", None), (9, "copy\nq", "h")] + [(10 + i, "copy\nq", "h") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("mine"))
    df = df.withColumn("Host", F.lit("mine")).withColumn("own", F.lit(1))
    rows = line_dedup.dedup(df, percent=50).collect()
    got = {r["doc_id"]: (r["text"], r["n_lines_"], r["n_dropped"]) for r in rows}
    assert {(r["n_lines"], r["Host"], r["own"]) for r in rows} == {("mine", "mine", 1)}
    assert got[3] == ("own 3\n", 4, 2) and got[20] == ("boiler\nx", 2, 0) and got[21] == (None, 0, 0) and got[22] == ("", 1, 0) and got[23] == ("alone\n", 2, 0)
    # A line of 7 of the host's 16 pages is below one half; of one distinct page of ten, too.
    assert got[12] == ("copy\nq", 2, 0)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, percent=40).collect()}[12] == ""
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, percent=40, distinct=True).collect()}[12] == "copy\nq"
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_long_pages_of_boilerplate(spark):
    text = "\n".join(f"line {i}" for i in range(5000))
    df = spark.createDataFrame([(i, f"{text}\nown {i}", "h") for i in range(4)], "doc_id long, text string, source string")
    assert {(r["text"], r["n_dropped"]) for r in line_dedup.dedup(df).collect()} == {(f"own {i}", 5000) for i in range(4)}


# --- 4 tokens ------------------------------------------------------------------------------


def test_byte_bpe_is_that_of_tiktoken(docs, none):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    rows = got.collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert r["ids"] == encoding.encode_ordinary(r["text"] or "") and bytes(r["data"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_on_odd_characters():
    codec = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    r = random.Random(5)
    texts = ["".join(chr(r.choice([32, 9, 10, 0x85, 0xA0, 0x2028, 0x1C, r.randrange(33, 126), r.randrange(0xC0, 0x250), r.randrange(0x4E00, 0x4E80), 0x1F600])) for _ in range(200)) for _ in range(50)]
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


# --- 5 pages -------------------------------------------------------------------------------


def test_markup():
    text = lambda page: html_text.main_text(html_text.lines(page))
    page = "<html><head><title>T</title></head><body><nav>menu</nav><header>top</header><div class='cookie-notice'>we</div><article><h1>A &amp; b</h1><p>one\n  two<br>three<p>four<script>if(a</p>)</script><aside>x</aside><form>f</form></article><section id=comments><p>c</p></section><footer>&copy;</footer>"
    assert text(page) == "A & b\none two three\nfour"
    assert {line for place, line in html_text.lines(page) if place == html_text.OUT} == {"menu", "top", "we", "x", "f", "c", "©"}
    assert text("") == "" and text("<p>cut <a hre") == "cut" and text("</b></p>x</i>") == "x"
    # In an article, what only holds such a word stays, and what is nothing but one goes.
    assert text("<article><p class='lead social-history'>a</p><div class='widget-body'><p>b</p></div><div class=ad>c</div><p class=notice>d</p><nav>e</nav></article>") == "a\nb\nd"
    doubt = html_text.lines("<main><p>own</p><div class='share-box'>tell others</div></main>")
    assert html_text.main_text(doubt) == "own\ntell others" and html_text.main_text(doubt, frozenset([0, 1])) == "own"


def test_markup_of_hostile_pages_takes_linear_time():
    for part in ("<a ", "<i>", "</b>", "<i></b>", "<a \"", "<!--", "<script ", "<p>x", "<a '\""):
        took = []
        for size in (50_000, 200_000):
            began = time.process_time()
            html_text.main_text(html_text.lines(part * (size // len(part))))
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.2, part


class Reader(html.parser.HTMLParser):
    """A parser of its own for plain pages: (in the article, in furniture, line) of what stands between block elements."""

    ENDS = set("html body article main div p ul li table tr h1 h2 nav footer aside blockquote".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.found, self.held, self.open = [], "", []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if self.held.split():
            tags = [t for t, _ in self.open]
            bad = any(t in ("nav", "footer", "aside", "script", "style") or k in ("ad", "reader-comments", "cookie-banner") for t, k in self.open)
            self.found.append(("article" in tags or "main" in tags, bad, " ".join(self.held.split())))
        self.held = ""

    def handle_starttag(self, tag, attributes):
        if tag in self.ENDS:
            self.end()
        if tag in ("td", "br"):
            self.held += " "
        if tag != "br":
            self.open.append((tag, dict(attributes).get("class")))

    def handle_endtag(self, tag):
        if tag in self.ENDS:
            self.end()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(t in ("script", "style") for t, _ in self.open):
            self.held += data


def plain_extract(rows):
    """The query by plain means: a parser of its own, every page against all of its host, shared lines by a full table."""
    def shared(a, b):
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(reversed(range(len(a))), reversed(range(len(b)))):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
        i = j = 0
        out = set()
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.add(i)
                i, j = i + 1, j + 1
            elif size[i + 1][j] >= size[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    def place(url):
        host, _, path = url.removeprefix("http://").partition("/")
        return host, "/" + path

    parsed = sorted((*place(url), page_id, Reader(html).found) for page_id, url, html in rows)
    longest = [next(x for *_, x in own if len(x) == max(len(y) for *_, y in own)) for *_, own in parsed]
    run = []
    for i, (host, *_) in enumerate(parsed):
        run.append(run[-1] if i and (host, longest[i]) == (parsed[i - 1][0], longest[i - 1]) else i)
    out = {}
    for i, (host, _, page_id, own) in enumerate(parsed):
        texts = [x for *_, x in own]
        path = parsed[run[i]][1]
        near = [(len(os.path.commonprefix([path, parsed[j][1]])), -abs(j - run[i]), j) for j in sorted(set(run)) if parsed[j][0] == host and j != run[i]]
        other = next((j for *_, j in sorted(near, reverse=True) if longest[i] not in [x for *_, x in parsed[j][3]]), None)
        gone = shared(texts, [x for *_, x in parsed[other][3]]) if other is not None else set()
        main = [x for inside, bad, x in own if inside and not bad]
        out[page_id] = "\n".join(main or [x for k, (_, bad, x) in enumerate(own) if not bad and k not in gone] or [x for _, bad, x in own if not bad])
    return out


def test_lines_are_blocks():
    """Inline markup, tables, nested blocks and references, against the other parser."""
    text = lambda page: html_text.main_text(html_text.lines(page))
    assert text('<p>foo <b>bar</b> baz <a href="x">link</a> end.</p>') == "foo bar baz link end."
    assert text("H<sub>2</sub>O <i>x<b>y</i>z</b>w") == "H2O xyzw"
    assert text("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == "a b\nc"
    assert text("<article><p>a <span class=ad>buy</span> b</p></article>") == "a\nb"
    r = random.Random(8)

    def part(depth):
        kind = r.choice(["text"] * 4 + ["inline"] * 3 + ["block", "table", "list", "ref"]) if depth else "text"
        inner = lambda: "".join(part(depth - 1) for _ in range(r.randrange(1, 4)))
        if kind == "text":
            return r.choice(["one ", "two", " three\n", "x  y", ""])
        if kind == "ref":
            return r.choice(["&amp;", "&#233;", "&nbsp;", "&lt;b&gt;", "&copy"])
        if kind == "inline":
            return f"<{(t := r.choice(['b', 'i', 'a', 'span', 'sub']))}>{inner()}</{t}>"
        if kind == "table":
            return f"<table><tr><td>{inner()}</td><td>{inner()}</td></tr></table>"
        if kind == "list":
            return f"<ul><li>{inner()}</li><li>{inner()}</li></ul>"
        tag = r.choice(["p", "div", "blockquote", "nav", "aside"])
        return f"<{tag}{r.choice(['', ' class=ad', ' class=plain'])}>{inner()}</{tag}>"

    for _ in range(800):
        page = f"<html><body>{part(2)}<article>{part(4)}<h1>T</h1>{part(4)}</article>{part(2)}</body></html>"
        want = "\n".join(x for inside, bad, x in Reader(page).found if inside and not bad)
        assert text(page) == want, page


def test_parts_are_judged_by_name_links_and_size():
    def text(inside):
        return html_text.main_text(html_text.lines(f"<main><p>{prose(30, 1)}</p>{inside}</main>")).split("\n")[1:]

    for name in ("ad-slot", "cookie-banner", "reader-comments", "newsletter-signup", "adSlot"):
        assert text(f"<div class='{name}'><p>buy this</p></div>") == [], name
    assert text("<p class=ad>buy</p><p class='comment'>first!</p>") == []
    assert text("<div class=widget><p>real text</p></div>") == ["real text"]
    assert text("<div class=widget><p>see <a href=x>other things</a></p></div><div class=related><a>a</a></div>") == []
    assert text(f"<div class=menu><p>{prose(200, 2)}</p></div>") == [prose(200, 2)]
    assert text(f"<div class=menu><a>{prose(200, 2)}</a></div>") == []


def test_alignment_by_bits_is_as_long_as_by_places(monkeypatch):
    monkeypatch.setattr(html_text, "TABLE", 200)
    r = random.Random(12)
    for _ in range(150):
        a, b = (r.choices("abcd", k=r.randrange(60)) for _ in range(2))
        found = html_text._aligned(a, b)
        assert len(found) == len(set(found)) == len(html_text.common_lines(a, b))
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(found))
    monkeypatch.setattr(html_text, "MATCHES", 0)
    assert len(html_text.common_lines(["x"] * 3000 + ["y"], ["z"] + ["x"] * 2000 + ["y"])) == 2001


def test_html(spark, monkeypatch):
    r = random.Random(5)
    furniture = ["Home", "About us", "All rights reserved", "Read our notice"]
    rows = []
    for i in range(120):
        host = f"h{i % 3}.example"
        body = [prose(12, 1000 + i), "A saying that articles quote", prose(8, 2000 + i)]
        parts = [f"<p>{x}</p>" for x in [*furniture[:2], *body, *furniture[2:]]]
        if i % 3 == 1:
            parts = ["<nav><a>Home</a></nav>", "<article>", *(f"<p>{x}</p>" for x in body), "<div class='reader-comments'>Tell your friends</div>", "</article>", f"<div class=ad>{prose(3, i)}</div>"]
        if i % 10 == 9 and i >= 39:  # near copies of the page before on the host
            parts = [*parts[:2], *re.findall("<p>.*?</p>", rows[i - 3][2])[2:4], f"<p>{prose(6, 3000 + i)}</p>", *parts[-2:]] if i % 3 != 1 else parts
        rows.append((i, f"http://{host}/{r.choice('abc')}/{i:03d}", "".join(parts)))
    # A host of copies of one page but for one, far from most of them.
    rows += [(500 + i, f"http://far.example/a/{i:02d}", f"<p>Menu</p><p>{prose(20, 77)}</p><p>Foot {i}</p>") for i in range(30)]
    rows.append((600, "http://far.example/b", f"<p>Menu</p><p>{prose(10, 78)}</p><p>Foot 3</p>"))
    monkeypatch.setattr(html_text, "CHUNK", 16)
    monkeypatch.setattr(html_text, "REACH", 1)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("mark", F.lit("mine")).withColumn("text", F.lit(1)).repartition(3)
    got = {x["page_id"]: x["text"] for x in html_text.extract(df).collect()}
    assert got == plain_extract(rows)
    assert got[501] == f"{prose(20, 77)}\nFoot 1" and got[600] == f"{prose(10, 78)}\nFoot 3"
    assert got[0] == f"{prose(12, 1000)}\n{prose(8, 2000)}" and got[1] == f"{prose(12, 1001)}\nA saying that articles quote\n{prose(8, 2001)}"


def test_html_of_odd_rows(spark):
    open_ = lambda body: f"<body><p>Site menu</p><p>{body}</p><p>All rights</p></body>"
    rows = [(1, "http://a.b/x/1", open_("the first page")), (2, "http://a.b/x/2", open_("the second one")), (3, "http://c.d/1", open_("third")), (4, "http://e.f/1", open_("copies of one page")), (5, "http://e.f/1", open_("copies of one page")), (6, None, "<p>x"), (7, "http://[bad", None), (None, "http://a.b/y", ""), (6, None, "<p>x"), (8, "http://g.h/1", "<p>" + "x " * 500_000)]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    texts = {d: t for d, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert texts[1] == "the first page" and texts[2] == "the second one" and texts[3] == "Site menu\nthird\nAll rights" and texts[4] == texts[5] == "Site menu\ncopies of one page\nAll rights"
    assert texts[6] == "x" and texts[7] == "" and texts[None] == "" and len(texts[8]) == 999_999
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_common_lines_is_a_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = (r.choices("abcd", k=r.randrange(9)) for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
        assert len(html_text.common_lines(a, b)) == size[-1][-1]


# --- 6 vectors -----------------------------------------------------------------------------


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "PER_PIVOT", 30)
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    r = np.random.default_rng(4)
    centre = r.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + 0.12 * r.normal(size=8)).astype(np.float32).tolist(), i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], 1), (203, None, 0), (204, [0.0] * 8, 0), (205, [float("nan")] + [1.0] * 7, 0), (206, rows[0][1], None), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0), (209, [None] * 8, 0), (3, rows[3][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit(1)).repartition(3)

    def usable(x, label):
        return x is not None and label is not None and all(v is not None and math.isfinite(v) for v in x) and any(x)

    links = {i: [] for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        (_, x, a), (_, y, b) = rows[i], rows[j]
        if usable(x, a) and usable(y, b) and a == b and len(x) == len(y):
            x, y = np.array(x, np.float64), np.array(y, np.float64)
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                links[i].append(j)
                links[j].append(i)
    want = []
    for i, (v, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        want.append((v, len(links[i]), least, v == least))
    assert sorted(tuple(r) for r in near_vectors.link(df).collect()) == sorted(want)
    assert near_vectors.link(df.limit(0)).count() == 0


def test_vectors_of_any_size(spark):
    """Components whose squares leave the range of doubles; empty table, ties."""
    rows = [(1, [1e200, 2e200]), (2, [1.0, 2.0]), (3, [1e-200, 2e-200]), (4, [2e-200, -1e-200]), (5, [1e308, 1e308]), (6, [5e-324, 5e-324])]
    df = spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id long, embedding array<double>, label string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors.link(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 1, 5), (6, 1, 5)]


# --- 7 passages ----------------------------------------------------------------------------


def plain_removed(rows, window):
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            w = words(t)
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_passages(docs, none, monkeypatch):
    monkeypatch.setattr(substrings, "PER_SHARD", 3)
    got = [(r["doc_id"], r["n_words_"], r["n_removed"], " ".join(words(r["text"]))) for r in substrings.dedup(docs).collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(plain_removed(corpus(), 13), key=key)
    left = substrings.dedup(docs).where("doc_id = 4").first()
    assert left["text"] == corpus()[4][1] and left["kept"] == 1
    assert substrings.dedup(none).count() == 0


def test_passages_of_long_and_confusing_words(spark):
    """Long words and long runs that a polynomial hash can't tell apart, and a very long text, through Spark."""
    one, other = ("".join(x) for x in thue_morse(2048, "a", "b"))
    run, twin = (" ".join(x) for x in thue_morse(2048, "yes", "no"))
    tail = prose(12, 31)
    texts = [f"{one} {tail}", f"{other} {tail}", f"{one} {tail}", run, twin, run, prose(60_000, 32), "x " + prose(60_000, 32)]
    rows = list(enumerate(texts))
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = sorted((r["doc_id"], r["n_words"], r["n_removed"], " ".join(words(r["text"]))) for r in got.collect())
    want = plain_removed(rows, 13)
    assert found == want and [x[2] for x in want[:3]] == [0, 0, 13]


def test_automaton_against_plain_search():
    r = random.Random(9)
    for _ in range(60):
        runs = [(r.choices("ab", k=r.randrange(1, 14)), d) for d in range(8)]
        a = substrings.Automaton()
        for x, d in runs:
            a.add(x, d)
        a.close()
        for x in [*(x for x, _ in runs), r.choices("abc", k=20)]:
            want = [min((d for y, d in runs if any(y[j : j + 4] == x[i : i + 4] for j in range(len(y) - 3))), default=None) for i in range(max(0, len(x) - 3))]
            assert a.owners(x, 4) == want


# --- 8 archives ----------------------------------------------------------------------------


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    big = "<p>" + "é" * 60
    rows = [(5, "http://a/1", big), (3, "http://a/2 x", big), (3, "http://a/3", big), (9, None, "small"), (8, "u", "small"), (7, "u", None), (None, "u", big), (None, "w", big + "!"), (None, "w", big + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = warc.read_warc(warc.convert(warc.write_arc(df))).collect()
    assert len(got) == len(rows)
    digest = hashlib.sha256(big.encode()).hexdigest()
    same = [(r["source_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["payload_digest"] == digest]
    assert sorted(same, key=str) == sorted([(5, "revisit", 3, 123), (3, "response", None, 123), (3, "response", None, 123), (None, "revisit", 3, 123)], key=str)
    ids = {r["source_id"]: r["record_id"] for r in got}
    assert {r["refers_to_id"] for r in got if r["record_type"] == "revisit"} == {ids[3]}
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 100) and sum(r["payload_digest"] == hashlib.sha256(b"small").hexdigest() for r in got) == 2
    assert {r["date"] for r in got} == {"2024-01-01T00:00:00Z"} and any(r["url"] == "http://a/2%20x" for r in got)
    assert warc.read_warc(warc.convert(warc.write_arc(df.limit(0)))).count() == 0


def test_arc_versions_and_damage():
    body = b"HTTP/1.0 404 Not Found\r\n\r\nhello"
    one = b"filedesc://x 0.0.0.0 2000 text/plain 76\n" + b"1 0 me\nURL IP-address Archive-date Content-type Archive-length\n".ljust(76, b" ") + b"\nhttp://a 1.2.3.4 20000102030405 text/html %d\n" % len(body) + body + b"\n"
    (r,) = warc.parse_arc(one)
    assert (r["url"], r["ip"], r["status"], r["payload"]) == ("http://a", "1.2.3.4", 404, b"hello")
    two = b"filedesc://x 0.0.0.0 2000 text/plain 200 - - 0 x 8\n2 0 me\n \nhttp://a 1.2.3.4 2000 text/html 301 - - 9 x %d\n" % len(body) + body
    (r,) = warc.parse_arc(two)
    assert r["status"] == 301
    with pytest.raises(ValueError):
        list(warc.parse_arc(one[:-8]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a 1.2.3.4 2000 text/html 3\nabc"))
    assert warc.iso("200001") == "2000-01-01T00:00:00Z"


# --- 9 quality -----------------------------------------------------------------------------


def plain_counts(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, again = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            again.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def plain_scores(rows, trusted, n=quality.BUCKETS):
    """The mean log ratio of each row's n-grams, by plain counting."""
    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
        two = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in itertools.pairwise(h)]
        return [(x - (1 << 64) if x >> 63 else x) % n for x in h + two]

    raw, good = [1] * n, [1] * n
    for d, t, *_ in rows:
        for g in grams(t):
            raw[g] += 1
            good[g] += d in trusted
    ratio = [math.log(g / sum(good)) - math.log(r / sum(raw)) for g, r in zip(good, raw)]
    return [sum(ratio[g] for g in grams(t)) / len(grams(t)) if words(t) else None for _, t, *_ in rows]


def test_quality(spark):
    extra = [(200, "a#b\n a\n\na#b\n$ <é>", "", "", 0), (201, " ".join((prose(10, 3) + " ") * 2 for _ in range(3)) + "tail", "", "", 0), (202, prose(9, 1) + " " + prose(30, 9) + " " + prose(9, 1), "", "", 0)]
    rows = corpus() + extra
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine")).withColumn("verdict", F.lit(1))
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, None), (8, 0, 0), (None, 1, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(r[0] for r in quality.trusted_ids(labels).collect()) == [4, 7]
    got = quality.judge(df, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    scores = plain_scores(rows, {4, 7})
    assert {(r["kept"], r["verdict"]) for r in got} == {("mine", 1)}
    for i, (d, t, *_) in enumerate(rows):
        r, (n, *rest) = by[d], plain_counts(t)
        assert r["llr"] is None if scores[i] is None else math.isclose(r["llr"], scores[i], rel_tol=1e-9, abs_tol=1e-12)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n)
        assert r["kept_"] == (not r["base_failed"] and scores[i] >= quality.THRESHOLD)
    assert by[0]["llr"] is None and not by[0]["kept_"]
    # A verdict used as a filter is the same verdict.
    assert quality.judge(df, labels).where("kept_").count() == sum(r["kept_"] for r in got)
    assert quality.judge(df.limit(0), labels).count() == 0


def test_quality_ratios_are_those_of_the_counts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "c c")], "doc_id long, text string")
    ratios = quality.fit(df, spark.createDataFrame([(1,)], "doc_id long"), n=64)
    assert len(ratios) == 64
    good, raw = 5, 8
    smooth = quality.SMOOTHING
    absent = math.log(smooth / (good + 64 * smooth)) - math.log(smooth / (raw + 64 * smooth))
    assert sum(math.isclose(x, absent) for x in ratios) >= 64 - 7


def test_threshold_is_drawn_from_held_out_labels(spark):
    assert quality.drawn([(5, True, 10), (9, True, 90), (-3, False, 20)]) == (-2 + 5) / 2 / 1000
    # Rejecting a tenth of the good would cost four times a tenth, keeping a tenth of the bad costs less.
    assert quality.drawn([(5, True, 10), (9, True, 90), (6, False, 1), (-3, False, 9)]) == (-2 + 5) / 2 / 1000
    assert quality.drawn([(5, True, 10)]) is None and quality.drawn([]) is None
    clean = [(i, prose(40, i)) for i in range(200)]
    junk = [(1000 + i, " ".join(f"{w}%%%" for w in prose(40, i).split())) for i in range(60)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.judge(df, labels).where("kept").collect()}
    assert kept == set(range(200))


def test_every_labelled_document_counts(spark, monkeypatch):
    """No bound on trusted ids, whether they are broadcast or joined; the counts are those of all good documents, folds included."""
    labels = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(labels).count() == 50_000
    rows = [(i, prose(30, i)) for i in range(40)] + [(1000 + i, "junk " * 30) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(1000 + i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    whole, threshold = quality.model(df, some)
    assert whole == pytest.approx(quality.fit(df, quality.trusted_ids(some)))
    monkeypatch.setattr(quality, "FEW", 0)
    assert quality.model(df, some) == (pytest.approx(whole), threshold)


# --- 10 sets -------------------------------------------------------------------------------


def plain_sets(rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        w = [x.encode().lower() for x in words(t)]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            top[root(i)] = root(j)
    out = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return out


def families_of_copies():
    r, rows = random.Random(11), []
    for family in range(6):
        own = prose(20 + 25 * family, 100 + family).split()
        for copy in range(12):
            w = own.copy()
            for _ in range(copy // 3):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            rows.append((family * 100 + copy, " ".join(w).upper() if copy % 2 else " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_sets(spark, n, percent, monkeypatch):
    monkeypatch.setattr(set_join, "SIDE", 2)
    rows = corpus() + families_of_copies()
    got = set_join.join(spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit(1)).repartition(4), n, percent).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain_sets(rows, n, percent), key=key)


def test_sets_with_long_and_confusing_words(spark):
    """Twelve of thirteen shingles in common would link at 0.9, eleven don't."""
    one, other = ("".join(x) for x in thue_morse(2048, "a", "b"))
    rest = " ".join(f"w{i}" for i in range(13))
    long = prose(60_000, 41)
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest}"), (4, long), (5, long + " end")]
    got = set_join.join(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 4)]


def test_sets_of_an_empty_table(none):
    assert set_join.join(none).count() == 0 and set_join.dedup(none).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = corpus() + families_of_copies()
    df = spark.createDataFrame(rows, SCHEMA)
    left = sorted((r["doc_id"], r["text"] or "") for r in set_join.dedup(df).collect() if r["doc_id"] is not None)
    want = {(d, t or "") for (d, t, *_), (_, n, c) in zip(rows, plain_sets(rows, 5, 80)) if d is not None and (n == 0 or d == c)}
    assert left == sorted(want)


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(3)
    for percent in (80, 90):
        bands = set_join.Bands(percent)
        for size in (9, 10, 11, 20, 57, 300, 2000):
            for _ in range(30):
                a = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
                b, t = a, a
                while True:
                    t = np.unique(np.concatenate([np.delete(t, r.integers(len(t))), r.integers(0, 1 << 63, r.integers(0, 2)).astype(np.uint64)]))
                    if not set_join.linked(a, t, percent):
                        break
                    b = t
                if len(b) != len(a) or (a != b).any():
                    assert set(set_join.signatures(a, bands).tolist()) & set(set_join.signatures(b, bands).tolist())
                    assert set_join.may_link(set_join.bitmap(a), set_join.bitmap(b), np.int64(len(a)), np.int64(len(b)), percent)


def test_mixing_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(mix64(x))) == len(x)
