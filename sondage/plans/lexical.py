"""Queries of the lexical channels, fusion, boosts and the composite search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.functions import lists
from sondage.operators import batch, bm25, channels, evaluation, path_index, ranking, typos
from sondage.operators.segments import Segments
from sondage.sources import views as V
from sondage.sources.files import shared_folder

from .registry import query
from .scalars import _knn_sql
from .search import search, text_search
from .stores import _METRICS

PART_TEXT, CONTENT_TEXT, PHRASE = "small ring", "idiot clown loser", "in the"
TYPO = "smal rign"
_FOLD = "strip_accents(lower({0}))"
_TOKENS = "list_filter(string_split_regex(" + _FOLD + r", '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _word(w: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{w}'))"


def _prefix(w: str) -> str:
    return f"len(list_filter(t, lambda x: starts_with(x, '{w}')))"


def _phrase(ws: list[str]) -> str:
    lit = ", ".join(f"'{w}'" for w in ws)
    return f"len(list_filter(range(1, len(t) - {len(ws) - 2}), lambda i: t[i:i + {len(ws) - 1}] = [{lit}]))"


def bm25_sql(rows: str, keys: str, text: str, counts: list[str], every: bool = False) -> str:
    """SELECT of keys and score over the rows that match."""
    fs = [f"f{i}" for i in range(len(counts))]
    inner = f"SELECT {keys}, len(t) AS dl, {', '.join(f'{c} AS {f}' for c, f in zip(counts, fs, strict=True))} FROM (SELECT {keys}, {_TOKENS.format(text)} AS t FROM {rows})"
    stats = f"SELECT count(*) AS n, avg(dl) AS a, {', '.join(f'count(*) FILTER (WHERE {f} > 0) AS {f}_n' for f in fs)} FROM c"
    part = "greatest(ln((s.n - s.{0}_n + 0.5) / (s.{0}_n + 0.5)), 1e-6) * CAST({0} AS DOUBLE) * 2.2 / ({0} + 1.2 * (1 - 0.75 + 0.75 * dl / s.a))"
    total = " + ".join(part.format(f) for f in fs)
    where = (" AND " if every else " OR ").join(f"{f} > 0" for f in fs)
    return f"SELECT {keys}, round({total}, 9) AS score FROM (WITH c AS ({inner}) SELECT c.*, s FROM c, ({stats}) s WHERE {where})"


def rrf_sql(rows: str, boost: float) -> str:
    return f"SELECT path, {boost} / (60.0 + row_number() OVER (ORDER BY score DESC, path)) AS rrf FROM ({rows})"


def path_sql(view: str, counts: list[str], boost: float, every: bool = False) -> str:
    return rrf_sql(f"SELECT * FROM ({bm25_sql(view, 'path', 'path', counts, every)}) ORDER BY score DESC, path LIMIT 20", boost)


def chunk_sql(counts: list[str], limit: int, boost: float, every: bool = False) -> str:
    best = f"SELECT * FROM ({bm25_sql('chunks_v', 'path, chunk_no, content', 'content', counts, every)}) ORDER BY score DESC, path, chunk_no LIMIT {limit}"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_no) AS r FROM ({best})"
    return rrf_sql(f"SELECT path, round(avg(score), 9) AS score FROM ({ranked}) WHERE r <= 3 GROUP BY path", boost)


_W, _P = [_word(w) for w in PART_TEXT.split()], [_prefix(w) for w in PART_TEXT.split()]
_S = [_prefix(w[:4]) for w in PART_TEXT.split() if len(w) >= 4]
_CW, _CP = [_word(w) for w in CONTENT_TEXT.split()], [_prefix(w[:4]) for w in "idioti clownz".split()]
_SUBSTR = "SELECT DISTINCT path FROM parts_v WHERE contains(lower(path), 'small') OR contains(lower(path), 'ring') ORDER BY path LIMIT 30"


@query("l1_path_any", V.with_views(path_sql("parts_v", _W, 3.0), "parts_v"))
def l1(spark, d):
    return channels.path_any(V.parts(spark, d), PART_TEXT)


@query("l2_path_all", V.with_views(path_sql("parts_v", _W, 4.0, True), "parts_v"))
def l2(spark, d):
    return channels.path_all(V.parts(spark, d), PART_TEXT)


@query("l3_path_prefix", V.with_views(path_sql("parts_v", _P, 1.5), "parts_v"))
def l3(spark, d):
    return channels.path_prefix(V.parts(spark, d), PART_TEXT)


@query("l4_path_short_prefix", V.with_views(path_sql("parts_v", _S, 1.0, True), "parts_v"))
def l4(spark, d):
    return channels.path_short_prefix(V.parts(spark, d), PART_TEXT)


@query("l5_path_substring", V.with_views(rrf_sql("SELECT path, 0.0 AS score FROM (SELECT DISTINCT path FROM parts_v WHERE contains(lower(path), 'izm') ORDER BY path LIMIT 30)", 0.75), "parts_v"))
def l5(spark, d):
    p = V.parts(spark, d)
    return channels.path_substring(p, "izm", channels.path_any(p, "izm"))


def _path_index(spark, d):
    folder = shared_folder(spark, "paths")
    path_index.indexed(V.parts(spark, d)).save(folder)
    return path_index.PathIndex.load(spark, folder)


_INDEXED = {
    "l1_indexed": (path_sql("parts_v", _W, 3.0), channels.path_any), "l2_indexed": (path_sql("parts_v", _W, 4.0, True), channels.path_all),
    "l3_indexed": (path_sql("parts_v", _P, 1.5), channels.path_prefix), "l4_indexed": (path_sql("parts_v", _S, 1.0, True), channels.path_short_prefix),
}
for _name, (_sql, _channel) in _INDEXED.items():
    query(_name, V.with_views(_sql, "parts_v"))(lambda spark, d, channel=_channel: channel(channels.prepared_paths(_path_index(spark, d), PART_TEXT), PART_TEXT))


@query("l5_indexed", V.with_views(rrf_sql("SELECT path, 0.0 AS score FROM (SELECT DISTINCT path FROM parts_v WHERE contains(lower(path), 'izm') ORDER BY path LIMIT 30)", 0.75), "parts_v"))
def l5_indexed(spark, d):
    i = _path_index(spark, d)
    return channels.path_substring(i, "izm", channels.path_any(channels.prepared_paths(i, "izm"), "izm"))


@query("l6_content_keyword", V.with_views(chunk_sql(_CW, 400, 10.0), "chunks_v"))
def l6(spark, d):
    return channels.content_keyword(V.chunks(spark, d), CONTENT_TEXT)


@query("l7_content_phrase", V.with_views(chunk_sql([_phrase(PHRASE.split())], 500, 50.0), "chunks_v"))
def l7(spark, d):
    return channels.content_phrase(V.chunks(spark, d), PHRASE)


@query("l8_content_fuzzy", V.with_views(chunk_sql(_CP, 50, 0.8, True), "chunks_v"))
def l8(spark, d):
    c = V.chunks(spark, d)
    return channels.content_fuzzy(c, "idioti clownz", channels.content_keyword(c, "idioti clownz"))


_BEST = f"SELECT path, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_no) AS r FROM ({bm25_sql('chunks_v', 'path, chunk_no, content', 'content', _CW)})"


@query("l9_top_k_average", V.with_views(f"SELECT path, round(avg(score), 9) AS score FROM ({_BEST}) WHERE r <= 3 GROUP BY path", "chunks_v"))
def l9(spark, d):
    return channels.best_average(bm25.score(V.chunks(spark, d).select("path", "chunk_no", "content"), "content", channels._counts(CONTENT_TEXT)))


@query("l10_document_rrf", V.with_views(rrf_sql("SELECT path, CAST(size AS DOUBLE) AS score FROM files_v ORDER BY score DESC, path LIMIT 100", 10.0), "files_v"))
def l10(spark, d):
    return channels.rrf(channels.top(V.files(spark, d).select("path", F.col("size").cast("double").alias("score")), 100), 10.0)


_L11 = f"SELECT path FROM ({chunk_sql([_phrase(PHRASE.split())], 500, 50.0)}) UNION SELECT path FROM ({chunk_sql(_CP, 50, 0.8, True)})"


@query("l11_match_set", V.with_views(_L11, "chunks_v"))
def l11(spark, d):
    counts = {"phrase": channels._phrase_counts(PHRASE), "fuzzy": channels._fuzzy_counts("idioti clownz")}
    c = bm25.Prepared(V.chunks(spark, d), "content", ["path", "chunk_no"], counts)  # one reading for both channels
    return channels.match_set(channels.content_phrase(c, PHRASE), channels.best_average(channels.fuzzy_chunks(c, "idioti clownz")))


_L12 = f"SELECT path, chunk_no, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_no) AS rank FROM ({bm25_sql('chunks_v', 'path, chunk_no, content', 'content', _CW)}) WHERE content <> '' AND path IN (SELECT path FROM files_v ORDER BY size DESC, path LIMIT 100)"


@query("l12_best_chunk", V.with_views(f"SELECT path, chunk_no, score, rank FROM ({_L12}) WHERE rank <= 3", "files_v", "chunks_v"))
def l12(spark, d):
    paths = V.files(spark, d).orderBy(F.desc("size"), "path").limit(100)
    return channels.best_chunks(V.chunks(spark, d), CONTENT_TEXT, paths, 3).select("path", "chunk_no", "score", "rank")


@query("f15_substring", V.with_views(_SUBSTR, "parts_v"))
def f15(spark, d):
    return channels.substring_match(V.parts(spark, d), PART_TEXT)


@query("f15_indexed", V.with_views(_SUBSTR, "parts_v"))
def f15_indexed(spark, d):
    return channels.substring_match(_path_index(spark, d), PART_TEXT)


_BATCH = """SELECT q AS query, path, chunk_no, round(sum(w), 9) AS score FROM (
    SELECT b.q, x.path, x.chunk_no, greatest(ln((n.n - df.df + 0.5) / (df.df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / n.a)) AS w
    FROM (SELECT path, chunk_no, dl, token, count(*) AS f FROM (SELECT path, chunk_no, len(t) AS dl, unnest(t) AS token FROM k) GROUP BY ALL) x
    JOIN b ON b.token = x.token JOIN (SELECT token, count(*) AS df FROM (SELECT DISTINCT path, chunk_no, unnest(t) AS token FROM k) GROUP BY token) df ON df.token = x.token,
    (SELECT count(*) AS n, avg(len(t)) AS a FROM k) n) GROUP BY ALL"""


@query("l6_keyword_batch", V.with_views(_BATCH, "chunks_v", more={"k": f"SELECT path, chunk_no, {_TOKENS.format('content')} AS t FROM chunks_v", "b": "SELECT * FROM (VALUES ('a', 'idiot'), ('a', 'clown'), ('b', 'loser'), ('c', 'pathetic'), ('c', 'moron')) t(q, token)"}))
def l6_batch(spark, d):
    c = V.chunks(spark, d).select(F.struct("path", "chunk_no").alias("key"), "content")
    sizes = c.select(F.size(bm25.tokens(F.col("content"))).alias("n")).agg(F.count("*").alias("n"), F.avg("n").alias("avgdl"))
    queries = spark.createDataFrame([("a", "idiot"), ("a", "clown"), ("b", "loser"), ("c", "pathetic"), ("c", "moron")], "query string, token string")
    return bm25.score_batch(bm25.postings(c, "key", "content", queries), sizes, queries, "key").select("query", "key.path", "key.chunk_no", "score")


_MERGED = f"SELECT path, round(sum(rrf), 9) AS score FROM (SELECT path, rrf * 1.0 AS rrf FROM ({path_sql('parts_v', _W, 3.0)}) UNION ALL SELECT path, rrf * 0.5 FROM ({path_sql('parts_v', _P, 1.5)})) GROUP BY path"


def _merged(spark, d):
    p = V.parts(spark, d)
    return ranking.merge([(channels.path_any(p, PART_TEXT), 1.0), (channels.path_prefix(p, PART_TEXT), 0.5)])


@query("r1_rrf_score", "SELECT i, w / (60.0 + i + 1) AS rrf FROM (SELECT CAST(o_orderkey % 50 AS BIGINT) AS i, CAST(o_orderkey % 7 AS DOUBLE) AS w FROM orders)")
def r1(spark, d):
    o = V.table(spark, d, "orders")
    i, w = F.col("o_orderkey") % 50, (F.col("o_orderkey") % 7).cast("double")
    return o.select(i.alias("i"), (w / (60.0 + i + 1)).alias("rrf"))


@query("r2_weighted_merge", V.with_views(_MERGED, "parts_v"))
def r2(spark, d):
    return _merged(spark, d)


def _filename_sql(path: str, query_words: list[str]) -> str:
    name = f"list_filter(string_split_regex(regexp_replace(lower(regexp_extract({path}, '[^/]*$')), '\\.[^./]*$', ''), '[-_. /]+'), lambda n: n <> '')"
    fits = "n = '{0}' OR starts_with(n, '{0}') OR starts_with('{0}', n) OR contains(n, '{0}') OR contains('{0}', n)"
    first = ["list_filter(" + name + ", lambda n: " + fits.format(w) + ")[1]" for w in query_words]
    tier = "CASE WHEN {1} IS NULL THEN 0.0 WHEN {1} = '{0}' THEN 0.30 WHEN starts_with({1}, '{0}') OR starts_with('{0}', {1}) THEN 0.10 ELSE 0.04 END"
    total = " + ".join(tier.format(w, f) for w, f in zip(query_words, first, strict=True))
    matched = " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in first)
    return f"({total} + CASE WHEN {matched} >= 2 THEN 0.60 * ({matched} - 1) ELSE 0.0 END)"


def _fuzzy_sql(path: str, query_words: list[str]) -> str:
    base = f"regexp_extract({path}, '[^/]*$')"
    names = f"list_filter(string_split_regex(lower({base}), '[-_. /]+'), lambda n: strlen(n) >= 3)"
    used = [w for w in query_words if len(w) >= 3]
    best = [f"coalesce(list_max(list_transform({names}, lambda n: 1 - levenshtein('{w}', n) / CAST(greatest(length(n), {len(w)}) AS DOUBLE))), 0.0)" for w in used]
    mean = f"(({' + '.join(best)}) / {len(query_words)})"
    return f"(CASE WHEN {mean} < 0.55 THEN 0.0 ELSE 0.15 * {mean} * least(1.0, {float(sum(map(len, used)))} / strlen({base})) END)"


@query("r3_filename_boost", V.with_views(f"SELECT path, round({_filename_sql('path', ['small', 'rin', '12'])}, 9) AS boost FROM parts_v", "parts_v"))
def r3(spark, d):
    return V.parts(spark, d).select("path", F.round(ranking.filename_boost(F.col("path"), "small rin 12"), 9).alias("boost"))


@query("r4_fuzzy_boost", V.with_views(f"SELECT path, round({_fuzzy_sql('path', TYPO.split())}, 9) AS boost FROM parts_v", "parts_v"))
def r4(spark, d):
    return V.parts(spark, d).select("path", F.round(ranking.fuzzy_boost(F.col("path"), TYPO), 9).alias("boost"))


_TYPED = "SELECT DISTINCT left(p_name, 1) || substr(p_name, 3) AS query FROM part"
_TYPO_BASE = "SELECT path, strlen(name) AS base, list_filter(string_split_regex(lower(name), '[-_. /]+'), lambda n: strlen(n) >= 3) AS names FROM parts_v"
_TYPO_ASKED = "SELECT query, list_filter(string_split_regex(lower(query), '[-_. /]+'), lambda w: w <> '') AS ws FROM q"
_TYPO_MEAN = """SELECT query, path, base, coalesce(list_sum(list_transform(list_filter(ws, lambda w: strlen(w) >= 3), lambda w: strlen(w))), 0) AS size,
    list_sum(list_transform(list_filter(ws, lambda w: strlen(w) >= 3), lambda w: coalesce(list_max(list_transform(names, lambda n: 1 - levenshtein(w, n) / CAST(greatest(length(n), length(w)) AS DOUBLE))), 0.0))) / len(ws) AS mean
    FROM a, b"""


@query("r4_typo_join", V.with_views("SELECT query, path, round(0.15 * mean * least(1.0, CAST(size AS DOUBLE) / base), 9) AS boost FROM m WHERE mean >= 0.55", "parts_v", more={"q": _TYPED, "a": _TYPO_ASKED, "b": _TYPO_BASE, "m": _TYPO_MEAN}))
def r4_join(spark, d):
    """Names of parts typed without their second letter, against all file names."""
    typed = V.table(spark, d, "part").select(F.concat(F.substr("p_name", F.lit(1), F.lit(1)), F.substr("p_name", F.lit(3))).alias("query")).distinct()
    return typos.fuzzy_boosts(typed, V.parts(spark, d)).withColumn("boost", F.round("boost", 9))


_DELTA = f"round(({_filename_sql('path', PART_TEXT.split())} + {_fuzzy_sql('path', PART_TEXT.split())}) * 0.8, 9)"
_BOOSTED = f"SELECT path, delta, round(score + delta, 9) AS score FROM (SELECT path, score, {_DELTA} AS delta FROM ({_MERGED}))"


@query("r5_boost_delta", V.with_views(_BOOSTED, "parts_v"))
def r5(spark, d):
    return ranking.boosted(_merged(spark, d), PART_TEXT, 0.8)


@query("r6_path_only_cap", V.with_views(f"SELECT f.path, CASE WHEN c.path IS NULL AND score > 0.12 AND delta < 0.10 THEN 0.12 ELSE score END AS score FROM (SELECT path, round(size / 20000.0, 9) AS score, doc_id % 3 * 0.06 AS delta FROM files_v) f LEFT JOIN (SELECT path FROM files_v ORDER BY size DESC, path LIMIT 50) c ON c.path = f.path", "files_v"))
def r6(spark, d):
    f = V.files(spark, d)
    content = f.orderBy(F.desc("size"), "path").limit(50)
    rows = f.select("path", F.round(F.col("size") / 20000.0, 9).alias("score"), (F.col("doc_id") % 3 * 0.06).alias("delta"))
    return ranking.capped(rows, content).select("path", "score")


_NOISE = "CASE WHEN regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN ({}) THEN 0.1 WHEN starts_with(lower(path), '/usr/lib/') OR starts_with(lower(path), '/usr/share/') THEN 0.05 ELSE 1.0 END".format(", ".join(f"'{x}'" for x in lists.BINARY))
_NOISY = "SELECT CASE WHEN doc_id % 11 = 0 THEN '/usr/lib/' || path WHEN doc_id % 13 = 0 THEN '/usr/share/' || path ELSE path END AS path, size FROM files_v"


@query("r7_noise_penalty", V.with_views(f"SELECT path, size * {_NOISE} AS score FROM ({_NOISY})", "files_v"))
def r7(spark, d):
    i = F.col("doc_id")
    f = V.files(spark, d).withColumn("path", F.when(i % 11 == 0, F.concat(F.lit("/usr/lib/"), "path")).when(i % 13 == 0, F.concat(F.lit("/usr/share/"), "path")).otherwise(F.col("path")))
    return f.select("path", (F.col("size") * ranking.noise_factor(F.col("path"))).alias("score"))


@query("r8_recency", V.with_views(f"SELECT path, round(0.3 * exp(-greatest(({V.NOW * V.NS} - mtime) / 86400000000000.0, 0.0) / 30.0), 9) AS boost FROM files_v", "files_v"))
def r8(spark, d):
    return V.files(spark, d).select("path", F.round(0.3 * ranking.recency(F.col("mtime"), V.NOW * V.NS), 9).alias("boost"))


_NEAR_WORDS = "list_filter(string_split_regex({0}, '[-_. /]+'), lambda n: n <> '')"
_STEM = "regexp_replace(lower(regexp_extract(path, '[^/]*$')), '\\.[^./]*$', '')"


def _near_sql(q: str) -> str:
    ws = [w for w in q.split() if w]
    hits = " + ".join(f"CASE WHEN len(list_filter({_NEAR_WORDS.format(_STEM)}, lambda n: n = '{w}'" + (f" OR 1 - levenshtein('{w}', n) / CAST(greatest(length(n), {len(w)}) AS DOUBLE) >= 0.8" if len(w) >= 4 else "") + ")) > 0 THEN 1 ELSE 0 END" for w in ws)
    return f"({_STEM} = '{q}' OR contains({_STEM}, '{q}') OR ({hits}) * 5 >= {len(ws) * 4})"


_CODE = ", ".join(f"'{x}'" for x in lists.CODE)


@query("r9_code_penalty", V.with_views(f"SELECT path, round(CASE WHEN regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN ({_CODE}) AND NOT {_near_sql('smal ring')} AND p_partkey % 9 <> 0 THEN size * 0.12 ELSE size END, 9) AS score FROM parts_v", "parts_v"))
def r9(spark, d):
    p = V.parts(spark, d)
    return ranking.code_penalised(p.select("path", F.col("size").cast("double").alias("score")), "smal ring", p.where("p_partkey % 9 = 0"))


@query("r10_name_near_query", V.with_views(f"SELECT path, {_near_sql('smal ring')} AS near FROM parts_v", "parts_v"))
def r10(spark, d):
    return V.parts(spark, d).select("path", ranking.near_query(F.col("path"), "smal ring").alias("near"))


_TIME = "strftime(make_timestamp(mtime // 1000), '%Y-%m-%dT%H:%M:%SZ')"


@query("r11_metadata", V.with_views(f"SELECT s.path, score, coalesce(size, 0) AS size, coalesce({_TIME}, '') AS modified FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'gone/' || path ELSE path END AS path, size / 2.0 AS score FROM files_v) s LEFT JOIN files_v f ON f.path = s.path", "files_v"))
def r11(spark, d):
    f = V.files(spark, d)
    s = f.select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")).alias("path"), (F.col("size") / 2).alias("score"))
    return ranking.attached(s, f).select("path", "score", "size", "modified")


_TOP = "SELECT path, CAST(size AS DOUBLE) AS score, doc_id FROM files_v ORDER BY score DESC, path LIMIT 40"
_LOGITS = "SELECT path, CAST(doc_id % 9 AS DOUBLE) - 4 + j AS logit FROM top_v, (VALUES (0), (1), (2)) t(j)"


def _top(spark, d):
    return V.files(spark, d).select("path", F.col("size").cast("double").alias("score"), "doc_id").orderBy(F.desc("score"), "path").limit(40)


def _logits(spark, d):
    return _top(spark, d).select("path", F.explode(F.array(*(F.lit(j) for j in range(3)))).alias("j"), "doc_id").select("path", ((F.col("doc_id") % 9).cast("double") - 4 + F.col("j")).alias("logit"))


_BLEND = """SELECT path, round(CASE WHEN r <= 8 AND p IS NOT NULL THEN 0.5 * p + 0.5 * score / (SELECT max(score) FROM top_v) ELSE score END, 9) AS score
    FROM (SELECT t.path, score, p, row_number() OVER (ORDER BY score DESC, t.path) AS r FROM top_v t LEFT JOIN (SELECT path, max(1 / (1 + exp(-logit))) AS p FROM logit_v GROUP BY path) l ON l.path = t.path)"""


@query("r12_rerank_blend", V.with_views(_BLEND, "files_v", more={"top_v": _TOP, "logit_v": _LOGITS}))
def r12(spark, d):
    return ranking.reranked(_top(spark, d).select("path", "score"), _logits(spark, d))


_SLOTS = "SELECT path, row_number() OVER (ORDER BY score DESC, path) AS slot, ends_with(path, '.png') AS image, doc_id FROM top_v"
_INTER = """SELECT path, slot FROM s WHERE image UNION ALL SELECT a.path, b.slot FROM
    (SELECT path, row_number() OVER (ORDER BY doc_id DESC, path) AS n FROM s WHERE NOT image) a JOIN (SELECT slot, row_number() OVER (ORDER BY slot) AS n FROM s WHERE NOT image) b ON a.n = b.n"""


@query("r13_interleave", V.with_views(_INTER, "files_v", more={"top_v": _TOP, "s": f"SELECT * FROM ({_SLOTS}) WHERE slot <= 16"}))
def r13(spark, d):
    t = _top(spark, d)
    return ranking.interleaved(t.select("path", "score"), t.select("path", F.col("doc_id").cast("double").alias("score")), 16)


@query("r14_candidate_scores", V.with_views("SELECT path, round(max(1 / (1 + exp(-logit))), 9) AS score FROM logit_v GROUP BY path", "files_v", more={"top_v": _TOP, "logit_v": _LOGITS}))
def r14(spark, d):
    return _logits(spark, d).groupBy("path").agg(F.round(F.max(1 / (1 + F.exp(-F.col("logit")))), 9).alias("score"))


_LEGACY = f"SELECT path, least(score, CASE WHEN delta < 0.10 THEN 0.12 ELSE score END) AS score FROM ({_BOOSTED})"


@query("r15_legacy_cap", V.with_views(_LEGACY, "parts_v"))
def r15(spark, d):
    scores = ranking.boosted(_merged(spark, d), PART_TEXT, 0.8)
    return ranking.capped(scores, scores.limit(0)).select("path", "score")


def full_sql(view: str, files: str, recent: bool, near: dict[str, str] | None = None, keep: str = "WHERE size <= 20000") -> str:
    """The composite search over documents for a content query of three words; near: further channels by name, whose paths count as content."""
    near = near or {}
    ws = CONTENT_TEXT.split()
    channels_ = [
        path_sql(files, [_word(w) for w in ws], 3.0), path_sql(files, [_word(w) for w in ws], 4.0, True), path_sql(files, [_prefix(w) for w in ws], 1.5),
        path_sql(files, [_prefix(w[:4]) for w in ws if len(w) >= 4], 1.0, True),
    ]
    sub = rrf_sql("SELECT path, 0.0 AS score FROM (SELECT DISTINCT path FROM files_v WHERE " + " OR ".join(f"contains(lower(path), '{w}')" for w in ws) + " ORDER BY path LIMIT 30)", 0.75)
    gate = f"SELECT * FROM ({sub}) WHERE (SELECT count(DISTINCT path) FROM (" + " UNION ALL ".join(f"SELECT path FROM ({c})" for c in channels_) + ")) < 20"
    phrase, keyword, fuzzy = chunk_sql([_phrase(ws)], 500, 50.0), chunk_sql([_word(w) for w in ws], 400, 10.0), chunk_sql([_prefix(w[:4]) for w in ws], 50, 0.8, True)
    gated = f"SELECT * FROM ({fuzzy}) WHERE (SELECT count(DISTINCT path) FROM (SELECT path FROM ph UNION ALL SELECT path FROM kw)) < 5"
    views = {"ph": phrase, "kw": keyword, "fz": gated, **near, "content": " UNION ".join(f"SELECT path FROM {n}" for n in ("ph", "kw", "fz", *near))}
    alls = " UNION ALL ".join(f"SELECT path, rrf FROM ({c})" for c in [*channels_, gate]) + " UNION ALL " + " UNION ALL ".join(f"SELECT path, rrf FROM {n}" for n in ("ph", "kw", "fz", *near))
    views["merged"] = f"SELECT path, round(sum(rrf), 9) AS score FROM ({alls}) GROUP BY path"
    views["boosted"] = f"SELECT path, delta, round(score + delta, 9) AS score FROM (SELECT path, score, round({_filename_sql('path', ws)} + {_fuzzy_sql('path', ws)}, 9) AS delta FROM merged)"
    views["held"] = f"SELECT b.path, (CASE WHEN c.path IS NULL AND score > 0.12 AND delta < 0.10 THEN 0.12 ELSE score END) * {_NOISE.replace('path', 'b.path')} AS score FROM boosted b LEFT JOIN content c ON c.path = b.path"
    boost = f" + 0.3 * exp(-greatest(({V.NOW * V.NS} - mtime) / 86400000000000.0, 0.0) / 30.0)" if recent else ""
    views["dated"] = f"SELECT h.path, round(score{boost}, 9) AS score, size, mtime FROM held h LEFT JOIN files_v f ON f.path = h.path"
    code = f"regexp_extract(lower(path), '(\\.[^./]*)$', 1) IN ({_CODE}) AND NOT {_near_sql(CONTENT_TEXT)} AND path NOT IN (SELECT path FROM ph UNION ALL SELECT path FROM fz)"
    return V.with_views(f"SELECT path, round(CASE WHEN {code} THEN score * 0.12 ELSE score END, 9) AS score, coalesce(size, 0) AS size, coalesce({_TIME}, '') AS modified FROM dated {keep}", "files_v", "chunks_v", *(["vec_v"] if near else []), more=views)


@query("search_hybrid_lexical", full_sql("chunks_v", "files_v", True))
def search_lexical(spark, d):
    found = search(V.files(spark, d), V.chunks(spark, d), CONTENT_TEXT + " size:0b-20000b", V.NOW * V.NS)
    return found.select("path", "score", "size", "modified")


@query("search_indexed", full_sql("chunks_v", "files_v", True))
def search_indexed(spark, d):
    """The same search over an index that is written first and read back."""
    folder = shared_folder(spark, "index")
    bm25.indexed(V.chunks(spark, d), "content", ["path", "chunk_no"]).save(folder)
    found = search(V.files(spark, d), bm25.Index.load(spark, folder), CONTENT_TEXT + " size:0b-20000b", V.NOW * V.NS)
    return found.select("path", "score", "size", "modified")


def _segments(spark, d):
    return Segments.create(spark, shared_folder(spark, "segments")).upserted(V.chunks(spark, d))


@query("l6_block_bounded", V.with_views(chunk_sql(_CW, 400, 10.0), "chunks_v"))
def l6_blocks(spark, d):
    """The keyword channel over an index in segments, blocks skipped by their bounds."""
    return channels.content_keyword(channels.prepared_chunks(_segments(spark, d), CONTENT_TEXT), CONTENT_TEXT)


@query("search_segments", full_sql("chunks_v", "files_v", True))
def search_segments(spark, d):
    """The same search over segments of chunks and an index of the paths."""
    files, folder = V.files(spark, d), shared_folder(spark, "paths")
    path_index.indexed(files).save(folder)
    found = search(files, _segments(spark, d), CONTENT_TEXT + " size:0b-20000b", V.NOW * V.NS, paths=path_index.PathIndex.load(spark, folder))
    return found.select("path", "score", "size", "modified")


_KEPT = """SELECT CASE WHEN doc_id % 5 = 0 THEN 'moved/' || path ELSE path END AS path, chunk_no, content FROM chunks_v WHERE doc_id % 7 <> 0 AND (doc_id % 11 <> 0 OR doc_id % 5 = 0)
    UNION ALL SELECT path, chunk_no, content FROM chunks_v WHERE doc_id % 11 = 0 AND chunk_no < 2"""


@query("m2_segments", V.with_views(f"SELECT * FROM ({bm25_sql('kept_v', 'path, chunk_no', 'content', _CW)}) ORDER BY score DESC, path, chunk_no LIMIT 400", "chunks_v", more={"kept_v": _KEPT}))
def m2_segments(spark, d):
    """Upserts, deletes, renames and a compaction of an index in segments, then a search."""
    c = V.chunks(spark, d)
    index = Segments.create(spark, shared_folder(spark, "segments"))
    for i in range(3):
        index = index.upserted(c.where(f"doc_id % 3 = {i}"))
    files = V.files(spark, d)
    index = index.deleted(files.where("doc_id % 7 = 0"))
    index = index.renamed(files.where("doc_id % 5 = 0").select(F.col("path").alias("old"), F.concat(F.lit("moved/"), "path").alias("new")))
    index = index.upserted(c.where("doc_id % 11 = 0 AND chunk_no < 2")).compacted(fan=3)
    return index.best(CONTENT_TEXT.split(), 400)


_NEAR = {f"near_{c}": _knn_sql(c, n, lists.WEIGHTS[f"w_semantic_{c}"]) for c, n in (("text", 200), ("image", 50))}


@query("search_with_vectors", full_sql("chunks_v", "files_v", True, _NEAR, ""))
def search_vectors(spark, d):
    v = V.vectors(spark, d)
    vector = v.where("vec_id = 0").first()["vector"]
    return search(V.files(spark, d), V.chunks(spark, d), CONTENT_TEXT, V.NOW * V.NS, v, vector).select("path", "score", "size", "modified")


_TEXT = f"SELECT path, round(sum(rrf), 9) AS score FROM (SELECT * FROM ({path_sql('files_v', _CW, 3.0)}) UNION ALL SELECT * FROM ({chunk_sql(_CW, 400, 10.0)})) GROUP BY path"


@query("r16_text_search", V.with_views(f"SELECT path, round(score + round(({_filename_sql('path', CONTENT_TEXT.split())} + {_fuzzy_sql('path', CONTENT_TEXT.split())}) * 1.0, 9), 9) AS score FROM ({_TEXT})", "files_v", "chunks_v"))
def r16(spark, d):
    return text_search(V.files(spark, d), V.chunks(spark, d), CONTENT_TEXT)


# --- many queries at once ------------------------------------------------------------------

_ASKED = "SELECT DISTINCT array_to_string(string_split_regex(text, '\\s+')[1:3], ' ') AS query FROM benchmark WHERE text IS NOT NULL"
_PHRASES = f"SELECT query, phrase, count(*) AS times FROM (SELECT query, {_TOKENS.format('w')} AS phrase FROM (SELECT query, unnest(string_split_regex(query, '\\s+')) AS w FROM asked_v)) WHERE len(phrase) > 0 GROUP BY ALL"


def _batch_sql(view: str, keys: str, text: str) -> str:
    """query, keys, score for every query of phrases_v."""
    found = f"SELECT {keys}, len(t) AS dl, phrase, len(list_filter(range(1, len(t) - len(phrase) + 2), lambda i: t[i:i + len(phrase) - 1] = phrase)) AS f FROM (SELECT {keys}, {_TOKENS.format(text)} AS t FROM {view}) x JOIN (SELECT DISTINCT phrase FROM phrases_v) p ON list_contains(x.t, p.phrase[1])"
    figures = f"SELECT count(*) AS n, avg(len({_TOKENS.format(text)})) AS a FROM {view}"
    part = "times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * CAST(f AS DOUBLE) * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / a))"
    return f"WITH c AS (SELECT * FROM ({found}) WHERE f > 0), h AS (SELECT phrase, count(*) AS df FROM c GROUP BY phrase) SELECT query, {keys}, round(sum({part}), 9) AS score FROM c JOIN h USING (phrase) JOIN phrases_v USING (phrase), ({figures}) GROUP BY query, {keys}"


def _rank_sql(rows: str, order: str, limit: int) -> str:
    return f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, {order}) AS r FROM ({rows})) WHERE r <= {limit}"


def _batch_rrf(rows: str, boost: float) -> str:
    return f"SELECT query, path, {boost} / (60.0 + row_number() OVER (PARTITION BY query ORDER BY score DESC, path)) AS rrf FROM ({rows})"


_BEST3 = f"SELECT query, path, round(avg(score), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query, path ORDER BY score DESC, chunk_no) AS b FROM ({_rank_sql(_batch_sql('chunks_v', 'path, chunk_no', 'content'), 'path, chunk_no', 400)})) WHERE b <= 3 GROUP BY query, path"
_BOTH = f"SELECT query, path, round(sum(rrf), 9) AS score FROM (SELECT * FROM ({_batch_rrf(_rank_sql(_batch_sql('files_v', 'path', 'path'), 'path', 20), 3.0)}) UNION ALL SELECT * FROM ({_batch_rrf(_BEST3, 10.0)})) GROUP BY query, path"
_SPLIT = "list_filter(string_split_regex(lower({0}), '[-_. /]+'), lambda w: strlen(w) >= {1})"
_WORTH = "CASE WHEN {n} = {q} THEN 0.30 WHEN starts_with({n}, {q}) OR starts_with({q}, {n}) THEN 0.10 WHEN contains({n}, {q}) OR contains({q}, {n}) THEN 0.04 END"
_NAMED = f"""SELECT query, path, score, list_filter(list_transform({_SPLIT.format('query', 2)}, lambda q: list_filter(list_transform(stems, lambda n: {_WORTH.format(n='n', q='q')}), lambda x: x IS NOT NULL)[1]), lambda x: x IS NOT NULL) AS kinds,
    coalesce(list_sum(list_transform({_SPLIT.format('query', 3)}, lambda q: coalesce(list_max(list_transform(names, lambda n: 1 - levenshtein(strip_accents(q), strip_accents(n)) / CAST(greatest(length(n), length(q)) AS DOUBLE))), 0.0))), 0.0) / len({_SPLIT.format('query', 1)}) AS mean,
    coalesce(list_sum(list_transform({_SPLIT.format('query', 3)}, lambda q: strlen(q))), 0) / CAST(strlen(base) AS DOUBLE) AS cover
    FROM (SELECT *, regexp_extract(path, '[^/]*$') AS base, list_filter(string_split_regex(regexp_replace(lower(regexp_extract(path, '[^/]*$')), '\\.[^./]*$', ''), '[-_. /]+'), lambda w: w <> '') AS stems,
        {_SPLIT.format("regexp_extract(path, '[^/]*$')", 3)} AS names FROM both_v)"""
_BATCH_SEARCH = "SELECT query, path, round(score + round(coalesce(list_sum(kinds), 0.0) + CASE WHEN len(kinds) >= 2 THEN 0.6 * (len(kinds) - 1) ELSE 0.0 END + CASE WHEN mean < 0.55 THEN 0.0 ELSE 0.15 * mean * least(1.0, cover) END, 9), 9) AS score FROM named_v"
_BATCH_VIEWS = {"asked_v": _ASKED, "phrases_v": _PHRASES, "both_v": _BOTH, "named_v": _NAMED}


def _asked(spark, d):
    """The first three words of each benchmark item."""
    return V.table(spark, d, "benchmark").where("text is not null").select(F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 3)).alias("query")).distinct()


@query("r16_batch_search", V.with_views(_BATCH_SEARCH, "files_v", "chunks_v", more=_BATCH_VIEWS))
def r16_batch(spark, d):
    return batch.text_search(V.files(spark, d), V.chunks(spark, d), _asked(spark, d))


_E2_VIEWS = {
    **_BATCH_VIEWS, "found_v": _BATCH_SEARCH,
    "best_v": "SELECT query, path, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM found_v QUALIFY rank <= 10",
    "ranked": "SELECT a.query, coalesce(b.path, '') AS path, coalesce(b.rank, 1) AS rank FROM asked_v a LEFT JOIN best_v b ON b.query = a.query",
    "items_v": "SELECT array_to_string(string_split_regex(text, '\\s+')[1:3], ' ') AS query, min(item_id) AS item_id FROM benchmark WHERE text IS NOT NULL GROUP BY 1",
    "qrels": "SELECT i.query, f.path, 3.0 * quality AS gain FROM labels l JOIN files_v f ON f.doc_id = l.doc_id JOIN items_v i ON i.item_id = l.doc_id % (SELECT count(*) FROM benchmark)",
}


@query("e2_batch_evaluation", V.with_views(f"SELECT m.*, CASE WHEN length(query) < 12 THEN 'short' ELSE 'long' END AS category FROM ({_METRICS}) m", "files_v", "chunks_v", more=_E2_VIEWS))
def e2_batch(spark, d):
    """NDCG, recall and MRR of the batched search, for all queries at once."""
    items, b = _asked(spark, d), V.table(spark, d, "benchmark").where("text is not null")
    of = b.select(F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 3)).alias("query"), "item_id").groupBy("query").agg(F.min("item_id").alias("item_id"))
    count = F.broadcast(V.table(spark, d, "benchmark").agg(F.count("*").alias("n")))  # one row
    bound = V.table(spark, d, "labels").crossJoin(count).select("doc_id", "quality", (F.col("doc_id") % F.col("n")).alias("item_id"))
    relevant = bound.join(V.files(spark, d).select("doc_id", "path"), "doc_id").join(of, "item_id").select("query", "path", (F.col("quality") * 3.0).alias("gain"))
    queries = items.withColumn("category", F.when(F.length("query") < 12, "short").otherwise("long"))
    search_all = lambda qs: batch.text_search(V.files(spark, d), V.chunks(spark, d), qs)
    return evaluation.evaluate_batch(search_all, queries, relevant)[0].select("query", "category", *(F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")))
