"""Queries of metrics, feedback, weights, index maintenance and change events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sondage.functions import lists
from sondage.functions.json import json_set, json_value
from sondage.functions.text import epoch_seconds
from sondage.operators import chunking
from sondage.operators import feedback as E
from sondage.operators import maintenance as M
from sondage.sources import views as V
from sondage.streaming import changes as C

from .registry import query

# --- aggregates ----------------------------------------------------------------------------

_SCORED = "SELECT 'q' || (doc_id % 40) AS query, path, doc_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY size DESC, path) AS rank FROM files_v"
_QRELS = "SELECT 'q' || (f.doc_id % 40) AS query, path, 3.0 * quality AS gain FROM labels l JOIN files_v f ON f.doc_id = l.doc_id"
_METRICS = """SELECT r.query, round(CASE WHEN b.n IS NULL THEN 1.0 ELSE coalesce(h.dcg / b.best, 0.0) END, 6) AS ndcg, round(CASE WHEN b.n IS NULL THEN 1.0 ELSE coalesce(h.hits / CAST(b.n AS DOUBLE), 0.0) END, 6) AS recall,
    round(CASE WHEN b.n IS NULL THEN 1.0 ELSE coalesce(1.0 / h.first, 0.0) END, 6) AS mrr
    FROM (SELECT DISTINCT query FROM ranked) r
    LEFT JOIN (SELECT query, sum(CASE WHEN i <= 10 THEN (2.0 ** gain - 1) / log2(i + 1) ELSE 0 END) AS best, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, path) AS i FROM qrels WHERE gain > 0) GROUP BY query) b ON b.query = r.query
    LEFT JOIN (SELECT k.query, sum((2.0 ** gain - 1) / log2(rank + 1)) AS dcg, count(*) AS hits, min(rank) AS first FROM ranked k JOIN qrels g ON g.query = k.query AND g.path = k.path AND gain > 0 WHERE rank <= 10 GROUP BY k.query) h ON h.query = r.query"""


def _ranked(spark, d):
    f = V.files(spark, d).withColumn("query", F.concat(F.lit("q"), (F.col("doc_id") % 40).cast("string")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("size"), "path"))
    return f.select("query", "path", "doc_id", rank.alias("rank"))


def _qrels(spark, d):
    r = _ranked(spark, d)
    return V.table(spark, d, "labels").join(r, "doc_id").select("query", "path", (F.col("quality") * 3.0).alias("gain"))


_MV = {"ranked": _SCORED, "qrels": _QRELS}


@query("e1_metrics", V.with_views(_METRICS, "files_v", more=_MV))
def e1(spark, d):
    return E.metrics(_ranked(spark, d), _qrels(spark, d))


@query("a9_category_means", V.with_views(f"SELECT CAST(substr(query, 2) AS INTEGER) % 7 AS category, round(avg(ndcg) + 1e-9, 6) AS ndcg, round(avg(mrr) + 1e-9, 6) AS mrr, count(*) AS n FROM ({_METRICS}) GROUP BY 1", "files_v", more=_MV))
def a9(spark, d):
    """Means of six-place figures may lie halfway between two; the small addition rounds them up whatever the order of summation."""
    m = E.metrics(_ranked(spark, d), _qrels(spark, d))
    return m.groupBy((F.substr("query", F.lit(2)).cast("int") % 7).alias("category")).agg(F.round(F.avg("ndcg") + 1e-9, 6).alias("ndcg"), F.round(F.avg("mrr") + 1e-9, 6).alias("mrr"), F.count("*").alias("n"))


@query("a3_max_by_key", "SELECT user_id, max(value) AS best FROM events GROUP BY user_id")
def a3(spark, d):
    return V.table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("best"))


@query("a4_existence", V.with_views("SELECT count(*) AS n, count(*) FILTER (WHERE content_indexed = 0) > 0 AS waiting FROM files_v", "files_v"))
def a4(spark, d):
    return V.files(spark, d).agg(F.count("*").alias("n"), (F.sum((F.col("content_indexed") == 0).cast("long")) > 0).alias("waiting"))


@query("a5_first_wins", "SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def a5(spark, d):
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    return V.table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r = 1").select("event_type", "event_id", "user_id")


@query("a6_votes_by_query", V.with_views("SELECT query, count(*) AS votes, sum(feedback) AS total FROM feedback_v GROUP BY query", "feedback_v"))
def a6(spark, d):
    return V.feedback(spark, d).groupBy("query").agg(F.count("*").alias("votes"), F.sum("feedback").alias("total"))


@query("a7_weighted_means", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY l_returnflag")
def a7(spark, d):
    return V.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 9).alias("mean"))


@query("a8_percentiles", "SELECT event_type, max(value) FILTER (WHERE r = n * 50 // 100 + 1) AS p50, max(value) FILTER (WHERE r = n * 95 // 100 + 1) AS p95 FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r FROM events) GROUP BY event_type")
def a8(spark, d):
    return E.nearest_rank(V.table(spark, d, "events"), "event_type", "value", [50, 95])


@query("a10_atime_probe", V.with_views("SELECT count(*) FILTER (WHERE atime <> 0) >= 10 AND min(atime) <> max(atime) AS enabled FROM (SELECT atime FROM files_v ORDER BY path LIMIT 100)", "files_v"))
def a10(spark, d):
    some = V.files(spark, d).orderBy("path").limit(100)
    return some.agg(((F.sum((F.col("atime") != 0).cast("int")) >= 10) & (F.min("atime") != F.max("atime"))).alias("enabled"))


@query("a11_argmax", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def a11(spark, d):
    return V.table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(1).select("p_partkey", "p_retailprice")


# --- feedback and weights ------------------------------------------------------------------

_WEIGHT = f"2.0 ** (-greatest({V.NOW} - created_at, 0) / 604800.0)"
_LATEST = f"SELECT * FROM (SELECT *, round({_WEIGHT}, 9) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY query, path ORDER BY created_at DESC, id DESC) AS r FROM feedback_v) WHERE r = 1 AND feedback <> 0) WHERE weight > 0"
_VIEWS = ("feedback_v",)
_RANK = "SELECT query, path, row_number() OVER (PARTITION BY query ORDER BY md5(query || path), path) AS rank FROM (SELECT DISTINCT query, path FROM feedback_v)"


def _rank(spark, d):
    r = V.feedback(spark, d).select("query", "path").distinct()
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.md5(F.concat("query", "path")), "path")))


def _votes(spark, d):
    return E.latest_votes(V.feedback(spark, d), V.NOW)


@query("s8_feedback_readback", V.with_views("SELECT query, feedback, count(*) AS n, max(created_at) AS last FROM feedback_v GROUP BY query, feedback", *_VIEWS))
def s8(spark, d):
    return V.feedback(spark, d).groupBy("query", "feedback").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))


@query("e3_feedback_decay", V.with_views(f"SELECT id, round({_WEIGHT}, 9) AS weight FROM feedback_v", *_VIEWS))
def e3(spark, d):
    return V.feedback(spark, d).select("id", F.round(E.vote_weight(F.col("created_at"), V.NOW), 9).alias("weight"))


@query("e4_latest_vote", V.with_views(f"SELECT id, query, path, feedback, weight FROM ({_LATEST})", *_VIEWS))
def e4(spark, d):
    return _votes(spark, d).select("id", "query", "path", "feedback", "weight")


@query("e5_vote_gate", V.with_views(f"SELECT count(*) >= 10 AS enough, count(*) AS votes FROM ({_LATEST})", *_VIEWS))
def e5(spark, d):
    return E.enough(_votes(spark, d))


_POSITIVE = """SELECT u.query, round(sum(CASE WHEN rank <= 10 THEN 7.0 * weight / log2(rank + 1) ELSE 0 END) / any_value(ideal), 6) AS ndcg, round(coalesce(max(weight / rank / top), 0.0), 6) AS mrr,
    round(sum(CASE WHEN rank <= 8 THEN weight ELSE 0.0 END) / any_value(total), 6) AS recall
    FROM (SELECT * FROM v WHERE feedback > 0) u LEFT JOIN r ON r.query = u.query AND r.path = u.path
    JOIN (SELECT query, sum(CASE WHEN i <= 10 THEN 7.0 * weight / log2(i + 1) ELSE 0 END) AS ideal, max(weight) AS top, sum(weight) AS total
        FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY weight DESC, path) AS i FROM v WHERE feedback > 0) GROUP BY query) b ON b.query = u.query GROUP BY u.query"""


@query("e6_positive_metrics", V.with_views(_POSITIVE, *_VIEWS, more={"v": _LATEST, "r": _RANK}))
def e6(spark, d):
    return E.positive_metrics(_rank(spark, d), _votes(spark, d))


_HASH = "(CAST('0x' || substr(md5(query || path || '{i}'), 1, 4) AS BIGINT) / 65536.0)"
_SIG = [f"{_HASH.format(i=i)} AS {s}" for i, s in enumerate(E.SIGNALS)]
_MORE = f"CASE WHEN {_HASH.format(i=6)} < 0.75 THEN {_HASH.format(i=5)} END AS reranker, CASE WHEN {_HASH.format(i=7)} < 0.25 THEN 0.5 ELSE 1.0 END::DOUBLE AS code"
_SIGNALS = f"SELECT query, path, {', '.join(_SIG)}, {_MORE} FROM (SELECT DISTINCT query, path FROM feedback_v)"


def _signals(spark, d):
    h = lambda i: F.conv(F.substr(F.md5(F.concat("query", "path", F.lit(str(i)))), F.lit(1), F.lit(4)), 16, 10).cast("double") / 65536.0
    more = F.when(h(6) < 0.75, h(5)).alias("reranker"), F.when(h(7) < 0.25, 0.5).otherwise(1.0).alias("code")
    return V.feedback(spark, d).select("query", "path").distinct().select("query", "path", *(h(i).alias(s) for i, s in enumerate(E.SIGNALS)), *more)


_W = lists.WEIGHTS


def _grid_sql() -> str:
    f = "(VALUES " + ", ".join(f"({i}, {x})" for i, x in enumerate(E.FACTORS)) + ")"
    tables = ", ".join(f"{f} g{i}(i, x)" for i in range(5)) + ", (VALUES " + ", ".join(f"({i}, {b})" for i, b in enumerate(E.BLENDS)) + ") b(i, x)"
    n, m = len(E.FACTORS), len(E.BLENDS)
    number = f"((((g0.i * {n} + g1.i) * {n} + g2.i) * {n} + g3.i) * {n} + g4.i) * {m} + b.i"
    weights = ", ".join(f"CAST({_W[s]} AS DOUBLE) * CAST(g{i}.x AS DOUBLE) AS {s}" for i, s in enumerate(E.SIGNALS))
    return f"SELECT CAST({number} AS INTEGER) AS candidate, {weights}, least(1.0, greatest(0.0, CAST({_W['w_reranker_blend']} AS DOUBLE) + CAST(b.x AS DOUBLE))) AS blend FROM {tables}"


_TOTAL = " + ".join(f"s.{s} * g.{s}" for s in E.SIGNALS)
_TOTALS = f"SELECT g.candidate, g.blend, s.query, s.path, s.reranker, s.code, {_TOTAL} AS total FROM s, g"
_TOPS = "SELECT candidate, query, greatest(max(total), 1e-9) AS top, count(reranker) > 0 AS known FROM t GROUP BY ALL"
_BLENDED = "code * CASE WHEN blend > 0 AND known THEN (1 - blend) * (total / top) + blend * coalesce(reranker, 0) ELSE total END"
_RANKED = f"SELECT * FROM (SELECT candidate, query, path, row_number() OVER (PARTITION BY candidate, query ORDER BY score DESC, path) AS rank FROM (SELECT candidate, query, path, round({_BLENDED}, 9) AS score FROM t JOIN o USING (candidate, query))) WHERE rank <= 10"
_GRID = {"s": _SIGNALS, "g": _grid_sql(), "t": _TOTALS, "o": _TOPS, "k": _RANKED}
_OBJECTIVE = """SELECT candidate, round(sum(val * w) / sum(w), 9) AS objective FROM (SELECT x.candidate, x.query, b.w,
        0.45 * coalesce(dcg / ideal, 0) + 0.30 * coalesce(rr / top, 0) + 0.20 * coalesce(found / up, 0) - 1.25 * down / b.w AS val
    FROM (SELECT k.candidate, k.query, sum(CASE WHEN feedback > 0 THEN weight / log2(rank + 1) ELSE 0 END) AS dcg, max(CASE WHEN feedback > 0 THEN weight / rank END) AS rr,
            sum(CASE WHEN feedback > 0 AND rank <= 8 THEN weight ELSE 0 END) AS found, sum(CASE WHEN feedback < 0 THEN weight / log2(rank + 1) ELSE 0 END) AS down
        FROM k LEFT JOIN v ON v.query = k.query AND v.path = k.path GROUP BY k.candidate, k.query) x
    JOIN (SELECT v.query, sum(weight) AS w, any_value(ideal) AS ideal, any_value(top) AS top, any_value(up) AS up FROM v LEFT JOIN
        (SELECT query, sum(CASE WHEN i <= 10 THEN weight / log2(i + 1) ELSE 0 END) AS ideal, max(weight) AS top, sum(weight) AS up
        FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY weight DESC, path) AS i FROM v WHERE feedback > 0) GROUP BY query) p ON p.query = v.query GROUP BY v.query) b ON b.query = x.query) GROUP BY candidate"""


_FIRSTS = "SELECT candidate, query, max(CASE WHEN rank = 1 THEN path END) AS first, max(CASE WHEN rank = 10 THEN path END) AS tenth, count(*) AS n FROM k GROUP BY candidate, query"


@query("e7_signal_ranking", V.with_views(_FIRSTS, *_VIEWS, more=_GRID))
def e7(spark, d):
    ranked = E.ranked_by(_signals(spark, d), E.candidates(spark, _W))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("path")))
    return ranked.groupBy("candidate", "query").agg(at(1).alias("first"), at(10).alias("tenth"), F.count("*").alias("n"))


@query("e8_objective", V.with_views(_OBJECTIVE, *_VIEWS, more={"v": _LATEST, **_GRID}))
def e8(spark, d):
    return E.objective(E.ranked_by(_signals(spark, d), E.candidates(spark, _W)), _votes(spark, d))


_BEST = f"SELECT candidate, objective FROM ({_OBJECTIVE}) ORDER BY objective DESC, candidate LIMIT 1"


@query("e9_grid_search", V.with_views(_BEST, *_VIEWS, more={"v": _LATEST, **_GRID}))
def e9(spark, d):
    return E.best_candidate(e8(spark, d))


_WON = " UNION ALL ".join(f"SELECT '{c}' AS key, {'blend' if c == 'w_reranker_blend' else c} AS new FROM g JOIN w USING (candidate) WHERE candidate <> {E.current_candidate()}" for c in (*E.SIGNALS, "w_reranker_blend"))


@query("e10_publish", V.with_views(f"SELECT coalesce(c.key, n.key) AS key, CAST(coalesce(n.new, c.value) AS DOUBLE) AS value FROM config_v c FULL JOIN ({_WON}) n ON n.key = c.key", *_VIEWS, "config_v", more={"v": _LATEST, **_GRID, "w": _BEST}))
def e10(spark, d):
    return E.published(V.config(spark), E.candidates(spark, _W), E.best_candidate(e8(spark, d)), E.current_candidate())


_LOADED = "SELECT c.key, CAST(CASE WHEN s.key IS NULL OR (s.key = 'rrf_k' AND s.value <= 0) OR (s.key = 'rerank_top_n' AND s.value < 1) THEN c.value WHEN s.key = 'w_reranker_blend' THEN least(greatest(s.value, 0.0), 1.0) ELSE s.value END AS DOUBLE) AS value FROM config_v c LEFT JOIN stored_v s ON s.key = c.key"


@query("e11_weight_load", V.with_views(_LOADED, "config_v", "stored_v"))
def e11(spark, d):
    return E.loaded(V.stored(spark, d), V.config(spark))


@query("e12_weight_deltas", V.with_views(f"SELECT l.key, CAST(round(l.value - c.value, 9) AS DOUBLE) AS delta FROM ({_LOADED}) l JOIN config_v c ON c.key = l.key WHERE round(l.value - c.value, 9) <> 0", "config_v", "stored_v"))
def e12(spark, d):
    return E.deltas(E.loaded(V.stored(spark, d), V.config(spark)), V.config(spark))


@query("e13_migration", V.with_views("SELECT key, CAST(CASE WHEN key = 'rerank_top_n' AND value = 20 THEN 8 ELSE value END AS DOUBLE) AS value FROM stored_v", "stored_v"))
def e13(spark, d):
    return E.migrated(V.stored(spark, d), "rerank_top_n", 20.0, 8.0)


# --- JSON ----------------------------------------------------------------------------------

_J = "CASE WHEN json_valid({0}) THEN json_extract_string({0}, '{1}') END"


@query("j1_json_extract", "SELECT click_id, " + ", ".join(f"{_J.format('props', p)} AS {n}" for n, p in (("k", "$.k"), ("os", "$.device.os"), ("sku", "$.items[0].sku"))) + " FROM clicks")
def j1(spark, d):
    p = F.col("props")
    return V.table(spark, d, "clicks").select("click_id", json_value(p, "$.k").alias("k"), json_value(p, "$.device.os").alias("os"), json_value(p, "$.items[0].sku").alias("sku"))


_SET = "SELECT click_id, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN json_merge_patch(props, json_object('k', kind || '/' || click_id)) END AS p FROM clicks"


@query("j2_json_set", "SELECT click_id, " + ", ".join(f"{_J.format('p', x)} AS {n}" for n, x in (("k", "$.k"), ("ver", "$.device.ver"), ("qty", "$.items[0].qty"))) + f" FROM ({_SET})")
def j2(spark, d):
    made = V.table(spark, d, "clicks").select("click_id", json_set(F.col("props"), "k", F.concat_ws("/", "kind", F.col("click_id").cast("string"))).alias("p"), "kind")
    p = F.when(F.col("kind").isNotNull(), F.col("p"))
    return made.select("click_id", json_value(p, "$.k").alias("k"), json_value(F.col("p"), "$.device.ver").alias("ver"), json_value(F.col("p"), "$.items[0].qty").alias("qty"))


# --- index maintenance ---------------------------------------------------------------------

_F = "path, hash, mtime, size, content_indexed, ext, ctime, atime"
_OLD = f"SELECT {_F} FROM files_v WHERE doc_id % 3 <> 0"
_NEW = f"SELECT path, md5(hash) AS hash, mtime + 5 AS mtime, size + 1 AS size, content_indexed, ext, ctime + 7 AS ctime, atime + 9 AS atime FROM files_v WHERE doc_id % 4 = 0"


def _old(spark, d):
    return V.files(spark, d).where("doc_id % 3 <> 0").select(*_F.split(", "))


def _new(spark, d):
    n = V.files(spark, d).where("doc_id % 4 = 0")
    return n.select("path", F.md5("hash").alias("hash"), (F.col("mtime") + 5).alias("mtime"), (F.col("size") + 1).alias("size"), "content_indexed", "ext", (F.col("ctime") + 7).alias("ctime"), (F.col("atime") + 9).alias("atime"))


_O = {"o": _OLD, "n": _NEW}


@query("m1_insert_ignore", V.with_views(f"SELECT {_F} FROM o UNION ALL SELECT {_F} FROM n WHERE path NOT IN (SELECT path FROM o)", "files_v", more=_O))
def m1(spark, d):
    return M.inserted(_old(spark, d), _new(spark, d))


@query("m2_upsert", V.with_views("SELECT coalesce(o.path, n.path) AS path, coalesce(n.hash, o.hash) AS hash, coalesce(n.mtime, o.mtime) AS mtime, coalesce(n.size, o.size) AS size, CASE WHEN n.path IS NULL THEN o.content_indexed ELSE 0 END AS content_indexed, coalesce(n.ext, o.ext) AS ext, coalesce(o.ctime, n.ctime) AS ctime, coalesce(n.atime, o.atime) AS atime FROM o FULL JOIN n ON n.path = o.path", "files_v", more=_O))
def m2(spark, d):
    return M.upserted(_old(spark, d), _new(spark, d))


@query("m3_replace_chunks", V.with_views("SELECT path, chunk_no, length(content) AS n FROM chunks_v WHERE doc_id % 5 <> 0 UNION ALL SELECT path, chunk_no + 1000, length(content) FROM chunks_v WHERE doc_id % 5 = 0 AND chunk_no < 2", "chunks_v"))
def m3(spark, d):
    c = V.chunks(spark, d)
    mine = c.where("doc_id % 5 = 0")
    new = mine.where("chunk_no < 2").withColumn("chunk_no", F.col("chunk_no") + 1000)
    return M.replaced(c.drop("doc_id"), mine.select("path"), new.drop("doc_id")).select("path", "chunk_no", F.length("content").alias("n"))


@query("m4_completion", V.with_views("SELECT f.path, CASE WHEN b.last = 1 THEN 1 ELSE content_indexed END AS content_indexed FROM files_v f LEFT JOIN (SELECT path, max(CASE WHEN doc_id % 2 = 0 AND chunk_no = 0 THEN 1 ELSE 0 END) AS last FROM chunks_v WHERE chunk_no < 3 GROUP BY path) b ON b.path = f.path", "files_v", "chunks_v"))
def m4(spark, d):
    batch = V.chunks(spark, d).where("chunk_no < 3").select("path", ((F.col("doc_id") % 2 == 0) & (F.col("chunk_no") == 0)).alias("last"))
    return M.completed(V.files(spark, d), batch).select("path", "content_indexed")


@query("m5_empty_content", V.with_views("SELECT o.path, CASE WHEN z.path IS NULL OR (z.mtime = 0 AND z.size = 0) THEN o.mtime ELSE z.mtime END AS mtime, CASE WHEN z.path IS NULL OR (z.mtime = 0 AND z.size = 0) THEN o.size ELSE z.size END AS size, CASE WHEN z.path IS NULL THEN o.content_indexed ELSE 1 END AS content_indexed FROM o LEFT JOIN (SELECT path, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE mtime + 5 END AS mtime, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE size + 1 END AS size FROM files_v WHERE doc_id % 4 = 0) z ON z.path = o.path", "files_v", more={"o": _OLD}))
def m5(spark, d):
    zero = F.col("doc_id") % 8 == 0
    empty = V.files(spark, d).where("doc_id % 4 = 0").select("path", F.when(zero, 0).otherwise(F.col("mtime") + 5).alias("mtime"), F.when(zero, 0).otherwise(F.col("size") + 1).alias("size"))
    return M.without_content(_old(spark, d), empty).select("path", "mtime", "size", "content_indexed")


@query("m6_delete", V.with_views("SELECT path FROM o WHERE path NOT IN (SELECT path FROM n)", "files_v", more=_O))
def m6(spark, d):
    return M.deleted(_old(spark, d), _new(spark, d)).select("path")


_GONE = " UNION ALL ".join(f"SELECT '{kind}' AS kind, path, count(*) AS n FROM {kind}_v WHERE path NOT IN (SELECT path FROM files_v WHERE doc_id % 4 = 0) GROUP BY path" for kind in ("files", "chunks", "vec"))


def _tables(spark, d):
    return {"files": V.files(spark, d), "chunks": V.chunks(spark, d), "vec": V.vectors(spark, d)}


def _by_path(tables):
    rows = [t.groupBy("path").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "path", "n") for kind, t in tables.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("m6_delete_everywhere", V.with_views(_GONE, "files_v", "chunks_v", "vec_v"))
def m6_everywhere(spark, d):
    gone = V.files(spark, d).where("doc_id % 4 = 0")
    return _by_path({kind: M.deleted(t, gone) for kind, t in _tables(spark, d).items()})


_MOVED = " UNION ALL ".join(f"SELECT '{kind}' AS kind, CASE WHEN path IN (SELECT path FROM files_v WHERE doc_id % 4 = 0) THEN 'moved/' || path ELSE path END AS path, count(*) AS n FROM {kind}_v GROUP BY ALL" for kind in ("files", "chunks", "vec"))


@query("m7_rename_everywhere", V.with_views(_MOVED, "files_v", "chunks_v", "vec_v"))
def m7_everywhere(spark, d):
    pairs = V.files(spark, d).where("doc_id % 4 = 0").select(F.col("path").alias("old"), F.concat(F.lit("moved/"), "path").alias("new"))
    return _by_path({kind: M.renamed(t, pairs) for kind, t in _tables(spark, d).items()})


@query("m7_rename", V.with_views("SELECT CASE WHEN doc_id % 4 = 0 THEN 'moved/' || path ELSE path END AS path, chunk_no FROM chunks_v", "chunks_v"))
def m7(spark, d):
    c = V.chunks(spark, d)
    pairs = V.files(spark, d).where("doc_id % 4 = 0").select(F.col("path").alias("old"), F.concat(F.lit("moved/"), "path").alias("new"))
    return M.renamed(c.select("path", "chunk_no"), pairs)


@query("m8_stale", V.with_views("SELECT path FROM o WHERE path NOT IN (SELECT path FROM n)", "files_v", more=_O))
def m8(spark, d):
    return M.stale(_old(spark, d), _new(spark, d)).select("path")


@query("m8_outside_roots", V.with_views("SELECT path FROM files_v WHERE NOT starts_with(lower(path), 'corpus/src1/') AND NOT starts_with(lower(path), 'corpus/src2/en/')", "files_v"))
def m8_outside(spark, d):
    return M.outside(V.files(spark, d), ["corpus/SRC1", "corpus/src2/en"]).select("path")


@query("m9_reset_folder", V.with_views("SELECT path, CASE WHEN starts_with(path, 'corpus/src1/') THEN '0' ELSE hash END AS hash, CASE WHEN starts_with(path, 'corpus/src1/') THEN 0 ELSE content_indexed END AS content_indexed FROM files_v", "files_v"))
def m9(spark, d):
    return M.reset(V.files(spark, d), "corpus/src1").select("path", "hash", "content_indexed")


@query("m9_reset_all", V.with_views("SELECT 'files' AS kind, count(*) AS n, count(*) AS waiting FROM files_v UNION ALL SELECT 'chunks', 0, 0 UNION ALL SELECT 'vec', 0, 0", "files_v"))
def m9_all(spark, d):
    t = _tables(spark, d)
    files, *rest = M.reset_all(*t.values())
    waiting = F.coalesce(F.sum(((F.col("hash") == "0") & (F.col("content_indexed") == 0)).cast("long")), F.lit(0).cast("long"))
    rows = files.agg(F.count("*").alias("n"), waiting.alias("waiting")).select(F.lit("files").alias("kind"), "n", "waiting")
    for kind, c in zip(("chunks", "vec"), rest, strict=True):
        rows = rows.unionByName(c.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n", F.lit(0).cast("long").alias("waiting")))
    return rows


@query("m10_hash_lookup", V.with_views("SELECT n.path, coalesce(o.hash, '0') AS hash FROM n LEFT JOIN o ON o.path = n.path", "files_v", more=_O))
def m10(spark, d):
    return M.hash_of(_old(spark, d), _new(spark, d))


@query("m11_chunk_split", V.with_views("SELECT doc_id, chunk_no, content FROM chunks_v", "chunks_v"))
def m11(spark, d):
    return V.chunks(spark, d).select("doc_id", "chunk_no", "content")


@query("m11_recursive_chunks")
def m11_recursive(spark, d):
    docs = V.table(spark, d, "documents").join(V.files(spark, d).select("doc_id", "path"), "doc_id").select("path", F.col("text").alias("content"))
    return chunking.chunks(docs)


# --- set operations and change events ------------------------------------------------------


@query("u1_union_distinct", V.with_views("SELECT path FROM o UNION SELECT path FROM n", "files_v", more=_O))
def u1(spark, d):
    return _old(spark, d).select("path").union(_new(spark, d).select("path")).distinct()


@query("u2_intersection", V.with_views("SELECT path FROM o INTERSECT SELECT path FROM n", "files_v", more=_O))
def u2(spark, d):
    return _old(spark, d).select("path").intersect(_new(spark, d).select("path"))


_LAST = """SELECT key, first_action, modified, CASE WHEN first_action IS NULL AND modified THEN 'delete and add' WHEN first_action = 'remove' THEN 'delete' WHEN first_action = 'add' THEN 'add'
    WHEN first_action = 'rename' AND modified THEN 'delete old and add' WHEN first_action = 'rename' THEN 'rename' END AS plan FROM (
    SELECT key, min_by(action, seq) FILTER (WHERE action <> 'modified') AS first_action, coalesce(bool_or(action = 'modified'), false) AS modified FROM (
        SELECT c.*, max(CASE WHEN action = 'remove' THEN seq END) OVER (PARTITION BY key) AS cut FROM changes_v c) WHERE cut IS NULL OR seq >= cut GROUP BY key)"""


@query("t2_coalesced_changes", V.with_views("SELECT key, first_action, modified FROM (" + _LAST + ")", "changes_v"))
def t2(spark, d):
    return C.coalesced(V.changes(spark, d))


@query("t3_flush_plan", V.with_views(_LAST, "changes_v"))
def t3(spark, d):
    return C.planned(C.coalesced(V.changes(spark, d)))


@query("t4_windowed_changes", "SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def t4(spark, d):
    e = V.table(spark, d, "events")
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(epoch_seconds(F.col("w.start")).alias("start"), "event_type", "n", "total")
