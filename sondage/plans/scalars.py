"""Queries of projections, scalar functions, filters and vector search, with their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from sondage.functions import dates, lists, text as T, vectors as X, weights as W
from sondage.operators import ann, chunking, filters, vectors
from sondage.operators.parser import PART, parse, parsed, parts
from sondage.sources import views as V

from .registry import query

NOW = datetime.fromtimestamp(V.NOW, timezone.utc)
_EXT = "regexp_extract(lower({0}), '(\\.[^./]*)$', 1)"
_BASE = "regexp_extract({0}, '[^/]*$')"
_WORDS = "list_filter(string_split_regex(lower({0}), '[-_. /]+'), lambda n: n <> '')"


def _in(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


@query("p1_percent_decode", "SELECT page_id, url_decode(replace(u, '+', '%2B')) AS decoded FROM (SELECT page_id, replace(replace(url, '/', '%2F'), '=', '%3D+') AS u FROM pages)")
def p1(spark, d):
    u = F.replace(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("="), F.lit("%3D+"))
    return V.table(spark, d, "pages").select("page_id", T.percent_decode(u).alias("decoded"))


@query("p2_word_split", f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('url')}) AS word FROM pages) GROUP BY word")
def p2(spark, d):
    return V.table(spark, d, "pages").select(F.explode(T.words(F.col("url"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("p3_extension_basename", V.with_views(f"SELECT path, {_BASE.format('path')} AS base, {_EXT.format('path')} AS ext, regexp_replace(lower({_BASE.format('path')}), '\\.[^./]*$', '') AS stem FROM files_v", "files_v"))
def p3(spark, d):
    p = F.col("path")
    return V.files(spark, d).select("path", T.basename(p).alias("base"), T.extension(p).alias("ext"), T.stem(T.basename(p)).alias("stem"))


@query("p4_levenshtein", "SELECT p_name, min(levenshtein(p_name, 'smal rign')) AS distance FROM part GROUP BY p_name")
def p4(spark, d):
    return V.table(spark, d, "part").groupBy("p_name").agg(F.min(F.levenshtein("p_name", F.lit("smal rign"))).alias("distance"))


@query("p5_word_similarity", "SELECT p_name, any_value(round(1 - levenshtein(p_name, 'smal rign') / CAST(greatest(length(p_name), 9) AS DOUBLE), 9)) AS similarity FROM part GROUP BY p_name")
def p5(spark, d):
    return V.table(spark, d, "part").select("p_name", F.round(T.word_similarity(F.col("p_name"), F.lit("smal rign")), 9).alias("similarity")).distinct()


_TRI = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3)))"


@query("p6_trigrams", f"SELECT p_name, len({_TRI.format('p_name')}) AS n, array_to_string(list_sort({_TRI.format('p_name')}), '|') AS grams FROM part GROUP BY p_name")
def p6(spark, d):
    t = T.trigrams(F.col("p_name"))
    return V.table(spark, d, "part").select("p_name").distinct().select("p_name", F.size(t).alias("n"), F.array_join(F.sort_array(t), "|").alias("grams"))


_A, _B = _TRI.format("p_name"), _TRI.format("'large ring'")


@query("p7_trigram_jaccard", f"SELECT p_name, round(len(list_intersect({_A}, {_B})) / CAST(len(list_distinct(list_concat({_A}, {_B}))) AS DOUBLE), 9) AS similarity FROM part GROUP BY p_name")
def p7(spark, d):
    return V.table(spark, d, "part").select("p_name").distinct().select("p_name", F.round(T.jaccard(T.trigrams(F.col("p_name")), T.trigrams(F.lit("large ring"))), 9).alias("similarity"))


_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"


@query("p8_l2_normalise", f"SELECT vec_id, i, round(v[i] / n, 6) AS x FROM (SELECT vec_id, v, {_NORM.format('v')} AS n FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS v FROM embeddings)), unnest(range(1, 65)) t(i)")
def p8(spark, d):
    v = X.normalise(F.transform(X.doubles(F.col("embedding")), lambda x: x * 3))
    return V.table(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("p9_truncation", f"SELECT vec_id, i, round(v[i] / n, 6) AS x FROM (SELECT vec_id, v, {_NORM.format('v')} AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:16] AS v FROM embeddings)), unnest(range(1, 17)) t(i)")
def p9(spark, d):
    v = X.truncated(X.doubles(F.col("embedding")), 16)
    return V.table(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


_Q = "SELECT vec_id, v, list_min(v) AS lo, list_max(v) - list_min(v) AS scale FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("p10_quantise", f"SELECT vec_id, CAST(list_sum(list_transform(v, lambda x: CAST(round((x - lo) / scale * 255) AS BIGINT))) AS BIGINT) AS total, round(scale, 6) AS scale, round(lo, 6) AS lo FROM ({_Q})")
def p10(spark, d):
    q = V.table(spark, d, "embeddings").select("vec_id", X.quantise(X.doubles(F.col("embedding"))).alias("c"))
    return q.select("vec_id", F.aggregate("c.q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.round("c.scale", 6).alias("scale"), F.round("c.offset", 6).alias("lo"))


@query("p11_dequantise", f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x - (round((x - lo) / scale * 255) / 255.0 * scale + lo)))), 6) AS loss FROM ({_Q})")
def p11(spark, d):
    v = X.doubles(F.col("embedding"))
    back = X.dequantise(F.col("c"))
    rows = V.table(spark, d, "embeddings").select("vec_id", v.alias("v"), X.quantise(v).alias("c"))
    return rows.select("vec_id", F.round(F.aggregate(F.zip_with("v", back, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x), 6).alias("loss"))


@query("p13_snippet", "SELECT doc_id, CASE WHEN length(text) <= 800 THEN text WHEN instr(lower(text), 'loser') = 0 THEN substr(text, 1, 800) ELSE substr(text, greatest(least(instr(lower(text), 'loser') - 401, length(text) - 800), 0) + 1, 800) END AS snippet FROM documents")
def p13(spark, d):
    at, n = F.instr(F.lower("text"), "loser"), F.length("text")
    start = F.greatest(F.least(at - 401, n - 800), F.lit(0)) + 1
    snippet = F.when(n <= 800, F.col("text")).when(at == 0, F.substr("text", F.lit(1), F.lit(800))).otherwise(F.substr("text", start, F.lit(800)))
    return V.table(spark, d, "documents").select("doc_id", snippet.alias("snippet"))


_ASCII = "SELECT doc_id, regexp_replace(text, '[^\\x01-\\x7F]', '?', 'g') AS content FROM documents"
_ASKED = "loser the x"
_HITS = "list_min([CASE WHEN instr(substr(low, covered + 1), w) > 0 THEN covered + instr(substr(low, covered + 1), w) - 1 END FOR w IN ['loser', 'the']])"
_WALK = f"""SELECT doc_id, content, lower(content) AS low, length(content) AS n, 0 AS i, CAST(0 AS BIGINT) AS covered FROM ascii_v
    UNION ALL SELECT doc_id, content, low, n, i + 1, greatest(0, least(place - 400, n - 800)) + 800 FROM (SELECT *, CASE WHEN i = 0 THEN coalesce({_HITS}, 0) ELSE {_HITS} END AS place FROM walk WHERE i < 3 AND n > 800) WHERE place IS NOT NULL"""


@query("p13_snippet_windows", V.with_views("SELECT doc_id, i - 1 AS i, substr(content, covered - 799, 800) AS snippet FROM walk WHERE i > 0 UNION ALL SELECT doc_id, 0, content FROM walk WHERE i = 0 AND n BETWEEN 1 AND 800", more={"ascii_v": _ASCII, "walk": _WALK}))
def p13_windows(spark, d):
    # The windows are of bytes, so the texts are bound as one byte a character.
    rows = V.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^\\x01-\\x7F]", "?").alias("content"))
    return chunking.with_snippets(rows, _ASKED, 3).select("doc_id", F.posexplode("snippets").alias("i", "snippet"))


_TIME = "strftime(make_timestamp(mtime // 1000), '%Y-%m-%dT%H:%M:%SZ')"
_PARTS = "list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT contains(x, ':'))"


@query("p14_rerank_payload", V.with_views(f"SELECT path, '[Path: ' || array_to_string({_PARTS}[-4:], '/') || '] [Ext: ' || ext || '] [Size: ' || size || '] [Modified: ' || {_TIME}[1:10] || '] | Content: ' || hash AS payload FROM (SELECT 'c:/a/b/' || path AS path, ext, size, mtime, hash FROM files_v)", "files_v"))
def p14(spark, d):
    f = V.files(spark, d).withColumn("path", F.concat(F.lit("c:/a/b/"), "path"))
    kept = F.filter(F.split("path", "/"), lambda x: (x != "") & ~F.contains(x, F.lit(":")))
    last = F.slice(kept, F.greatest(F.size(kept) - 3, F.lit(1)), 4)
    return f.select("path", F.concat(F.lit("[Path: "), F.array_join(last, "/"), F.lit("] [Ext: "), "ext", F.lit("] [Size: "), F.col("size").cast("string"), F.lit("] [Modified: "), F.substr(T.rfc3339(F.col("mtime")), F.lit(1), F.lit(10)), F.lit("] | Content: "), "hash").alias("payload"))


@query("p15_rfc3339", V.with_views(f"SELECT path, {_TIME} AS modified FROM files_v", "files_v"))
def p15(spark, d):
    return V.files(spark, d).select("path", T.rfc3339(F.col("mtime")).alias("modified"))


_S = "size * size * 7"


@query("p16_human_size", V.with_views(f"SELECT path, CASE WHEN {_S} >= 1073741824 THEN printf('%.1f GB', {_S} / 1073741824.0) WHEN {_S} >= 1048576 THEN printf('%.1f MB', {_S} / 1048576.0) WHEN {_S} >= 1024 THEN printf('%.1f KB', {_S} / 1024.0) ELSE ({_S}) || ' B' END AS human FROM files_v", "files_v"))
def p16(spark, d):
    return V.files(spark, d).select("path", T.human_size(F.col("size") * F.col("size") * 7).alias("human"))


_H = "CAST('0x' || substr(md5({0}), 1, 7) AS BIGINT)"
_EMB = """SELECT p_name, i, sum(v) AS v FROM (
    SELECT p_name, h % 64 AS i, CASE WHEN (h // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END AS v FROM (SELECT p_name, {0} AS h FROM (SELECT p_name, unnest({2}) AS w FROM n))
    UNION ALL SELECT p_name, h % 64, CASE WHEN (h // 64) % 2 = 0 THEN 0.5 ELSE -0.5 END FROM (SELECT p_name, {1} AS h FROM (SELECT p_name, substr(w, i, 3) AS g FROM (SELECT p_name, unnest({2}) AS w FROM n), unnest(range(1, length(w) - 1)) t(i)))
) GROUP BY p_name, i""".format(_H.format("w"), _H.format("g"), _WORDS.format("p_name"))


@query("p18_hash_embedder", f"WITH n AS (SELECT DISTINCT p_name FROM part), e AS ({_EMB}) SELECT p_name, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY p_name)), 6) AS x FROM e")
def p18(spark, d):
    """Signed hashes of words, and of their trigrams at half weight, summed by dimension."""
    w = V.table(spark, d, "part").select("p_name").distinct().select("p_name", F.explode(T.words(F.col("p_name"))).alias("w"))
    places = F.when(F.length("w") >= 3, F.sequence(F.lit(1), F.length("w") - 2)).otherwise(F.array().cast("array<int>"))
    g = w.select("p_name", F.explode(F.transform(places, lambda i: F.substr(F.col("w"), i, F.lit(3)))).alias("w"), F.lit(0.5).alias("weight"))
    h = F.conv(F.substr(F.md5("w"), F.lit(1), F.lit(7)), 16, 10).cast("long")
    rows = w.withColumn("weight", F.lit(1.0)).union(g).select("p_name", (h % 64).alias("i"), F.when(F.floor(h / 64) % 2 == 0, F.col("weight")).otherwise(-F.col("weight")).alias("v"))
    sums = rows.groupBy("p_name", "i").agg(F.sum("v").alias("v"))
    from pyspark.sql import Window

    return sums.select("p_name", "i", F.round(F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("p_name"))), 6).alias("x"))


@query("p19_static_embedding", f"SELECT p_name, i, round(s / sqrt(sum(s * s) OVER (PARTITION BY p_name)), 6) AS x FROM (SELECT p_name, i, sum(v[i]) AS s FROM (SELECT p_name, unnest({_WORDS.format('p_name')}) AS w FROM (SELECT DISTINCT p_name FROM part)) JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) ON vec_id = {_H.format('w')} % (SELECT max(vec_id) + 1 FROM embeddings), unnest(range(1, len(v) + 1)) t(i) GROUP BY p_name, i)")
def p19(spark, d):
    """Rows of a table of token vectors, added up and brought to length 1."""
    from pyspark.sql import Window

    h = F.conv(F.substr(F.md5("w"), F.lit(1), F.lit(7)), 16, 10).cast("long")
    vectors = V.table(spark, d, "embeddings").select("vec_id", X.doubles(F.col("embedding")).alias("x"))
    w = V.table(spark, d, "part").select("p_name").distinct().select("p_name", F.explode(T.words(F.col("p_name"))).alias("w")).crossJoin(vectors.agg((F.max("vec_id") + 1).alias("ids"))).withColumn("vec_id", h % F.col("ids"))
    s = w.join(vectors, "vec_id").select("p_name", F.posexplode("x").alias("i", "v")).groupBy("p_name", "i").agg(F.sum("v").alias("s"))
    return s.select("p_name", (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("s") / F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("p_name"))), 6).alias("x"))


# --- sources -------------------------------------------------------------------------------


@query("s2_unindexed", V.with_views("SELECT path, mtime FROM files_v WHERE content_indexed = 0", "files_v"))
def s2(spark, d):
    from sondage.operators.maintenance import unindexed

    return unindexed(V.files(spark, d)).select("path", "mtime")


@query("s3_html_text", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages")
def s3(spark, d):
    body = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return V.table(spark, d, "pages").select("page_id", body.alias("body"))


@query("s5_source_kind", V.with_views(f"SELECT path, CASE WHEN ext IN ({_in(lists.IMAGE_SOURCE)}) THEN 'image' WHEN ext IN ({_in(lists.IMAGE_SKIPPED)}) THEN 'skipped' WHEN ext IN ({_in(lists.TEXT_SOURCE)}) THEN 'text' ELSE 'name only' END AS kind FROM parts_v", "parts_v"))
def s5(spark, d):
    e = F.col("ext")
    kind = F.when(e.isin(lists.IMAGE_SOURCE), "image").when(e.isin(lists.IMAGE_SKIPPED), "skipped").when(e.isin(lists.TEXT_SOURCE), "text").otherwise("name only")
    return V.parts(spark, d).select("path", kind.alias("kind"))


@query("s6_sub_batches", "SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS batch FROM part")
def s6(spark, d):
    from sondage.operators.maintenance import sub_batches

    p = V.table(spark, d, "part").select("p_partkey", "p_name", F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("path"))
    return sub_batches(p, "p_name").select("p_partkey", F.col("batch").cast("long").alias("batch"))


@query("s7_changed_hash", V.with_views("SELECT path FROM files_v WHERE doc_id % 3 = 0", "files_v"))
def s7(spark, d):
    from sondage.operators.maintenance import changed

    f = V.files(spark, d)
    return changed(f, f.withColumn("hash", F.when(F.col("doc_id") % 3 == 0, F.md5("hash")).otherwise(F.col("hash"))))


@query("s9_scope_dedup", V.with_views("SELECT lower(folder) AS folder, min(folder) AS kept FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN upper(regexp_replace(path, '/[^/]*$', '')) ELSE regexp_replace(path, '/[^/]*$', '') END AS folder FROM files_v) GROUP BY lower(folder)", "files_v"))
def s9(spark, d):
    folder = F.regexp_replace("path", "/[^/]*$", "")
    f = V.files(spark, d).select(F.when(F.col("doc_id") % 2 == 0, F.upper(folder)).otherwise(folder).alias("folder"))
    return f.groupBy(F.lower("folder").alias("folder")).agg(F.min("folder").alias("kept"))


@query("s13_rest_page", V.with_views("SELECT path, score FROM (SELECT path, size / 20000.0 AS score FROM files_v) WHERE score >= 0.15 ORDER BY score DESC, path LIMIT 50", "files_v"))
def s13(spark, d):
    return filters.page(V.files(spark, d).select("path", (F.col("size") / 20000.0).alias("score")), limit=500, least=0.15)


@query("s14_tool_page", V.with_views("SELECT path, score FROM (SELECT path, size / 20000.0 AS score FROM files_v) WHERE score >= 0.15 ORDER BY score DESC, path LIMIT 10", "files_v"))
def s14(spark, d):
    return filters.page(V.files(spark, d).select("path", (F.col("size") / 20000.0).alias("score")), least=0.15, default=10, most=20)


# --- queries in tables ---------------------------------------------------------------------

_RAW = """SELECT p_partkey, p_name || ' "' || p_name || ' x"' || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN ' ext:pdf' ELSE ' ext:.GO' END || ' size:>' || p_size
    || 'mb modified:2023-' || (p_partkey % 12 + 1) || ' -' || p_brand || CASE WHEN p_partkey % 4 = 0 THEN ' photos' ELSE '' END || ' sort:name colour:red' AS raw FROM part"""


def _raw_queries(spark, d):
    key = F.col("p_partkey")
    ext = F.when(key % 3 == 0, "").when(key % 2 == 0, " ext:pdf").otherwise(" ext:.GO")
    photos = F.when(key % 4 == 0, " photos").otherwise("")
    raw = F.format_string('%s "%s x"%s size:>%dmb modified:2023-%d -%s%s sort:name colour:red', "p_name", "p_name", ext, "p_size", key % 12 + 1, "p_brand", photos)
    return V.table(spark, d, "part").select("p_partkey", raw.alias("raw"))


@query("f1_query_parts", V.with_views(f"SELECT p_partkey, array_to_string(regexp_extract_all(raw, '{PART}'), '|') AS parts FROM raw_v", more={"raw_v": _RAW}))
def f1(spark, d):
    return _raw_queries(spark, d).select("p_partkey", F.array_join(parts(F.col("raw")), "|").alias("parts"))


_F2 = f"""SELECT p_partkey, array_to_string(list_filter(ps, lambda p: NOT starts_with(p, '-') AND NOT regexp_matches(p, '^(ext|size|modified|sort):') AND (len(x) > 0 OR p <> 'photos')), ' ') AS text,
    array_to_string(CASE WHEN len(x) > 0 THEN x WHEN list_contains(ps, 'photos') THEN [{_in(lists.HINT_EXTENSIONS['image'])}] END, '|') AS extensions,
    CAST(regexp_extract(raw, 'size:>([0-9]+)mb', 1) AS BIGINT) * 1048576 AS size_min, CAST(NULL AS BIGINT) AS size_max, epoch_ns(month) AS modified_min, epoch_ns(month + INTERVAL 1 MONTH) AS modified_max,
    array_to_string(list_transform(list_filter(ps, lambda p: starts_with(p, '-')), lambda p: lower(substr(p, 2))), '|') AS excluded, 'name' AS sort
    FROM (SELECT *, list_transform(list_filter(ps, lambda p: starts_with(p, 'ext:')), lambda p: '.' || ltrim(lower(substr(p, 5)), '.')) AS x, make_timestamp(2023, CAST(regexp_extract(raw, 'modified:2023-([0-9]+)', 1) AS BIGINT), 1, 0, 0, 0.0) AS month
        FROM (SELECT *, regexp_extract_all(raw, '{PART}') AS ps FROM raw_v))"""


@query("f2_parsed_queries", V.with_views(f"SELECT * REPLACE (coalesce(extensions, '') AS extensions) FROM ({_F2})", more={"raw_v": _RAW}))
def f2(spark, d):
    q = parsed(_raw_queries(spark, d), "raw", NOW)
    joined = lambda c: F.array_join(f"query.{c}", "|").alias(c)
    return q.select("p_partkey", "query.text", joined("extensions"), "query.size_min", "query.size_max", "query.modified_min", "query.modified_max", joined("excluded"), "query.sort")


# --- filters -------------------------------------------------------------------------------

_HINT_ROWS = ", ".join(f"('{w}', '{x}')" for k, ws in lists.HINT_WORDS.items() for w in ws for x in lists.HINT_EXTENSIONS[k])


@query("f3_type_hints", V.with_views(f"SELECT h.w AS word, count(*) AS n FROM (VALUES {_HINT_ROWS}) h(w, ext) JOIN parts_v USING (ext) GROUP BY h.w", "parts_v"))
def f3(spark, d):
    hints = spark.createDataFrame([(w, x) for k, ws in lists.HINT_WORDS.items() for w in ws for x in lists.HINT_EXTENSIONS[k]], "word string, ext string")
    return V.parts(spark, d).join(F.broadcast(hints), "ext").groupBy("word").agg(F.count("*").alias("n"))


@query("f4_type_groups", V.with_views("SELECT t AS kind, count(*) AS n FROM parts_v JOIN (VALUES " + ", ".join(f"('{k}', '{x}')" for k, xs in lists.TYPE_GROUPS.items() for x in xs) + ") g(t, ext) USING (ext) GROUP BY t", "parts_v"))
def f4(spark, d):
    groups = spark.createDataFrame([(k, x) for k, xs in lists.TYPE_GROUPS.items() for x in xs], "kind string, ext string")
    return V.parts(spark, d).join(F.broadcast(groups), "ext").groupBy("kind").agg(F.count("*").alias("n"))


def _filtered(view, raw):
    def run(spark, d):
        rows = view(spark, d)
        none = F.lit(None).cast("long")
        cols = [F.col(c) if c in rows.columns else none for c in ("path", "size", "mtime", "ctime", "atime")]
        return rows.where(filters.matching(parse(raw, NOW), *cols)).select("path")

    return run


query("f5_name_filters", V.with_views("SELECT path FROM parts_v WHERE ext IN ('.pdf', '.go') AND regexp_matches(lower(name), '^[^/]*ri[^/]g[^/]*$') AND NOT contains(lower(name), 'small')", "parts_v"))(_filtered(V.parts, "ext:pdf ext:.go name:*ri?g* -small"))
query("f6_size_filter", V.with_views("SELECT path FROM parts_v WHERE size BETWEEN 1048576 AND 3145728", "parts_v"))(_filtered(V.parts, "size:1mb-3mb"))
query("f6_size_about", V.with_views("SELECT path FROM parts_v WHERE size BETWEEN CAST(1572864 * 0.9 AS BIGINT) AND CAST(1572864 * 1.1 AS BIGINT)", "parts_v"))(_filtered(V.parts, "size:1.5mb"))
query("f7_date_filter", V.with_views(f"SELECT path FROM files_v WHERE mtime >= {(V.NOW - 9 * 86400) * V.NS} AND ctime <= {(V.NOW - 6 * 86400) * V.NS} AND atime >= {V.START * V.NS} AND atime <= {V.NOW * V.NS}", "files_v"))(_filtered(V.files, "modified:<9d created:>6d accessed:2024-01"))


@query("f8_missing_metadata", V.with_views("SELECT s.path FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'gone/' || path ELSE path END AS path FROM files_v) s LEFT JOIN files_v f ON f.path = s.path WHERE f.size IS NULL OR f.size <= 1024", "files_v"))
def f8(spark, d):
    f = V.files(spark, d)
    s = f.select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")).alias("path"))
    return s.join(f.select("path", "size"), "path", "left").where(filters.within(F.col("size"), parse("size:<1kb").size)).select("path")


@query("f9_scope", V.with_views("SELECT path FROM files_v WHERE (starts_with(lower(path), 'corpus/src1/') OR starts_with(lower(path), 'corpus/src2/')) AND NOT starts_with(lower(path), 'corpus/src1/en/')", "files_v"))
def f9(spark, d):
    return V.files(spark, d).where(filters.in_scope(F.col("path"), ["Corpus\\SRC1", "corpus/src2/"], ["corpus/src1/EN"])).select("path")


_MADE = "SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'a/node_modules/x' || ext WHEN 1 THEN 'a/b/Thumbs.db' WHEN 2 THEN 'a/x.tmp' WHEN 3 THEN 'a/WhatsApp/b.db' WHEN 4 THEN 'm/go/pkg/mod/x.go' WHEN 5 THEN 'a/Steam/x' || ext WHEN 6 THEN 'a/.hidden/x' || ext WHEN 7 THEN 'a/perflogs/x' || ext ELSE path END AS path, size FROM files_v"


def _made(spark, d):
    i, e = F.col("doc_id") % 12, F.col("ext")
    named = F.when(i == 0, F.concat(F.lit("a/node_modules/x"), e)).when(i == 1, "a/b/Thumbs.db").when(i == 2, "a/x.tmp").when(i == 3, "a/WhatsApp/b.db").when(i == 4, "m/go/pkg/mod/x.go")
    named = named.when(i == 5, F.concat(F.lit("a/Steam/x"), e)).when(i == 6, F.concat(F.lit("a/.hidden/x"), e)).when(i == 7, F.concat(F.lit("a/perflogs/x"), e)).otherwise(F.col("path"))
    return V.files(spark, d).select("doc_id", named.alias("path"), "size")


_PRIVATE = f"{_BASE.format('lower(path)')} IN ({_in(lists.PRIVATE_NAMES)}) OR ({_EXT.format('path')} = '.db' AND contains(lower(path), '/whatsapp/'))"
_JUNK = f"({_PRIVATE} OR {_BASE.format('lower(path)')} IN ({_in(lists.JUNK_NAMES)}) OR {_EXT.format('path')} IN ({_in(lists.JUNK_EXTENSIONS)}))"
_SCAN = f"(list_has_any(string_split(lower(path), '/')[:-2], [{_in(lists.SKIPPED_FOLDERS + lists.SCAN_ONLY)}]) OR contains(lower(path), '{lists.MODULE_CACHE}'))"
_WATCH = f"(list_has_any(string_split(lower(path), '/'), [{_in(lists.SKIPPED_FOLDERS + lists.WATCH_ONLY)}]) OR len(list_filter(string_split(lower(path), '/'), lambda s: starts_with(s, '.') OR starts_with(s, 'ntuser'))) > 0)"


@query("f10_junk_and_skipped", V.with_views(f"SELECT doc_id, {_JUNK} AS junk, {_SCAN} AS scan, {_WATCH} AS watch FROM m", "files_v", more={"m": _MADE}))
def f10(spark, d):
    p = F.col("path")
    return _made(spark, d).select("doc_id", filters.junk(p).alias("junk"), filters.skipped_by_scan(p).alias("scan"), filters.skipped_by_watcher(p).alias("watch"))


@query("f11_private_database", V.with_views(f"SELECT doc_id, path FROM m WHERE {_PRIVATE}", "files_v", more={"m": _MADE}))
def f11(spark, d):
    return _made(spark, d).where(filters.private_database(F.col("path"))).select("doc_id", "path")


@query("f12_too_large", V.with_views("SELECT path FROM parts_v WHERE size * 40 > 104857600", "parts_v"))
def f12(spark, d):
    return V.parts(spark, d).where(filters.too_large(F.col("size") * 40)).select("path")


@query("f13_offline", V.with_views("SELECT path FROM files_v WHERE (doc_id * 1024 & 4198400) <> 0", "files_v"))
def f13(spark, d):
    return V.files(spark, d).where(filters.offline(F.col("doc_id") * 1024)).select("path")


@query("f14_facets", V.with_views(f"SELECT CASE WHEN ext IN ('.pdf', '.docx', '.txt', '.md', '.png') THEN upper(ext[2:]) ELSE 'Other' END AS kind, CASE WHEN s < 1 THEN '< 1 MB' WHEN s <= 10 THEN '1 MB - 10 MB' WHEN s <= 100 THEN '10 MB - 100 MB' ELSE '> 100 MB' END AS size, count(*) FILTER (WHERE mtime >= {(V.NOW - 7 * 86400) * V.NS}) AS week, count(*) FILTER (WHERE mtime >= {(V.NOW - 30 * 86400) * V.NS}) AS month, count(*) AS n FROM (SELECT ext, mtime, n * 40000 / 1048576.0 AS s FROM (SELECT ext, mtime, size AS n FROM files_v)) GROUP BY ALL", "files_v"))
def f14(spark, d):
    kind = F.when(F.col("ext").isin(".pdf", ".docx", ".txt", ".md", ".png"), F.upper(F.substr("ext", F.lit(2)))).otherwise("Other")
    after = lambda days: F.sum((F.col("mtime") >= (V.NOW - days * 86400) * V.NS).cast("long"))
    f = V.files(spark, d).select(kind.alias("kind"), filters.size_facet(F.col("size") * 40000).alias("size"), "mtime")
    return f.groupBy("kind", "size").agg(after(7).alias("week"), after(30).alias("month"), F.count("*").alias("n"))


@query("f16_valid_feedback", V.with_views("SELECT id FROM (SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE query END AS query, path, feedback + CASE WHEN id % 5 = 0 THEN 5 ELSE 0 END AS feedback FROM feedback_v) WHERE query <> '' AND feedback IN (-1, 0, 1)", "feedback_v"))
def f16(spark, d):
    v = V.feedback(spark, d)
    v = v.withColumn("query", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("query"))).withColumn("feedback", F.col("feedback") + F.when(F.col("id") % 5 == 0, 5).otherwise(0))
    return filters.valid_feedback(v).select("id")


@query("x1_sort_by_date", V.with_views("SELECT path FROM files_v ORDER BY mtime DESC, size DESC, path LIMIT 25", "files_v"))
def x1(spark, d):
    return filters.ordered(V.files(spark, d).withColumn("score", F.col("size").cast("double")), "date").limit(25).select("path")


@query("x2_sort_by_name", V.with_views("SELECT path FROM parts_v ORDER BY lower(name), size DESC, path LIMIT 25", "parts_v"))
def x2(spark, d):
    return filters.ordered(V.parts(spark, d).withColumn("score", F.col("size").cast("double")), "name").limit(25).select("path")


# --- vectors -------------------------------------------------------------------------------

_SIM = "round(list_cosine_similarity(vector, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6)"


def _vector(spark, d) -> list[float]:
    return V.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def _knn_sql(collection: str, limit: int, w: float) -> str:
    near = f"SELECT path, vec_id, {_SIM} AS sim FROM vec_v WHERE collection = '{collection}' ORDER BY sim DESC, vec_id LIMIT {limit}"
    return f"SELECT path, round(sum({w} / (60.0 + r)), 9) AS rrf FROM (SELECT path, row_number() OVER (ORDER BY sim DESC, vec_id) AS r FROM ({near})) GROUP BY path"


@query("v1_text_knn", V.with_views(_knn_sql("text", 200, 1.0), "vec_v"))
def v1(spark, d):
    return vectors.knn_channel(V.vectors(spark, d), _vector(spark, d), "text", 1.0)


@query("v2_image_knn", V.with_views(_knn_sql("image", 50, 1.1), "vec_v"))
def v2(spark, d):
    return vectors.knn_channel(V.vectors(spark, d), _vector(spark, d), "image", 1.1)


@query("v3_image_search", V.with_views(f"SELECT path, max(sim) AS score FROM (SELECT path, vec_id, {_SIM} AS sim FROM vec_v WHERE collection = 'image' ORDER BY sim DESC, vec_id LIMIT 50) GROUP BY path", "vec_v"))
def v3(spark, d):
    return vectors.best_per_path(V.vectors(spark, d), _vector(spark, d), "image", 50)


@query("v4_semantic_baseline", V.with_views(f"SELECT path, max(sim) AS score FROM (SELECT path, vec_id, {_SIM} AS sim FROM vec_v ORDER BY sim DESC, vec_id LIMIT 10) GROUP BY path", "vec_v"))
def v4(spark, d):
    return vectors.best_per_path(V.vectors(spark, d), _vector(spark, d), None, 10)


@query("v5_approximate")
def v5(spark, d):
    """The ten nearest vectors of every hundredth one, by an index of all; the tests measure its recall."""
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    model = ann.fit(e)
    return ann.search(ann.build(e, model), e, e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), model)


@query("v6_collections", V.with_views("SELECT collection, count(*) AS n, count(DISTINCT path) AS paths FROM vec_v GROUP BY collection", "vec_v"))
def v6(spark, d):
    return V.vectors(spark, d).groupBy("collection").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


# --- 16-bit numbers, phrases, calendar -----------------------------------------------------

_BITS = "SELECT ps AS n, CAST(ps * 40503 % 65536 AS INTEGER) AS b FROM (SELECT p_partkey AS ps FROM part)"
_FLOAT = "CASE WHEN p = {top} THEN CASE WHEN r = 0 THEN s * CAST('Infinity' AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END WHEN p = 0 THEN s * r * 2.0 ** {low} ELSE s * (r / {scale}.0 + 1) * 2.0 ** (p - {bias}) END"


def _sixteen_sql(shift: int, top: int, bias: int) -> str:
    split = f"SELECT n, CASE WHEN b >= 32768 THEN CAST(-1.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS s, (b >> {shift}) & {top} AS p, b & {(1 << shift) - 1} AS r FROM ({_BITS})"
    value = _FLOAT.format(top=top, low=f"({1 - bias - shift})", scale=1 << shift, bias=bias)
    return f"SELECT n, CAST({value} AS DOUBLE) AS v FROM ({split})"


@query("p12_half_decode", f"SELECT h.n AS part, CASE WHEN isnan(h.v) THEN 'NaN' WHEN isinf(h.v) THEN 'inf' ELSE CAST(CAST(round(h.v * 1048576) AS BIGINT) AS VARCHAR) END AS half, CASE WHEN isnan(b.v) THEN 'NaN' WHEN isinf(b.v) THEN 'inf' ELSE CAST(sign(b.v) * floor(log2(greatest(abs(b.v), 1e-40)) + 1e-9) AS VARCHAR) END AS brain FROM ({_sixteen_sql(10, 31, 15)}) h JOIN ({_sixteen_sql(7, 255, 127)}) b ON b.n = h.n")
def p12(spark, d):
    """Bits made of part keys, as numbers of half precision (in 2 ** -20) and as the upper halves of single ones (their magnitudes)."""
    bits = (F.col("p_partkey") * 40503 % 65536).cast("int")
    shown = lambda v, text: F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), "inf").otherwise(text)
    h, b = F.col("h"), F.col("b")
    size = (F.signum(b) + 0.0) * F.floor(F.log2(F.greatest(F.abs(b), F.lit(1e-40))) + 1e-9)  # the sum leaves a negative zero without a sign, as in the SQL
    rows = V.table(spark, d, "part").select("p_partkey", W.half(bits).alias("h"), W.brain(bits).alias("b"))
    return rows.select(F.col("p_partkey").alias("part"), shown(h, F.round(h * 1048576).cast("long").cast("string")).alias("half"), shown(b, size.cast("string")).alias("brain"))


_FIELDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
_QUOTE = "'\"' || replace({0}, '\"', '\"\"') || '\"'"


@query("p17_quoted_phrases", f"SELECT item_id, CASE WHEN len(f) > 0 THEN array_to_string(list_transform(f, lambda w: {_QUOTE.format('w')}), ' OR ') ELSE {_QUOTE.format('q')} END AS quoted FROM (SELECT item_id, q, {_FIELDS.format('q')} AS f FROM (SELECT item_id, replace(text, 'e', '\"') AS q FROM benchmark))")
def p17(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", T.quoted(F.replace("text", F.lit("e"), F.lit('"'))).alias("quoted"))


_LATER = "date_trunc('month', {0}) + to_months(CAST({1} AS INTEGER)) + ({0} - date_trunc('month', {0}))"
_DAY = "CAST(o_orderdate AS TIMESTAMP)"


@query("d1_months_later", f"SELECT o_orderkey, CAST(epoch({_LATER.format(_DAY, 'o_orderkey % 27 - 13')}) AS BIGINT) AS at FROM orders")
def d1(spark, d):
    t = dates.months_later(F.col("o_orderdate"), (F.col("o_orderkey") % 27 - 13).cast("int"))
    return V.table(spark, d, "orders").select("o_orderkey", T.epoch_seconds(t).alias("at"))


@query("d2_calendar_bounds", f"""SELECT DISTINCT year({_DAY}) AS year, month({_DAY}) AS month, CAST(epoch(date_trunc('year', {_DAY})) AS BIGINT) AS year_low, CAST(epoch(date_trunc('year', {_DAY}) + INTERVAL 1 YEAR) AS BIGINT) AS year_high,
    CAST(epoch(date_trunc('month', {_DAY})) AS BIGINT) AS month_low, CAST(epoch(date_trunc('month', {_DAY}) + INTERVAL 1 MONTH) AS BIGINT) AS month_high FROM orders""")
def d2(spark, d):
    own = V.table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")).distinct()
    y, m = F.col("year").cast("int"), F.col("month").cast("int")
    of = lambda bounds, name: [T.epoch_seconds(x).alias(f"{name}_{side}") for x, side in zip(bounds, ("low", "high"), strict=True)]
    return own.select("year", "month", *of(dates.year_bounds(y), "year"), *of(dates.month_bounds(y, m), "month"))
