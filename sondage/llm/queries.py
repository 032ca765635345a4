"""Queries of the operators of this package, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, html_text, line_dedup, lm_score, near_vectors, packing, piece_bpe, quality, ranked, sessions, set_join, substrings, warc
from .common import materialise, small_batches, table, words_of

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BPE)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_corpus(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, source, text, string_split(text, chr(10)) AS x FROM documents
), l AS (
    SELECT doc_id, source, text, i, x[i] AS line, trim(x[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS own
    FROM d, unnest(range(1, len(x) + 1)) t(i)
), t AS (
    SELECT source, count(text) AS pages FROM documents GROUP BY source
), b AS (
    SELECT l.source, own FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source WHERE own <> ''
    GROUP BY l.source, own HAVING count(DISTINCT doc_id) >= 3 AND 100 * count(DISTINCT doc_id) >= 7 * any_value(pages)
), k AS (
    SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept
    FROM l ANTI JOIN b ON b.source IS NOT DISTINCT FROM l.source AND b.own = l.own GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(x), 0) AS n_lines, coalesce(len(x), 0) - coalesce(k.n, 0) AS n_dropped, sha256(coalesce(kept, '')) AS text_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "ids")
    decoded = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r(vec_id, other) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a
), c AS (
    SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id
)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words_of(F.col("text")), " "), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), n AS (
    SELECT doc_id, w, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM d, unnest(range(1, len(w) - 11)) t(i)
), m AS (
    SELECT h, min(doc_id) AS lo FROM n GROUP BY h
), g AS (
    SELECT DISTINCT doc_id, i + k AS p FROM n JOIN m USING (h), unnest(range(0, 13)) t(k) WHERE lo < doc_id
), x AS (
    SELECT d.doc_id, p.i, d.w[p.i] AS word FROM d, unnest(range(1, len(w) + 1)) p(i)
), k AS (
    SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.p = x.i GROUP BY x.doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    written = materialise(warc.convert(warc.write_arc(pages)), "warc")
    return warc.read_warc(written).select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(table(spark, sf_dir, "documents"), words=3, percent=90)


OP10_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) t(i)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
), l AS (
    SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)
), r(doc_id, other) AS (
    SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE text IS NOT NULL
), z AS (
    SELECT count(*) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0
), q AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark
), qt AS (
    SELECT item_id, t, count(*) AS times FROM q GROUP BY item_id, t
), p AS (
    SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d
), f AS (
    SELECT doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM qt) GROUP BY doc_id, n, t
), wt AS (
    SELECT t, CAST(floor(1000 * ln((2 * any_value(n_all) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, z GROUP BY t
), i AS (
    SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_all) // l_all))) AS impact FROM f, z
), s AS (
    SELECT item_id, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score FROM qt JOIN wt USING (t) JOIN i USING (t) GROUP BY item_id, doc_id
), r AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 20
"""


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = piece_bpe.decode(piece_bpe.encode(docs, PIECES).select("doc_id", "ids"), PIECES)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("v"), F.col("turn").cast("long").alias("t")).dropna()
    hashed = turns.select("v", "t", F.crc32(F.col("v").cast("string")).alias("c"), F.crc32(F.concat_ws(":", "v", "t")).alias("h"))
    events = hashed.selectExpr("2 * ((v - pmod(v, 8)) div 8) + c % 2 AS user", "(c div 2) % 7200 + 300 * t + h % 600 AS second", "h", "h div 600 AS g")
    events = events.selectExpr("user", "second", "(second - pmod(second, 1800)) div 1800 + IF(g % 5 = 0, g % 4, 0) AS batch", "h")
    return sessions.merge(events, gap=240)


def _crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string; crc_table.c holds the 256 steps."""
    letters = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    step = "xor(a >> 8, c[CAST((xor(a, b) & 255) + 1 AS BIGINT)])"
    return f"xor(list_reduce({letters}, lambda a, b: {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


OP13_SQL = f"""
WITH crc_table AS (
    SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END, x)) AS c
), r AS (
    SELECT conv_id AS v, turn AS t, {_crc32_sql("CAST(conv_id AS VARCHAR)")} AS c1, {_crc32_sql("conv_id || ':' || turn")} AS h
    FROM conversations, crc_table WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), e AS (
    SELECT CAST(2 * floor(v / 8) + c1 % 2 AS BIGINT) AS u, (c1 // 2) % 7200 + 300 * t + h % 600 AS s, h FROM r
), k AS (
    SELECT u, s, h, CAST(floor(s / 1800) AS BIGINT) + CASE WHEN (h // 600) % 5 = 0 THEN (h // 600) % 4 ELSE 0 END AS b FROM e
), f AS (
    SELECT k.u, x.b AS now, k.s, k.h, k.b,
        CASE WHEN k.s - lag(k.s) OVER (PARTITION BY k.u, x.b ORDER BY k.s) <= 240 THEN 0 ELSE 1 END AS cut
    FROM k JOIN (SELECT DISTINCT u, b FROM k) x ON x.u = k.u AND k.b <= x.b
), g AS (
    SELECT *, sum(cut) OVER (PARTITION BY u, now ORDER BY s ROWS UNBOUNDED PRECEDING) AS n FROM f
), v AS (
    SELECT u, now AS b, min(s) AS lo, max(s) AS hi, count(*) AS n_events, count(*) FILTER (b = now) AS n_new, sum(h) AS h_sum
    FROM g GROUP BY u, now, n HAVING count(*) FILTER (b = now) > 0
), o AS (
    SELECT v.u, v.b, v.lo, w.b AS rb, w.lo AS rlo, row_number() OVER (PARTITION BY v.u, v.b, v.lo ORDER BY w.b) AS first
    FROM v JOIN v w ON w.u = v.u AND w.b > v.b AND w.lo <= v.lo AND w.hi >= v.hi
), p AS (
    SELECT * FROM o WHERE first = 1
), q AS (
    SELECT u, rb, rlo, count(*) AS n FROM p GROUP BY u, rb, rlo
)
SELECT v.u AS "user", v.b AS batch, v.lo AS start_s, v.hi AS end_s, v.n_events, v.n_new, coalesce(q.n, 0) AS n_retracted,
    CAST(v.h_sum AS BIGINT) AS h_sum, p.rb AS retracted_batch, p.rlo AS retracted_start_s
FROM v LEFT JOIN p ON p.u = v.u AND p.b = v.b AND p.lo = v.lo LEFT JOIN q ON q.u = v.u AND q.rb = v.b AND q.rlo = v.lo
"""


def _registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


_QUERIES = {
    "op1_packing": op1_packing,
    "op2_lm_score": op2_lm_score,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_html_text": op5_html_text,
    "op6_near_vectors": op6_near_vectors,
    "op7_substrings": op7_substrings,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_set_join": op10_set_join,
    "op11_ranked_search": op11_ranked_search,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_sessions": op13_sessions,
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _registered(query) for name, query in _QUERIES.items()}
ORACLE = {"op3_line_dedup": OP3_SQL, "op6_near_vectors": OP6_SQL, "op7_substrings": OP7_SQL, "op8_warc": OP8_SQL, "op10_set_join": OP10_SQL, "op11_ranked_search": OP11_SQL, "op13_sessions": OP13_SQL}
