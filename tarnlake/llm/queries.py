"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import html_text, licenses, mixing, ngram_join, pieces, quality, substring, vector_dedup, vector_search, warc
from tarnlake.llm.common import scratch_path, table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    found = warc.read_archive(spark, path)
    return found.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to").alias("refers_to"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("row.page_id", "row.url", "text", "n_chars")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("repeats")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join(docs).select("doc_id", "class_id", "n_links", "kept")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs).select("row.doc_id", "ids", "n_tokens", "round_trip")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("row.doc_id", "held_out", "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_warc, op3_html_extraction, op4_embedding_near_dedup, op5_license_scan, op6_suffix_array_dedup, op7_mixing_sources, op8_ngram_jaccard_join, op9_sentencepiece, op10_quality_classifier)}
#: The others are approximate, learned or hashed, or hold floating-point sums; brute-force tests hold them.
ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT payload_digest AS digest, max(page_id) AS latest FROM p WHERE payload_bytes >= 1000 AND page_id IS NOT NULL GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < latest THEN latest END AS refers_to
        FROM p LEFT JOIN g ON payload_digest = digest""",
    "op4_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        n AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1),
        c AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op6_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
        p AS (SELECT doc_id, n, unnest(range(0, n - 99, 500)) AS p, h FROM d),
        c AS (SELECT doc_id, p, least(500, n - 99 - p) AS many, substr(h, 2 * p + 1, 1198) AS c FROM p),
        w AS (SELECT doc_id, p, c, unnest(range(0, many)) AS o FROM c),
        f AS (SELECT doc_id, p + o AS s, row_number() OVER (PARTITION BY md5_number(substr(c, 2 * o + 1, 200)) ORDER BY doc_id, p + o) AS k FROM w),
        i AS (SELECT doc_id, s, s + 100 AS e, max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f WHERE k > 1),
        g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM i),
        r AS (SELECT doc_id, g, min(s) AS s, max(e) AS e FROM g GROUP BY 1, 2),
        q AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM r),
        k AS (SELECT q.doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(max(h), 2 * max(e) + 1) AS kept FROM q JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op8_ngram_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) > 0),
        c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM b JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 10 * common >= 8 * (x.n + y.n - common)),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        n AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1),
        l AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
        SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, doc_id <= coalesce(low, doc_id) AS kept
        FROM documents LEFT JOIN n ON n.a = doc_id LEFT JOIN l ON l.a = doc_id""",
}
