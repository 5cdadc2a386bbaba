"""The registered queries of this subpackage, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, langid, line_dedup, mixing, ngram_join, packing, topk, url_filter, warc
from .common import shared_dir, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "n_copies")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), size=1024, with_ids=False)
    return pieces.drop("ids")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:8]}"
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    captures = warc.assemble(warc.read_records(spark, path, with_payload=False))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page_id").alias("refers_to"))


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumns({c: fingerprints.digest(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("probability")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    return cleaned.select("doc_id", "n_lines", "removed_lines", "removed_chars", F.sha2("text", 256).alias("text_sha256"), "text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_copies", "copy", F.round("shuffle_key", 12).alias("shuffle_key"), "text")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host")))
    return found.select("doc_id", "declared", "language", F.round("probability", 6).alias("probability"), "is_kept")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages: markup language, address suffix and host are all there."""
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", langid.html_text(F.col("html")).alias("text"), langid.html_language(F.col("html")).alias("declared"), url_filter.host_of(F.col("url")).alias("host"))
    found = langid.identify(rows)
    return found.select("page_id", "host", "declared", "language", F.round("probability", 6).alias("probability"), "is_kept")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.examples(turns.unionByName(extra)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_packing, op3_warc, op4_syncmer_fingerprints, op5_url_filter, op6_line_dedup, op7_mixing,
        op8_topk_search, op9_language_id, op10_chat_format, pages_language_id,
    )
}

_BASE32 = " || ".join(f"substr('{warc.BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {15 - 5 * k}) & 31) + 1, 1)" for i in range(8) for k in range(4))

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
k AS (SELECT s.doc_id, count(t.doc_id) AS n_copies FROM (SELECT doc_id, list_sort(s) AS s FROM s) s LEFT JOIN (SELECT doc_id, list_sort(s) AS s FROM s) t ON s.s = t.s GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(b) FROM r WHERE r.a = n.doc_id) AS component_id, CASE WHEN n.n = 0 THEN 1 ELSE k.n_copies END AS n_copies
FROM n JOIN k ON n.doc_id = k.doc_id""",
    "op3_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM d""",
    "op7_mixing": """
WITH RECURSIVE s AS (SELECT coalesce(source, '') AS source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY 1),
t AS (SELECT source, (1.0::DOUBLE * (SELECT sum(size) FROM s)) / ((SELECT count(*) FROM s)::DOUBLE * size) AS rate FROM s),
c AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf, ceil(rate + 12 * sqrt(rate) + 20) AS most FROM t
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1), most FROM c WHERE k < most),
u AS (SELECT *, (('0x' || substr(md5('17|' || doc_id || '|1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, u.source, u.text, (SELECT count(*) FROM c WHERE c.source = coalesce(u.source, '') AND c.cdf <= u.u) AS n_copies FROM u),
x AS (SELECT doc_id, source, n_copies, text, unnest(range(1, n_copies + 1)) AS copy FROM n)
SELECT doc_id, source, n_copies, copy,
  round((('0x' || substr(md5('17s|' || doc_id || '|' || copy), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE, 12) AS shuffle_key, text FROM x""",
    "op8_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_chat_format": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, 8 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;'))
    + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;')) AS n FROM c),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prefix,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(prefix) FILTER (role = 'assistant' OR back = 1), 0)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""",
}
